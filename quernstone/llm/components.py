"""Connected components of a link table.

Up to ``ONE_TASK`` links (their number is checked, 16 bytes each) one task joins them in a union-find. Beyond that, star rounds take over:
each is one aggregate and one join by node, written to the shared folder, so lineage stays short; rounds end when no
link changes, which alternating stars reach for any graph. Links are never collected to the driver, which sees two numbers a round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.runtime import ship_package, staged

ONE_TASK = 2_000_000


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % (1 << 40))).head())


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, their smallest reachable nodes) of links a - b: labels fall to the least of each link's ends and are
    followed to their own labels until nothing changes."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        after = label.copy()
        for end in (x, y):
            np.minimum.at(after, end, low)
            np.minimum.at(after, label[end], low)
        while True:
            further = after[after]
            if (further == after).all():
                break
            after = further
        if (after == label).all():
            return nodes, nodes[label]
        label = after


def _in_one_task(links: DataFrame) -> DataFrame:
    ship_package(links.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches if b.num_rows]
        if held:
            nodes, roots = union_find(*(np.concatenate(x) for x in zip(*held)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], ["node", "root"])

    return links.repartition(1).mapInArrow(run, "node long, root long")


def components(links: DataFrame) -> DataFrame:
    """(node, root): for every node of ``links`` (a long, b long; any direction, repeats allowed) its smallest reachable node.

    Null ends and self-links are ignored; nodes without other links are not listed.
    """
    pairs = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    if pairs.count() <= ONE_TASK:
        return staged(_in_one_task(pairs), "components")
    now = staged(pairs.distinct(), "links")
    before = _mark(now)
    while before[0]:
        # large star: neighbours above a node go to the least of the node and its neighbours
        both = now.select("a", "b").unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = staged(large, "links-large")
        # small star: neighbours below a node, and the node, go to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionAll(least.select("a", F.col("m").alias("b"))).distinct()
        now = staged(small, "links-small")
        after = _mark(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
