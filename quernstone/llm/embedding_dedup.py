"""Near-duplicate vectors by an exact metric range join.

On unit vectors cosine >= c is a Euclidean distance of at most r = sqrt(2 - 2c). Per label, pivots split the distinct
vectors: each goes home to its nearest pivot's cell, and a copy goes to every other cell whose border it may be near.
With d1 the distance to the home pivot p and d2 to another pivot q, a vector of q's cell within r of x needs
d2 <= d1 + 2r (triangle inequality) and (d2^2 - d1^2) / (2 d(p, q)) <= r (distance to the bisecting plane), so x is
copied only where both hold. Cells are then joined independently, in blocks of ``BLOCK`` rows by matrix products; a
home row meets all partners there, so links are counted once and nothing crosses cells.

A label of many vectors is split in steps of at most ``PIVOTS`` cells, and cells that are still large are split again by pivots of their
own, in which a vector that only visits the cell goes on visiting. That ends when every cell fits, or when splitting no longer parts a cell
(its vectors are all within the radius of each other), which the blocks then join.

Equal vectors of a label form one class and are compared once; a class counts with its size. A block reports, for each row,
its number of links and one link to the root of the block's own components, so its output is linear in its rows.

Defined cases: null labels, null or empty or zero vectors, and null or non-finite components link with nothing
(0 links, their own component, kept); vectors of different length don't link; repeated vec_ids are rows of their own that
share an id; null vec_ids are counted as links, and never name a component unless all of it is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.components import components
from quernstone.runtime import small_batches, staged

BLOCK = 2048
CELL = 4096  # distinct vectors a cell should hold
PIVOTS = 1024  # of one step of splitting, which bounds what a task holds beside its vectors
CHUNK = 16_384  # vectors that one task assigns to pivots
SLACK = 1e-7


def unit_rows(vectors: list[bytes]) -> np.ndarray:
    rows = np.stack([np.frombuffer(v, "<f8") for v in vectors])
    return rows / np.sqrt((rows * rows).sum(axis=1))[:, None]


def assign(rows: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """The home cell of each row, and for each row the other cells that get a copy."""
    near = np.sqrt(np.maximum(2 - 2 * rows @ pivots.T, 0))
    home = near.argmin(axis=1)
    between = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))
    first = near[np.arange(len(rows)), home][:, None]
    plane = (near**2 - first**2) / np.maximum(2 * between[home], 1e-12)
    copies = (near <= first + 2 * radius + SLACK) & ((plane <= radius + SLACK) | (between[home] < 1e-9))
    copies[np.arange(len(rows)), home] = False
    return home, [np.flatnonzero(c) for c in copies]


def block_roots(linked: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """For the rows and columns of a block their root: the first row of their component in the block's links, -1 if none.

    ``same``: rows and columns are the same vectors.
    """
    n_rows, n_cols = linked.shape
    row_root, col_root = np.full(n_rows, -1), np.full(n_cols, -1)
    for start in np.flatnonzero(linked.any(axis=1)):
        if row_root[start] >= 0:
            continue
        rows, row_root[start] = np.array([start]), start
        while len(rows):
            cols = np.flatnonzero(linked[rows].any(axis=0) & (col_root < 0))
            col_root[cols] = start
            found = linked[:, cols].any(axis=1) if len(cols) else np.zeros(n_rows, dtype=bool)
            if same:
                found[cols] = True
            rows = np.flatnonzero(found & (row_root < 0))
            row_root[rows] = start
    return row_root, col_root


CELL_ROW = "group string, node long, n long, parts array<double>, home boolean"


def split_cells(rows: DataFrame, radius: float, cell: int) -> DataFrame:
    """``rows`` (CELL_ROW) with groups split into cells, groups of their own, until each has about ``cell`` home rows or can't be split.

    Every home row stands in one cell, together with all rows of its group within ``radius``; rows that aren't at home don't come home.
    """
    done = None
    while True:
        sizes = rows.groupBy("group").agg(F.count_if("home").alias("size"))
        scaled = rows.join(sizes, "group").withColumn("pivots", F.least(F.ceil(F.col("size") / cell), F.lit(PIVOTS)))
        one = scaled.filter("pivots <= 1").select("group", "node", "n", "parts", "home")
        split = staged(_deal(scaled.filter("pivots > 1"), radius), "vector-cells")
        done = one if done is None else done.unionByName(one)
        # a cell that is large still goes on if it has lost a fifth of the rows that met in its group
        before = rows.groupBy("group").agg(F.count(F.lit(1)).alias("rows"), F.count_if("home").alias("homes")).withColumnRenamed("group", "parent")
        after = split.groupBy("parent", "group").agg(F.count(F.lit(1)).alias("now"), F.count_if("home").alias("now_homes"))
        large = staged(after.filter(F.col("now_homes") > 2 * cell).join(before, "parent").filter("5 * now <= 4 * rows").select("group"), "large")
        fits = split.drop("parent")
        if large.limit(1).count() == 0:
            return staged(done.unionByName(fits), "vector-cells")
        done = done.unionByName(fits.join(large, "group", "left_anti"))
        rows = fits.join(large, "group", "left_semi")


def _deal(rows: DataFrame, radius: float) -> DataFrame:
    """Groups with their ``pivots`` (a number) and ``size`` to cells by random pivots: parent, and CELL_ROW with the cell as group."""
    draw = F.pmod(F.xxhash64("node", "group"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = staged(rows.filter(F.col("home") & (draw < F.col("pivots") / F.col("size"))).select("group", "parts"), "pivots")
    counts = rows.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    spread = chosen.join(counts, "group").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("group", "chunk", "parts")
    dealt = rows.join(counts, "group").withColumn("chunk", F.pmod(F.hash("node"), "chunks")).select("group", "chunk", "node", "n", "parts", "home")
    columns = ["parent", "group", "node", "n", "parts", "home"]

    def deal(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({c: [] for c in columns})
        left = left.rename(columns={"group": "parent"})
        if not len(right):
            return left.assign(group=left["parent"] + "/0")[columns]
        pivots = np.stack(sorted(right["parts"], key=tuple))
        pivots = pivots / np.sqrt((pivots**2).sum(axis=1))[:, None]
        out = []
        for lo in range(0, len(left), BLOCK):
            part = left.iloc[lo : lo + BLOCK]
            raw = np.stack(part["parts"].to_list())
            home, copies = assign(raw / np.sqrt((raw**2).sum(axis=1))[:, None], pivots, radius)
            index = np.repeat(np.arange(len(part)), [len(c) for c in copies])
            both = pd.concat([part, part.iloc[index].assign(home=False)])
            cell = np.concatenate([home, *copies]).astype("int64")
            out.append(both.assign(group=both["parent"] + "/" + cell.astype(str).astype(object)))
        return pd.concat(out)[columns]

    schema = f"parent string, {CELL_ROW}"
    return dealt.groupBy("group", "chunk").cogroup(spread.groupBy("group", "chunk")).applyInPandas(deal, schema)


def link_vectors(vectors: DataFrame, *, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cell: int = CELL) -> DataFrame:
    """One row per vector: the id, n_links, component_id, kept."""
    small_batches(vectors.sparkSession, 4096)
    radius = float(np.sqrt(2 - 2 * cosine))
    parts = F.transform(vector_col, lambda x: x.cast("double"))
    fine = F.col(label_col).isNotNull() & F.coalesce(F.size(vector_col) > 0, F.lit(False))
    fine &= F.coalesce(F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
    fine &= F.coalesce(F.exists(vector_col, lambda x: x != 0), F.lit(False))
    # -0.0 and 0.0 are one value in a vector, as in its products
    key = F.when(fine, F.sha2(F.concat_ws(",", F.lit(0), F.transform(parts, lambda x: (x + 0.0).cast("string"))), 256))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), parts.alias("parts"), key.alias("key"))
    rows = rows.withColumn("key", F.when(F.col("key").isNotNull(), F.concat_ws(":", F.hash("label").cast("string"), F.col("label").cast("string"), "key")))
    rows = staged(rows.select("id", "label", "key", "parts"), "vectors")
    classes = rows.filter("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"), F.first("label").alias("label"), F.first("parts").alias("parts"))
    classes = classes.withColumn("group", F.concat_ws("/", F.col("label").cast("string"), F.size("parts").cast("string"))).withColumn("node", F.monotonically_increasing_id())
    classes = staged(classes.select("node", "key", "n", "least", "group", "parts"), "vector-classes")

    cells = split_cells(classes.select("group", "node", "n", "parts", F.lit(True).alias("home")), radius, cell).withColumn("cell", F.lit(0))

    counts = cells.groupBy("group", "cell").agg(F.count_if("home").alias("homes"), F.count(F.lit(1)).alias("all"))
    sized = cells.join(counts, ["group", "cell"]).withColumn("hb", F.ceil(F.col("homes") / BLOCK).cast("int")).withColumn("ob", F.ceil(F.col("all") / BLOCK).cast("int"))
    # a row's block among the homes and among all; every pair of a home block and a block of all rows is one task
    as_home = sized.filter("home").select("*", F.pmod(F.hash("node"), "hb").alias("i"), F.explode(F.sequence(F.lit(0), F.col("ob") - 1)).alias("j"), F.lit(True).alias("left"))
    as_other = sized.select("*", F.explode(F.sequence(F.lit(0), F.col("hb") - 1)).alias("i"), F.pmod(F.hash("node"), "ob").alias("j"), F.lit(False).alias("left"))
    tasks = as_home.unionByName(as_other).select("group", "cell", "i", "j", "left", "node", "n", "parts")

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["left"]], pdf[~pdf["left"]]
        if not len(left) or not len(right):
            return pd.DataFrame({"node": [], "links": [], "root": []}).astype("int64")
        norm = lambda s: (m := np.stack(s.to_list())) / np.sqrt((m * m).sum(axis=1))[:, None]
        a, b = norm(left["parts"]), norm(right["parts"])
        a_node, b_node, b_n = left["node"].to_numpy(), right["node"].to_numpy(), right["n"].to_numpy()
        nodes, links, roots = [], [], []
        for lo in range(0, len(a), BLOCK):
            some = slice(lo, lo + BLOCK)
            linked = (a[some] @ b.T >= cosine) & (a_node[some][:, None] != b_node[None, :])
            row_root, col_root = block_roots(linked, False)
            total = linked @ b_n
            hit = row_root >= 0
            nodes += [a_node[some][hit], b_node[col_root >= 0]]
            links += [total[hit], np.zeros((col_root >= 0).sum(), dtype="int64")]
            roots += [a_node[some][row_root[hit]], a_node[some][col_root[col_root >= 0]]]
        return pd.DataFrame({"node": np.concatenate(nodes), "links": np.concatenate(links), "root": np.concatenate(roots)})

    found = staged(tasks.groupBy("group", "cell", "i", "j").applyInPandas(join, "node long, links long, root long"), "vector-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    root = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = classes.select("node", "key", "n", "least").join(links, "node", "left").join(root, "node", "left")
    known = staged(known.withColumn("root", F.coalesce("root", "node")), "vector-roots")
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    by_key = known.join(least, "root").select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    # a key that many rows share is a skewed join, which Spark splits at run time
    out = rows.select("id", "key").join(by_key, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))
