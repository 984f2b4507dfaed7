"""Cells of vectors: the leaves of a k-d tree, with boxes that hold every row.

The cuts are medians of a bounded sample, ``SEEDS`` rows a cell and ``SAMPLE`` in all; every row has its cell, and the boxes come from all rows. So a box rules
out a cell for certain, however good the cuts are. The tree is complete: node i has the children 2i + 1 and 2i + 2, and goes with tasks as a few arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEEDS, SAMPLE = 32, 65_536
#: Boxes and distances are rounded in different orders.
NEAR_ONE = 1 + 1e-9


class Cuts(NamedTuple):
    axis: np.ndarray
    cut: np.ndarray


def matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def cuts_of(seeds: np.ndarray, depth: int) -> Cuts:
    """Medians along the widest axis; a row goes left where its entry is below the cut."""
    axis, cut = np.zeros(2**depth - 1, dtype=np.int64), np.zeros(2**depth - 1)
    held = [np.arange(len(seeds))]
    for node in range(len(axis)):
        mine = seeds[held[node]]
        below = np.zeros(len(mine), dtype=bool)
        if len(mine):
            axis[node] = np.argmax(mine.max(axis=0) - mine.min(axis=0))
            x = mine[:, axis[node]]
            cut[node] = np.partition(x, len(x) // 2)[len(x) // 2]
            if cut[node] <= x.min():  # many equal entries: the cut is above them
                cut[node] = x[x > x.min()].min(initial=np.inf) if x.max() > x.min() else x.min()
            below = x < cut[node]
        held += [held[node][below], held[node][~below]]
    return Cuts(axis, cut)


def cell_of(cuts: Cuts, v: np.ndarray) -> np.ndarray:
    node, rows = np.zeros(len(v), dtype=np.int64), np.arange(len(v))
    while len(cuts.axis) and len(v) and node[0] < len(cuts.axis):
        node = 2 * node + 1 + (v[rows, cuts.axis[node]] >= cuts.cut[node])
    return node - len(cuts.axis)


def cut_up(points: DataFrame, n: int, leaf: int) -> tuple[DataFrame, int]:
    """``points`` (id, v) with their ``cell``, about ``leaf`` rows in each, and the number of cells."""
    depth = max(0, int(np.ceil(np.log2(max(1, n) / leaf))))
    wanted = min(SEEDS * 2**depth, SAMPLE) if depth else 0
    share = min(1.0, 1.1 * wanted / max(1, n))
    drawn = points.filter(F.pmod(F.xxhash64("id", F.lit(depth)), F.lit(2**30)) < int(share * 2**30)).select("id", "v").collect() if depth else []
    drawn.sort(key=lambda r: r.id)
    cuts = cuts_of(np.array([r.v for r in drawn], dtype=np.float64), depth if drawn else 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = cell_of(cuts, matrix(batch.column("v"), batch.num_rows))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], [*batch.schema.names, "cell"])

    return points.select("id", "v").mapInArrow(run, "id long, v array<double>, cell int"), len(cuts.axis) + 1


class Boxes(NamedTuple):
    """Of all nodes: bounds of every axis, the least core, and the least and largest component."""

    low: np.ndarray
    high: np.ndarray
    core: np.ndarray
    least: np.ndarray
    most: np.ndarray


def boxes_of(found: list, cells: int, width: int) -> Boxes:
    """``found``: (cell, low, high, core, least comp, largest comp) of the cells that have rows."""
    inner = cells - 1
    low, high, core = np.full((inner + cells, width), np.inf), np.full((inner + cells, width), -np.inf), np.full(inner + cells, np.inf)
    least, most = np.full(inner + cells, np.iinfo(np.int64).max), np.full(inner + cells, np.iinfo(np.int64).min)
    for r in found:
        low[inner + r[0]], high[inner + r[0]], core[inner + r[0]], least[inner + r[0]], most[inner + r[0]] = r[1:]
    for node in range(inner - 1, -1, -1):
        a, b = 2 * node + 1, 2 * node + 2
        low[node], high[node], core[node] = np.minimum(low[a], low[b]), np.maximum(high[a], high[b]), min(core[a], core[b])
        least[node], most[node] = min(least[a], least[b]), max(most[a], most[b])
    return Boxes(low, high, core, least, most)


def bounds(width: int) -> list:
    return [F.array(*[F.min(F.col("v")[i]) for i in range(width)]).alias("low"), F.array(*[F.max(F.col("v")[i]) for i in range(width)]).alias("high")]


def within(boxes: Boxes, v: np.ndarray, reach: np.ndarray, comp: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell): the cells whose box or least core is not beyond a row's reach; with ``comp``, those of that component alone are left out."""
    row, node, inner = np.arange(len(v)), np.zeros(len(v), dtype=np.int64), len(boxes.low) // 2
    limit = (reach * NEAR_ONE) ** 2 + 1e-300
    while True:
        gap = np.maximum(np.maximum(boxes.low[node] - v[row], v[row] - boxes.high[node]), 0)
        keep = np.einsum("ik,ik->i", gap, gap) <= limit[row]
        keep &= np.isfinite(boxes.low[node, 0])
        if comp is not None:
            keep &= (boxes.core[node] ** 2 <= limit[row]) & ((boxes.least[node] != comp[row]) | (boxes.most[node] != comp[row]))
        row, node = row[keep], node[keep]
        if not len(node) or node[0] >= inner:
            return row, node - inner
        row, node = np.repeat(row, 2), (2 * node[:, None] + [1, 2]).ravel()
