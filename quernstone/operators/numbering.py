"""Row numbers and pages of a whole table without a window over all of it.

Rows are range-partitioned and sorted by their order, written once, counted by partition, and numbered by the rows of the partitions
before (one number a partition) and their place within their own. A page is then a range of numbers, which Parquet's statistics find in the few
files that hold it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.runtime import staged


def numbered(rows: DataFrame, *order: str | Column, name: str = "position") -> DataFrame:
    """``rows`` with their number from 1 in ``order``; rows that tie wholly are numbered in any order. A range key that all rows share sorts them in
    one task, so orders should end in an id."""
    spark = rows.sparkSession
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    held = staged(sorted_.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    counts = held.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("first")).orderBy("_part").collect()  # a row for each partition
    before, shifts = 0, []
    for r in counts:
        shifts.append((r._part, before + 1 - r.first))
        before += r.n
    shift = F.broadcast(spark.createDataFrame(shifts, "_part int, _shift long"))
    return held.join(shift, "_part").withColumn(name, F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


class Pages:
    """A table in a stated order, sorted and numbered once; every page reads the files of its numbers."""

    def __init__(self, rows: DataFrame, *order: str | Column):
        self.columns = rows.columns
        self.rows = staged(numbered(rows, *order, name="_position"), "pages")

    def page(self, offset: int, limit: int) -> DataFrame:
        return self.rows.filter((F.col("_position") > offset) & (F.col("_position") <= offset + limit)).orderBy("_position").select(*self.columns)

    def bounds(self, size: int, key: str) -> DataFrame:
        """page, first and last value of ``key`` and rows of each page of ``size`` rows: the boundaries a client can go on from."""
        number = F.floor((F.col("_position") - 1) / size)
        return self.rows.groupBy(number.alias("page")).agg(F.min_by(key, "_position").alias("first"), F.max_by(key, "_position").alias("last"), F.count(F.lit(1)).alias("n"))


def zip_rows(left: DataFrame, right: DataFrame, order_left: str | Sequence[str], order_right: str | Sequence[str]) -> DataFrame:
    """Positional join of two tables in their orders, as long as the shorter."""
    orders = [[o] if isinstance(o, str) else list(o) for o in (order_left, order_right)]
    return numbered(left, *orders[0], name="_pos").join(numbered(right, *orders[1], name="_pos"), "_pos").drop("_pos")
