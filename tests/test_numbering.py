import random

from pyspark.sql import functions as F

from quernstone.operators import numbering
from quernstone.operators.search import merge_queries
from tests.test_store import scan_metric


def test_numbers_and_pages(spark):
    values = [(random.Random(i).randrange(50), i) for i in range(1000)]
    rows = spark.createDataFrame(values, "v int, id int").repartition(7)
    got = {r.id: r.position for r in numbering.numbered(rows, F.desc("v"), "id").collect()}
    want = {i: n for n, (_, i) in enumerate(sorted(values, key=lambda x: (-x[0], x[1])), 1)}
    assert got == want
    pages = numbering.Pages(rows, F.desc("v"), "id")
    assert [r.id for r in pages.page(120, 30).collect()] == [i for i, n in sorted(want.items(), key=lambda x: x[1]) if 120 < n <= 150]
    assert pages.page(990, 30).count() == 10 and pages.page(1000, 5).count() == 0
    assert numbering.numbered(rows.limit(0), "id").count() == 0
    bounds = sorted(map(tuple, pages.bounds(300, "id").collect()))
    order = [i for i, _ in sorted(want.items(), key=lambda x: x[1])]
    assert bounds == [(p, order[300 * p], order[min(300 * p + 299, 999)], min(300, 1000 - 300 * p)) for p in range(4)]


def test_no_window_over_all_rows(spark):
    rows = spark.range(100)
    for df in (numbering.zip_rows(rows, rows.withColumnRenamed("id", "other"), "id", "other"), merge_queries(rows.select(F.lit(0).alias("query_idx"), F.lit(1).alias("rank"), F.col("id").alias("chunk_id"), F.lit(1.0).alias("score")))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "SinglePartition" not in plan


def test_a_page_reads_its_rows_alone(spark):
    pages = numbering.Pages(spark.range(0, 200_000, 1, 8).withColumn("t", F.repeat(F.col("id").cast("string"), 20)), "id")
    assert scan_metric(pages.page(150_000, 10), "numOutputRows") < 150_000
