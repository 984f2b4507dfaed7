"""Mixing sources to target weights as a time-varying curriculum; DataFrame functions only.

Every source has a weight schedule w(t) over training time t in [0, 1], piecewise linear between knots. Its
integral, scaled to the source's target, is the source's cumulative token demand. A document copy that starts at
token m of its source's stream belongs at the time where that demand reaches m, so inverting the integral (a
quadratic in each segment) gives the copy's training position, and a range sort by position gives the order.

Streams: within a source, documents follow a seeded hash order. Prefix sums are two-level (hash buckets, then rows
of a bucket), so a source that holds most rows is spread over all buckets. All sums are integers; reruns agree.

Defined cases: null text has size 0; null source is a source of its own, sorted last; documents of size 0 take
nothing; an empty table gives an empty result; repeated rows are separate documents (rows that differ in their texts alone are told apart
by a hash of those, also where doc_id is null); texts of any length count whole; extra columns, whatever their names, are ignored by
``plan_mix`` and kept by ``mix_documents``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.llm.columns import own
from quernstone.runtime import staged

WORD = r"[^\x20\x09-\x0D]+"
#: One schedule for each place in the weight cycle: knots (time, intensity). Flat, rising, falling.
CURRICULUM = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.5), (1.0, 0.5)))


def _segments(knots: Sequence[tuple[float, float]]) -> tuple[list[tuple[float, float, float, float]], float]:
    """(start, intensity there, slope, area before it) of each segment, and the whole area."""
    out, area = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        if t1 <= t0 or min(w0, w1) < 0:
            raise ValueError("knots must rise in time and not be negative")
        out.append((t0, w0, (w1 - w0) / (t1 - t0), area))
        area += (w0 + w1) / 2 * (t1 - t0)
    if area <= 0:
        raise ValueError("a schedule needs a positive integral")
    return out, area


def _pick(place: Column, values: Sequence[Column]) -> Column:
    expr = values[-1]
    for i in range(len(values) - 2, -1, -1):
        expr = F.when(place == i, values[i]).otherwise(expr)
    return expr


def invert_demand(share: Column, place: Column, curriculum: Sequence[Sequence[tuple[float, float]]]) -> Column:
    """The time at which a source has used ``share`` (0 to 1) of its demand; ``place`` picks its schedule."""
    times = []
    for knots in curriculum:
        segments, whole = _segments(knots)
        area = share * F.lit(whole)
        expr = None
        for t0, w0, slope, before in segments:
            rest = area - F.lit(before)
            root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * rest, F.lit(0.0)))
            here = F.when(rest <= 0, F.lit(t0)).otherwise(F.lit(t0) + F.lit(2.0) * rest / (F.lit(w0) + root))
            expr = here if expr is None else F.when(area >= F.lit(before), here).otherwise(expr)
        times.append(expr)
    return F.least(_pick(place, times), F.lit(1.0))


def source_targets(sizes: DataFrame, weights: Sequence[float], budget: float, epochs: float) -> DataFrame:
    """Water-filling: (src, source_size) -> place in the cycle and target.

    A source's target is min(epochs * its size, level * its weight), with the level at which all targets add up
    to budget * all sizes. Sources sorted by cap / weight fill up in that order, so two running sums give the level.
    The window holds one row per source.
    """
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = sizes.withColumn("place", (F.row_number().over(Window.orderBy("src")) - 1) % len(weights))
    ranked = ranked.withColumn("weight", _pick(F.col("place"), [F.lit(float(w)) for w in weights]))
    ranked = ranked.withColumn("cap", F.lit(float(epochs)) * F.col("source_size"))
    ranked = ranked.withColumn("full_at", F.col("cap") / F.col("weight"))
    order = Window.orderBy("full_at", "src")
    ranked = (
        ranked.withColumn("pot", F.lit(float(budget)) * F.sum("source_size").over(every))
        .withColumn("caps_before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weights_left", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("pot") - F.col("caps_before")) / F.col("weights_left"))
    )
    level = F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(every)
    return ranked.withColumn("water", level).select(
        "src", "place", "source_size",
        F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("water") * F.col("weight"))).alias("target"),
    )


def plan_mix(
    docs: DataFrame,
    *,
    weights: Sequence[float] = (5, 2, 1),
    budget: float = 1.5,
    epochs: float = 2,
    curriculum: Sequence[Sequence[tuple[float, float]]] = CURRICULUM,
    cut: str = "word",
    seed: int = 1,
    rows_per_bucket: int = 2_000,
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies, position, and ``carry`` columns.

    Only narrow columns are staged; ``carry`` columns (a whole row, say) come from a second scan and one shuffle.
    ``cut="word"`` lets the mix stop inside a source's last copy, so its taken words equal the rounded target;
    ``cut="document"`` takes whole copies only, a copy counting if its middle lies before the target. ``position``
    is the time (0 to 1) at which the first copy is due, null if nothing is taken; copy k is due where the demand
    reaches k whole passes more (``copy_position``).
    """
    if cut not in ("word", "document"):
        raise ValueError("cut is 'word' or 'document'")
    wide = docs.select(
        "doc_id",
        *carry,
        F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), F.col("source"))).alias("src"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64("text").alias("tie"),
    )
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.col("tie").cast("string")))  # rows without an id are spread too
    wide = wide.withColumn("key", F.md5(F.concat_ws("|", F.lit(str(seed)), name, F.col("size").cast("string")).cast("binary")))
    base = staged(wide.drop(*carry), "mix")
    digits, n = 1, base.count()
    while n > rows_per_bucket * 16**digits:
        digits += 1
    bucket = F.substring("key", 1, digits)
    rows = (wide if carry else base).withColumn("bucket", bucket)
    buckets = base.withColumn("bucket", bucket).groupBy("src", "bucket").agg(F.sum("size").alias("bucket_size"))
    buckets = staged(buckets, "mix-buckets")
    targets = source_targets(buckets.groupBy("src").agg(F.sum("bucket_size").alias("source_size")), weights, budget, epochs)
    before = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    info = buckets.withColumn("start", F.coalesce(F.sum("bucket_size").over(before), F.lit(0))).drop("bucket_size").join(targets, "src")
    inside = Window.partitionBy("src", "bucket").orderBy("key", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(info, ["src", "bucket"]).withColumn("at", F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    demand = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(demand / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = demand - passes * F.col("source_size")
    if cut == "word":
        taken = passes * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("at")))
        copies = passes + F.when((F.col("size") > 0) & (rest > F.col("at")), 1).otherwise(0)
    else:
        copies = passes + F.when((F.col("size") > 0) & (2 * rest > 2 * F.col("at") + F.col("size")), 1).otherwise(0)
        taken = copies * F.col("size")
    rows = rows.withColumn("taken", taken.cast("long")).withColumn("copies", copies.cast("long"))
    return rows.withColumn("position", F.when((F.col("copies") > 0) & (F.col("size") > 0), copy_position(F.lit(0), curriculum)))


def copy_position(k: Column, curriculum: Sequence[Sequence[tuple[float, float]]] = CURRICULUM) -> Column:
    """When copy ``k`` (from 0) of a row of plan_mix is due."""
    share = (F.col("at") + k * F.col("source_size")) / F.greatest(F.col("target"), F.lit(1.0))
    return F.round(invert_demand(F.least(share, F.lit(1.0)), F.col("place"), curriculum), 9)


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents themselves, whole copies in training order, with the input's columns only."""
    columns = docs.columns
    plan = plan_mix(docs.select(F.struct(*own(docs)).alias("row"), "doc_id", "source", "text"), cut="document", carry=("row",), **options)
    curriculum = options.get("curriculum", CURRICULUM)
    copies = plan.filter("copies > 0").select("row", "at", "source_size", "target", "place", "key", "tie", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("k"))
    due = copies.withColumn("due", copy_position(F.col("k"), curriculum)).select("due", "key", "tie", "k", "row")
    return due.repartitionByRange("due", "key", "tie", "k").sortWithinPartitions("due", "key", "tie", "k").select(*[F.col("row").getField(c).alias(c) for c in columns])
