"""How far the sources of a language diverge in their words: a plain relational audit in exact integers.

Terms (what a split at ``BREAK`` leaves, which Spark does in a third of the time of finding the matches of its complement one by one) are exploded
with each distinct one of a row once more (for the document counts), grouped by language, source and term. Each language keeps the terms that enough of its documents hold. Groups meet their language's vocabulary, which fills in zero
counts; a self-join by language and term sets every two sources of a language side by side; sums and window ranks follow.

A share p is 1 + floor(1e9 * (count + 5) / (N + 5 V)), in long arithmetic by three steps of a thousand each, exact to 9e15 occurrences.
A language's groups meet its vocabulary by (lang, slot of the term), so a language of most rows spreads over ``SLOTS`` keys. The size of the
result (sources squared for each language) and of the dense table (sources times vocabulary) is what the audit asks for.

Defined cases: null text, lang and source are empty strings, sources of their own; texts without a term (empty or blank ones too) count only as
documents of their group, which is listed even so; a language without vocabulary has no terms and pairs of value 0; very long texts are one row
like others, their terms one array; repeated rows count each; ties rank by the item's UTF-8 bytes; an empty table gives an empty
result; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.runtime import staged

BREAK = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"  # terms are the runs of all other characters
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLOTS = 256
SMOOTH = 5


def ascii_lower(text: Column) -> Column:
    """A-Z lowered and nothing else; texts of ASCII alone take the faster function."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group, and documents of the group that hold it."""
    text = ascii_lower(F.coalesce("text", F.lit("")))
    rows = docs.select(_or_empty("lang"), _or_empty("source"), F.split(text, BREAK).alias("terms"))
    # an occurrence as it is, a document's distinct term in an array of its own
    found = rows.select("lang", "source", F.explode(F.array(F.struct(F.lit(0).alias("docs"), F.col("terms").alias("terms")), F.struct(F.lit(1).alias("docs"), F.array_distinct("terms").alias("terms")))).alias("x"))
    found = found.select("lang", "source", "x.docs", F.explode("x.terms").alias("term")).filter("term <> ''")
    return found.groupBy("lang", "source", "term").agg(F.sum(1 - F.col("docs")).alias("n"), F.sum("docs").cast("long").alias("docs"))


def _or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)


def share(count: Column, size: Column) -> Column:
    """1 + floor(1e9 * count / size) for 0 < count <= size."""
    rest, out = count, F.lit(0).cast("long")
    for _ in range(3):
        rest = rest * F.lit(1000).cast("long")
        out, rest = out * F.lit(1000).cast("long") + F.call_function("div", rest, size), rest % size
    return 1 + out


def audit(docs: DataFrame, *, min_docs: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part ("pair" or "term"), item, value, rank of every (lang, source) group of ``docs`` (text, lang, source)."""
    groups = staged(docs.select(_or_empty("lang"), _or_empty("source")).distinct(), "audit-groups")
    counts = staged(term_counts(docs), "audit-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).filter(F.col("docs") >= min_docs).select("lang", "term", "lang_n")
    kept = staged(kept, "audit-terms")
    here = counts.join(kept.select("lang", "term"), ["lang", "term"], "left_semi").select("lang", "source", "term", "n")
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_size"))
    group_sizes = here.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    known = groups.join(sizes, "lang").join(group_sizes, ["lang", "source"], "left").withColumn("size", F.coalesce("size", F.lit(0).cast("long")))
    known = staged(known, "audit-sizes")

    # every group with every term of its language, by slots of the terms
    slot = F.pmod(F.xxhash64("term"), F.lit(SLOTS)).cast("int").alias("slot")
    spread = known.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))))
    full = spread.join(kept.withColumn("slot", slot), ["lang", "slot"]).drop("slot")
    dense = full.join(here, ["lang", "source", "term"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    p = share(F.col("n") + SMOOTH, F.col("size") + SMOOTH * F.col("v"))
    q = share(F.col("lang_n") + SMOOTH, F.col("lang_size") + SMOOTH * F.col("v"))
    dense = staged(dense.select("lang", "source", "term", "n", p.alias("p"), q.alias("q")), "audit-dense")

    mine, other = dense.select("lang", "term", "source", "p"), dense.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"))
    apart = mine.join(other, ["lang", "term"]).filter("source <> item").groupBy("lang", "source", "item").agg(F.sum(F.abs(F.col("p") - F.col("q"))).alias("value"))
    pairs = _others(groups).join(apart, ["lang", "source", "item"], "left").withColumn("value", F.coalesce("value", F.lit(0).cast("long")))
    terms = dense.filter("n > 0 and p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    ranked = lambda rows, part: rows.withColumn("rank", F.row_number().over(order)).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return ranked(pairs, "pair").unionByName(ranked(terms, "term").filter(F.col("rank") <= top))


def _others(groups: DataFrame) -> DataFrame:
    """(lang, source, item): each group with each other source of its language, by slots of the source."""
    left = groups.withColumn("slot", F.pmod(F.xxhash64("source"), F.lit(SLOTS)).cast("int"))
    right = groups.select("lang", F.col("source").alias("item")).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))))
    return left.join(right, ["lang", "slot"]).filter("source <> item").select("lang", "source", "item")
