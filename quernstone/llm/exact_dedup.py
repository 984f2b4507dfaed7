"""Exact duplicates by progressive refinement, in Spark's own expressions alone.

Texts are equal when they are identical after each run of ASCII white space became one space. Groups are refined in three steps: by the
length of the normalised text, then by a hash of its first ``PREFIX`` characters, then by its SHA-256. A row that is alone in its group
after a step takes no part in the next, so only groups that survive both narrow steps have their content hashed (``hash_all``
gives the others a digest too, in the same scan) and only their rows are shuffled by it; nothing but ids and hashes ever is.

A group that holds more than 1/4096 of the rows is hot. There are less than 4096 of those, so their verdicts are broadcast; the others'
are joined by a shuffle in which no key has more rows than that.

Defined cases: a null text counts as empty, and so are all blank texts but for their one space (an empty text and a blank one differ);
very long texts are hashed whole; of equal texts the row of the smallest doc_id stays, null doc_ids last, and of rows that share that
doc_id one; an empty table gives an empty result; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.columns import free_name, own
from quernstone.runtime import broadcast_if_small, staged

PREFIX = 256  # characters of the first hash
HOT_SHARE = 4096  # a group with more than 1/HOT_SHARE of the rows is hot
LENGTHS = 1 << 20  # length classes: a length modulo this, so that their table is bounded
BROADCAST_GROUPS = 1_000_000  # surviving groups (two longs each) that are broadcast; more are joined by a shuffle


def normalised(text: Column) -> Column:
    """The text with each run of ASCII white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t-\r]+", " ")


def _narrow(norm: Column) -> tuple[Column, Column]:
    return F.octet_length(norm).alias("n_bytes"), F.xxhash64(F.substring(norm, 1, PREFIX)).alias("head")


def surviving_groups(docs: DataFrame) -> DataFrame:
    """(n_bytes, head) of more than one row, with their number of rows."""
    sizes = staged(docs.select(normalised(F.col("text")).alias("norm")).select(*_narrow(F.col("norm"))), "sizes")
    length = (F.col("n_bytes") % LENGTHS).alias("length")
    crowded = sizes.groupBy(length).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("length")  # LENGTHS rows at most
    rest = sizes.withColumn("length", length).join(F.broadcast(crowded), "length", "left_semi")
    return staged(rest.groupBy("n_bytes", "head").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1"), "groups")


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], size: str, total: int) -> DataFrame:
    """``rows`` left-joined to ``groups`` (one row a key; ``size`` is its number of rows out of ``total``): hot keys by broadcast, the others by a shuffle.

    Both are read twice and should be staged.
    """
    heavy = F.col(size) * HOT_SHARE > total
    hot = groups.filter(heavy)  # less than HOT_SHARE rows
    keys = F.broadcast(hot.select(*on))
    return rows.join(F.broadcast(hot), on).unionByName(rows.join(keys, on, "left_anti").join(groups.filter(~heavy).hint("shuffle_merge"), on, "left"))


def _hashed(docs: DataFrame, hash_all: bool) -> tuple[DataFrame, int]:
    """(doc_id, row, several, text_sha256) of every row, and their number; ``several``: its group survived the narrow steps."""
    total = docs.count()
    groups = surviving_groups(docs)
    small = groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    rows = docs.select("doc_id", normalised(F.col("text")).alias("norm")).withColumns(dict(zip(("n_bytes", "head"), _narrow(F.col("norm")))))
    digest = F.sha2("norm", 256)
    if small:
        marked = rows.join(F.broadcast(groups), ["n_bytes", "head"], "left")
        wanted = digest if hash_all else F.when(F.col("rows").isNotNull(), digest)
        marked = marked.select("doc_id", F.col("rows").isNotNull().alias("several"), wanted.alias("text_sha256"))
    else:  # hashed before the join, so that no text is shuffled
        narrow = staged(rows.select("doc_id", "n_bytes", "head", digest.alias("text_sha256")), "digests")
        several = F.col("rows").isNotNull()
        marked = join_groups(narrow, groups, ["n_bytes", "head"], "rows", total)
        marked = marked.select("doc_id", several.alias("several"), (F.col("text_sha256") if hash_all else F.when(several, F.col("text_sha256"))).alias("text_sha256"))
    return staged(marked.withColumn("row", F.monotonically_increasing_id()), "hashed"), total


def exact_duplicates(docs: DataFrame, *, hash_all: bool = False) -> DataFrame:
    """One row per document: doc_id, keep_id (doc_id of the row that stays), group_size, kept, text_sha256 (of the normalised text;
    null for texts whose length or beginning nobody shares, unless ``hash_all``)."""
    rows, total = _hashed(docs, hash_all)
    first = F.struct(F.col("doc_id").isNull().alias("absent"), F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"))
    equal = rows.filter("several").groupBy("text_sha256").agg(F.count(F.lit(1)).alias("group_size"), F.min(first).alias("first")).filter("group_size > 1")
    equal = staged(equal.select("text_sha256", "group_size", "first.keep_id", "first.keep_row"), "equal")
    alone = lambda df: df.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    joined = join_groups(rows.filter("several"), equal, ["text_sha256"], "group_size", total)
    single = F.col("group_size").isNull()
    verdict = joined.select(
        "doc_id", F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (single | (F.col("row") == F.col("keep_row"))).alias("kept"), "text_sha256",
    )
    return alone(rows.filter("not several")).unionByName(verdict)


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs``, with its columns whatever their names, with one row of each group of equal texts: that of the smallest doc_id.

    Rows alone in their group flow through; only the others' kept rows are shuffled, to cut those that share a doc_id down to one.
    """
    verdict = staged(exact_duplicates(docs).filter("group_size > 1"), "verdict")
    sha, other, other_id = free_name(docs, "sha"), free_name(docs, "other_sha"), free_name(docs, "other_id")
    rows = docs.withColumn(sha, F.sha2(normalised(F.col("text")), 256))
    equal = broadcast_if_small(verdict.select(F.col("text_sha256").alias(other)).distinct(), BROADCAST_GROUPS)
    firsts = broadcast_if_small(verdict.filter("kept").select(F.col("text_sha256").alias(other), F.col("doc_id").alias(other_id)), BROADCAST_GROUPS)
    single = rows.join(equal, F.col(sha) == F.col(other), "left_anti")
    first = rows.join(firsts, (F.col(sha) == F.col(other)) & F.col("doc_id").eqNullSafe(F.col(other_id)), "left_semi").dropDuplicates([sha])
    return single.unionByName(first).select(*own(docs))
