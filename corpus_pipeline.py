"""The corpus pipeline: toxicity, near-duplicates, benchmark decontamination, source mix, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents, whatever they are named; each works on all rows that its predecessor
kept, of any length, and gives an empty result for an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import decontamination, minhash_dedup, mixing, sharding, toxicity
from quernstone.runtime import new_folder, staged, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from all labels, scores at 0.3 or more go.

    Null, empty and blank texts score as the softmax's bias alone; without labels of both classes the share of toxic labels is every score.
    """
    return toxicity.keep_clean(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8) stays: the row of its smallest doc_id.

    Null, empty and blank texts stay, each; of repeated rows one stays.
    """
    return minhash_dedup.keep_one_of_each(docs, shingle=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a ten-word passage of a benchmark item go; those without words, null ones included, stay."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in weights 5, 2, 1 as a curriculum, 150 % of all words, no source more than twice; in training order.

    A null source is one of its own; documents without words take no place in the mix; ties in position go by hash, so reruns agree.
    """
    return mixing.mix_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the newest version of a shard store that took the documents in and compacted them, with their shard's name in a
    column ``shard`` (``shard_`` where the documents have one); every row stays as it is."""
    store = sharding.ShardStore(spark, new_folder(spark, "corpus-shards"))
    store.append(docs)
    store.vacuum(store.compact_all())  # nobody reads the versions before
    return store.read(with_shard=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: A trained classifier and signatures have no SQL form; tests check what each stage keeps, drops and returns, and the operators below them against brute force.
ORACLE_SQL = None
