"""The queries of this subpackage and their oracle SQL; thin digests of the operators' results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import decontamination, embedding_dedup, exact_dedup, language_model, minhash_dedup, mixing, sharding, source_audit, token_counts, token_files, toxicity, url_rules, whitening
from quernstone.llm.oracles import ORACLES
from quernstone.runtime import new_folder, table

#: The rules of the URL query: host, path, action.
URL_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def crc_mod(column: str, n: int) -> F.Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(table(spark, sf_dir, "documents"))
    return plan.orderBy("position", "key").select("doc_id", "size", "source_size", "target", "taken", "position")


def op2_compact_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    store = sharding.ShardStore(spark, new_folder(spark, "shards"))
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(10))
    for low, high in ((0, 1), (1, 4), (4, 10)):  # three arrivals of unequal size
        store.append(docs.filter((part >= low) & (part < high)))
    store.compact_all()
    return store.read(with_shard=True).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "source", "lang", "n_chars")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").filter(crc_mod("doc_id", 4) != 2)
    scored = toxicity.score_documents(docs.select("doc_id", "text"), toxicity.learn(docs, labels))
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, _tokenizer("piece_bpe_32k.model")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link_vectors(table(spark, sf_dir, "embeddings"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(crc_mod("doc_id", 10) == 0, F.lit(False))
    scored = language_model.score_corpus(docs.withColumn("held_out", held), train_where=~F.col("held_out"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.token_folder(spark)
    manifest = token_files.write_token_files(table(spark, sf_dir, "documents"), folder, _tokenizer("word_bpe_49k.json"))
    return token_files.read_token_files(spark, folder, manifest)


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [url_rules.host_rule(*r) for r in URL_RULES] + [url_rules.pattern_rule(p) for p in url_rules.BLOCK_PATTERNS]
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"), hash_all=True)


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS long)"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_mix_sources, op2_compact_shards, op3_toxicity, op4_token_counts, op5_embedding_dedup, op6_minhash_dedup, op7_lm_scoring, op8_decontaminate,
        op9_token_files, op10_url_rules, op11_exact_dedup, op12_source_audit, op13_whitening,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
