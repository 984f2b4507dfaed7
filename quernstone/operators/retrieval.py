"""From a question to graded, reranked chunks: retrievers, grader, rerankers, map-reduce."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.operators import prompts, search
from quernstone.runtime import staged

QUERY_SEPARATOR = "[SEP]"
IRRELEVANT = "irrelevant"
NOT_PERTINENT = "Not pertinent"


def single_queries(questions: DataFrame) -> DataFrame:
    """The question itself is the only query: query_id, query_idx, text."""
    return questions.select("query_id", F.lit(0).alias("query_idx"), "text")


def multi_queries(questions: DataFrame, write: Callable[[Column], Column]) -> DataFrame:
    """A model's variants of the question, between separators; as written, and without the question itself."""
    said = F.split(write(F.col("text")), r"\[SEP\]")
    return questions.select("query_id", F.posexplode(said).alias("query_idx", "text"))


def hyde_queries(questions: DataFrame, write: Callable[[Column], Column], *, combine: bool = False) -> DataFrame:
    """A hypothetical answer as the query, and the question too if ``combine``."""
    both = F.array(write(F.col("text")), F.col("text")) if combine else F.array(write(F.col("text")))
    return questions.select("query_id", F.posexplode(both).alias("query_idx", "text"))


RETRIEVERS: dict[str, Callable[..., DataFrame]] = {"single": single_queries, "multiQuery": multi_queries, "hyde": hyde_queries}


def expand(kind: str, questions: DataFrame, **options) -> DataFrame:
    if kind not in RETRIEVERS:
        raise ValueError(f"unknown retriever {kind!r}; there are {sorted(RETRIEVERS)}")
    return RETRIEVERS[kind](questions, **options)


def keep_relevant(rows: DataFrame, grade: Column) -> DataFrame:
    """Rows that the grader didn't call irrelevant; a failed grade (null) keeps the row."""
    return rows.filter(grade.isNull() | (grade != IRRELEVANT))


def rerank(rows: DataFrame, score: Column, k: int, *, by: str = "query_id", tie: str = "chunk_id") -> DataFrame:
    """The k best of each query by a new score (fewer if there are fewer)."""
    order = Window.partitionBy(by).orderBy(F.desc("rerank_score"), F.asc(tie))
    return rows.withColumn("rerank_score", score).withColumn("rerank_rank", F.row_number().over(order)).filter(F.col("rerank_rank") <= k)


def first_of(rows: DataFrame, k: int) -> DataFrame:
    """Without a reranker: the first k in retrieval order."""
    return rows.filter(F.col("rank") <= k)


def retrieve(
    questions: DataFrame,
    chunks: DataFrame,
    *,
    kind: str = "single",
    embed: Callable[[Column], Column],
    partitions: str | Sequence[str] | None = ("all",),
    filters: Mapping[str, object] | None = None,
    top_k: int = 6,
    threshold: float | None = 0.95,
    hybrid: bool = True,
    grade: Callable[[Column, Column], Column] | None = None,
    rerank_by: Callable[[Column, Column], Column] | None = None,
    rerank_k: int = 5,
    **options,
) -> DataFrame:
    """The whole way from questions (query_id, text) to the chunks for their prompts: query_id, rank, score and the chunks' columns.

    A retriever writes the queries, all of them are searched together, their results are merged for each question, then comes the
    grader (``grade(question, chunk text)``), and the reranker (``rerank_by(question, chunk text)``) picks ``rerank_k``; without
    one the first ``rerank_k`` stay.
    """
    queries = expand(kind, questions, **options)
    # a query's number among all of its question's, as one id for the search
    numbered = queries.withColumn("question", F.col("query_id")).withColumn("query_id", F.xxhash64("question", "query_idx"))
    staged_queries = staged(numbered.withColumn("vector", embed(F.col("text"))), "queries")
    some = search.scope(chunks, partitions, filters)
    found = search.ranked(staged_queries.select("query_id", "text", "vector"), some, top_k=top_k, threshold=threshold, hybrid=hybrid)
    found = found.select("query_id", "rank", "chunk_id", "score").join(staged_queries.select("query_id", "question", "query_idx"), "query_id")
    merged = search.merge_queries(found.select(F.col("question").alias("query_id"), "query_idx", "rank", "chunk_id", "score"), by=("query_id",))
    rows = search.with_chunks(merged.withColumn("rank", F.col("position")), some)
    asked = questions.select("query_id", F.col("text").alias("question_text"))
    if grade is not None:
        rows = keep_relevant(rows.join(asked, "query_id").withColumn("grade", grade(F.col("question_text"), F.col("text"))), F.col("grade")).drop("question_text", "grade")
    if rerank_by is not None:
        scored = rerank(rows.join(asked, "query_id"), rerank_by(F.col("question_text"), F.col("text")), rerank_k)
        return scored.withColumn("rank", F.col("rerank_rank")).drop("question_text", "rerank_rank")
    again = Window.partitionBy("query_id").orderBy("rank")
    return first_of(rows.withColumn("rank", F.row_number().over(again)), rerank_k)


def chat(messages: DataFrame, chunks: DataFrame, system: str, *, depth: int, rewrite: Callable[[Column], Column] | None = None, **options) -> DataFrame:
    """Retrieval and prompt of each conversation (conv_id, turn, role, text): conv_id, payload, sources (chunk ids in order).

    Only the last ``depth`` messages count. The last one is the query, or what ``rewrite`` makes of their transcript. ``options`` are
    those of ``retrieve``.
    """
    recent = prompts.last_messages(messages, depth).select("conv_id", "turn", "role", "text")
    if rewrite is None:
        asked = recent.groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))
    else:
        asked = prompts.transcript(recent).select("conv_id", rewrite(F.col("transcript")).alias("text"))
    questions = asked.withColumnRenamed("conv_id", "query_id")
    found = staged(retrieve(questions, chunks, **options).select("query_id", "rank", "chunk_id", F.col("text").alias("content")), "retrieved")
    contexts = prompts.format_context(questions, found).withColumnRenamed("query_id", "conv_id")
    sources = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id")))["chunk_id"].alias("sources"))
    out = prompts.prepare_chat(recent, contexts, system, depth).join(sources.withColumnRenamed("query_id", "conv_id"), "conv_id", "left")
    return out.select("conv_id", "payload", F.coalesce("sources", F.array().cast("array<long>")).alias("sources"))


def complete(questions: DataFrame, chunks: DataFrame, **options) -> DataFrame:
    """Retrieval and prompt of each text to complete (query_id, text): query_id, prompt."""
    found = staged(retrieve(questions, chunks, **options).select("query_id", "rank", F.col("text").alias("content")), "retrieved")
    contexts = prompts.format_context(questions, found).join(found.select("query_id").distinct(), "query_id", "left_semi")
    return prompts.prepare_completion(questions.select("query_id", F.col("text").alias("prompt")).join(contexts, "query_id", "left"))


def source_links(found: DataFrame, chunks: DataFrame, base: str) -> DataFrame:
    """found (query_id, rank, chunk_id) with the links of the chunks' files and of the chunks themselves."""
    name = F.coalesce(F.element_at("metadata", "filename"), F.col("file_id"))
    rows = found.join(chunks.select("chunk_id", "file_id", "metadata"), "chunk_id")
    return rows.withColumn("file_url", T.encode_path(F.concat(F.lit(base.rstrip("/") + "/static/"), name))).withColumn("chunk_url", F.concat(F.lit(base.rstrip("/") + "/extract/"), F.col("chunk_id").cast("string")))


def max_sim(query_tokens: Column, doc_tokens: Column) -> Column:
    """Late interaction: for each query token vector its best dot product with a document token vector, summed."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, d in batches:
            yield pd.Series([float((np.stack(a) @ np.stack(b).T).max(axis=1).sum()) if len(a) and len(b) else 0.0 for a, b in zip(q, d)])

    return score(query_tokens, doc_tokens)


def match_back(ranked: DataFrame, docs: DataFrame, *, content: str = "content") -> DataFrame:
    """Ranked texts (position, content) to the documents they came from, each document used once, in ranked order."""
    left = ranked.withColumn("_n", F.row_number().over(Window.partitionBy(content).orderBy("position")))
    right = docs.withColumn("_n", F.row_number().over(Window.partitionBy(content).orderBy("doc_id")))
    return left.join(right, [content, "_n"]).drop("_n")


def keep_pertinent(rows: DataFrame, synthesis: Column) -> DataFrame:
    """Map step: rows with the model's synthesis, without those it calls not pertinent; where it failed (null) the synthesis is empty."""
    return rows.withColumn("synthesis", F.coalesce(synthesis, F.lit(""))).filter(~F.contains("synthesis", F.lit(NOT_PERTINENT)))
