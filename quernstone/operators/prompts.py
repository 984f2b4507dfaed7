"""Prompt and context assembly: ordered rows become text blocks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions import text as T

# fixed values: texts that outputs must hold to the letter
NO_DOCUMENT = "No document found from the database"
CONTEXT_HEAD = "Extracted documents:\n"
INDENT = " " * 8
COMPLETION_CONTEXT = "Given the context: \n"
COMPLETION_HEAD = "Complete the following prompt: "
QUERY_REQUEST = "Given the following chat, generate a query. \n"


def joined(rows: DataFrame, by: str, order: str, line: Column, glue: str = "") -> DataFrame:
    """``line`` of all rows of a group in order, joined: by, text."""
    listed = rows.select(by, F.struct(F.col(order).alias("o"), line.alias("t")).alias("x")).groupBy(by).agg(F.array_sort(F.collect_list("x")).alias("x"))
    return listed.select(by, F.array_join(F.col("x.t"), glue).alias("text"))


def context_block(number: Column, content: Column) -> Column:
    """One numbered source with its text and a rule."""
    return F.concat(F.lit(f"\n{INDENT}*source*: [doc_"), number.cast("string"), F.lit(f"]\n{INDENT}content: \n"), T.strip(content), F.lit(f"\n\n{INDENT}" + T.RULE + "\n\n"))


def format_context(queries: DataFrame, found: DataFrame) -> DataFrame:
    """Context of each query: found (query_id, rank, content) -> query_id, context; queries without documents say so."""
    text = joined(found, "query_id", "rank", context_block(F.col("rank"), F.col("content")))
    out = queries.select("query_id").join(text, "query_id", "left")
    return out.select("query_id", F.coalesce(F.concat(F.lit(CONTEXT_HEAD), F.col("text")), F.lit(NO_DOCUMENT)).alias("context"))


def map_reduce_context(found: DataFrame) -> DataFrame:
    """Syntheses in order, each with a rule: found (query_id, rank, synthesis) -> query_id, context."""
    text = joined(found, "query_id", "rank", F.concat("synthesis", F.lit("\n" + T.RULE + "\n")))
    return text.select("query_id", F.concat(F.lit(CONTEXT_HEAD), "text").alias("context"))


def transcript(messages: DataFrame) -> DataFrame:
    """``role: content`` lines of each conversation: messages (conv_id, turn, role, text) -> conv_id, transcript."""
    return joined(messages, "conv_id", "turn", F.concat("role", F.lit(": "), "text", F.lit("\n"))).withColumnRenamed("text", "transcript")


def last_messages(messages: DataFrame, depth: int) -> DataFrame:
    """The last ``depth`` messages of each conversation; none for 0."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.withColumn("age", F.row_number().over(newest)).filter(F.col("age") <= depth)


def simple_query(messages: DataFrame) -> DataFrame:
    """The last message of each conversation is its query, if a user wrote it and it isn't empty: conv_id, query."""
    last = messages.groupBy("conv_id").agg(F.max_by(F.struct("role", "text"), "turn").alias("m"))
    return last.filter((F.col("m.role") == "user") & (T.strip(F.col("m.text")) != "")).select("conv_id", F.col("m.text").alias("query"))


def prepare_chat(messages: DataFrame, contexts: DataFrame, system: str, depth: int) -> DataFrame:
    """The messages to send: a system message with the context, then the history: conv_id, payload (array of role, content).

    ``contexts`` (conv_id, context); ``system`` holds ``{context}``.
    """
    history = last_messages(messages, depth)
    listed = history.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("h"))
    rows = listed.join(contexts, "conv_id", "left")
    first = F.struct(F.lit("system").alias("role"), F.replace(F.lit(system), F.lit("{context}"), F.coalesce("context", F.lit(NO_DOCUMENT))).alias("content"))
    rest = F.transform("h", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    return rows.select("conv_id", F.concat(F.array(first), rest).alias("payload"))


def query_request(messages: DataFrame, system: str) -> DataFrame:
    """What a query writer is asked for each conversation, from its last messages: conv_id, payload (array of role, content)."""
    asked = transcript(messages).select("conv_id", F.concat(F.lit(QUERY_REQUEST), "transcript", F.lit("\n")).alias("asked"))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return asked.select("conv_id", F.array(message("system", F.lit(system)), message("user", F.col("asked"))).alias("payload"))


def prepare_completion(prompts: DataFrame) -> DataFrame:
    """prompts (query_id, prompt, context or null) -> query_id, prompt, with the context before it where there is one."""
    context = F.coalesce(F.concat(F.lit(COMPLETION_CONTEXT), "context", F.lit("\n")), F.lit(""))
    return prompts.select("query_id", F.concat(context, F.lit(COMPLETION_HEAD), "prompt").alias("prompt"))


def qa_block(chunks: DataFrame, by: str) -> DataFrame:
    """Numbered documents for question writing: chunks (by, n, chunk) -> by, text."""
    line = F.concat(F.lit("Document "), F.col("n").cast("string"), F.lit(":\n"), "chunk", F.lit("\n" + T.RULE + "\n"))
    out = joined(chunks, by, "n", line)
    return out.select(by, T.strip(F.col("text")).alias("text"))


def fill(template: str, **values: Column) -> Column:
    """A template with each ``{name}`` replaced, all at once: a value that holds braces itself stays as it is; ``query`` and ``question`` stand for each other."""
    if "query" in values:
        values.setdefault("question", values["query"])
    elif "question" in values:
        values["query"] = values["question"]
    parts = re.split(r"\{(\w+)\}", template)  # text, name, text, name, ...
    return F.concat(*[F.lit(p) if i % 2 == 0 else values.get(p, F.lit("{" + p + "}")) for i, p in enumerate(parts)])
