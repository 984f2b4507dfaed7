"""Text to chunks: one row becomes many; page tracking and context are window functions."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.functions import vectors as V
from quernstone.runtime import small_batches

SEPARATORS = ("\n\n", "\n", " ", "")
MARKER = r"\[PAGE_(\d+)\]"


def fixed_chunks(docs: DataFrame, *, size: int = 1000, overlap: int = 100, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Windows of ``size`` characters that overlap: keep, chunk_no (from 0), chunk. JVM only."""
    if not 0 <= overlap < size:
        raise ValueError("0 <= overlap < size")
    step = size - overlap
    n = F.greatest(F.ceil((F.length("text") - overlap) / step), F.lit(1)).cast("int")
    rows = docs.select(*keep, "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_no"))
    return rows.select(*keep, "chunk_no", F.substring(F.col("text"), F.col("chunk_no") * step + 1, F.lit(size)).alias("chunk"))


def _merge(pieces: list[tuple[str, int]], glue: str, size: int, overlap: int, length: Callable[[str], int]) -> list[str]:
    """Greedy chunks of up to ``size`` from pieces with their lengths; each new chunk keeps trailing pieces of up to ``overlap``."""
    out: list[str] = []
    held: deque[tuple[str, int]] = deque()
    total, gap = 0, length(glue)
    for p, n in pieces:
        if held and total + n + gap > size:
            out.append(glue.join(t for t, _ in held).strip())
            while held and (total > overlap or total + n + gap > size):
                total -= held[0][1] + (gap if len(held) > 1 else 0)
                held.popleft()
        total += n + (gap if held else 0)
        held.append((p, n))
    if held:
        out.append(glue.join(t for t, _ in held).strip())
    return [c for c in out if c]


def split_recursive(text: str | None, size: int, overlap: int, length: Callable[[str], int] = len, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Split at the coarsest separator there is, keep it at the start of its piece, split long pieces further, merge short ones. A piece is measured once."""
    text = (text or "").strip()
    if not text:
        return []
    at = next(i for i, s in enumerate(separators) if s == "" or s in text)
    sep, finer = separators[at], separators[at + 1 :]
    parts = list(text) if sep == "" else [p for i, p in enumerate(text.split(sep)) for p in [(sep if i else "") + p] if p]
    out: list[str] = []
    short: list[tuple[str, int]] = []
    for p in parts:
        n = length(p)
        if n < size or not finer:
            short.append((p, n))
            continue
        out += _merge(short, "", size, overlap, length)
        short = []
        out += split_recursive(p, size, overlap, length, finer)
    return out + _merge(short, "", size, overlap, length)


def _overlapped(sections: list[str], overlap: int) -> list[str]:
    n = int(overlap * 0.75)
    for i in range(1, len(sections)):
        tail = sections[i - 1].split()[-n:] if n else []
        if tail:
            sections[i] = " ".join(tail) + "\n" + sections[i]
    return sections


def regroup(pieces: list[str], size: int, length: Callable[[str], int] = len) -> list[str]:
    """Neighbouring pieces joined by line feeds while their lengths add up to at most ``size``."""
    groups: list[list[str]] = []
    total = 0
    for p in pieces:
        n = length(p)
        if groups and total + n <= size:
            groups[-1].append(p)
            total += n
        else:
            groups.append([p])
            total = n
    return ["\n".join(g) for g in groups]


def split_markdown(text: str | None, size: int, overlap: int, length: Callable[[str], int] = len) -> list[str]:
    """Sections at # to #### headers outside code fences, overlapped, split to ``size``, regrouped."""
    starts, fenced, at = [0], False, 0
    for line in (text or "").splitlines(keepends=True):
        if line.lstrip().startswith(("```", "~~~")):
            fenced = not fenced
        elif not fenced and re.match(r"#{1,4} ", line):
            starts.append(at)
        at += len(line)
    sections = [s for a, b in zip(starts, [*starts[1:], at]) if (s := (text or "")[a:b].strip())]
    sections = _overlapped(sections, overlap) if overlap > 0 else sections
    return regroup([c for s in sections for c in split_recursive(s, size, overlap, length)], size, length)


def word_length(text: str) -> int:
    return len(text.split())


LENGTHS: dict[str, Callable[[str], int]] = {"characters": len, "words": word_length}
_TOKENIZERS: dict[str, tuple] = {}
OTHER_SPACE, WORDS = re.compile(r"\s\s|[^\S \n]|\u180e"), re.compile(r"[ \n]?[^ \n]+|[ \n]")
KEPT_LENGTH, KEPT = 48, 500_000  # characters of a text whose tokens are counted once in a worker, and how many of those are kept


def _word_by_word(tokenizer) -> bool:
    """Whether a text's tokens are those of its words, each with the white space character before it: byte-level, cut by the usual pattern first."""
    import json

    spec = json.loads(tokenizer.to_str())
    cut, added = spec["pre_tokenizer"] or {}, spec["added_tokens"]
    plain = all(not (a["lstrip"] or a["rstrip"] or a["single_word"]) and not re.search(r"\s", a["content"]) for a in added)
    whole = spec["normalizer"] is None and spec["truncation"] is None and spec["padding"] is None
    return plain and whole and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut["add_prefix_space"]


def token_length(tokenizer_file: str) -> Callable[[str], int]:
    """Length in a model's tokens, by its tokenizer file; loaded once in each worker.

    A worker keeps the lengths of words, which come again and again. Where the tokenizer cuts texts before each space and line feed anyway (and
    these stand alone), a text's length is the sum over its words; any other text is encoded as a whole.
    """

    def length(text: str) -> int:
        if tokenizer_file not in _TOKENIZERS:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(tokenizer_file)
            _TOKENIZERS[tokenizer_file] = tokenizer, {}, _word_by_word(tokenizer)
        tokenizer, known, by_words = _TOKENIZERS[tokenizer_file]

        def encoded(text: str) -> int:
            n = len(tokenizer.encode(text, add_special_tokens=False))
            if len(text) <= KEPT_LENGTH:
                if len(known) >= KEPT:
                    known.clear()
                known[text] = n
            return n

        n = known.get(text)
        if n is not None:
            return n
        if not by_words or OTHER_SPACE.search(text):
            return encoded(text)
        return sum(encoded(w) if (n := known.get(w)) is None else n for w in WORDS.findall(text))

    return length


def measure_of(length: str) -> Callable[[str], int]:
    """``characters``, ``words``, or the tokens of a tokenizer file (a path that ends with .json)."""
    return token_length(length) if length.endswith(".json") else LENGTHS[length]


def with_length(rows: DataFrame, *, length: str = "words", text: str = "chunk", name: str = "n") -> DataFrame:
    """``rows`` with the length of each text; null is empty."""
    small_batches(rows.sparkSession)
    measure = measure_of(length)

    @F.pandas_udf("long")
    def measured(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: measure(t or "")).astype("int64")

    return rows.withColumn(name, measured(text))


def length_totals(rows: DataFrame, by: str, *, length: str = "words", text: str = "chunk") -> DataFrame:
    """The summed length of each group's texts: by, n."""
    return with_length(rows.select(by, text), length=length, text=text).groupBy(by).agg(F.sum("n").alias("n"))


def chunk_with(docs: DataFrame, splitter: str, *, size: int = 200, overlap: int = 20, length: str = "characters", keep: tuple[str, ...] = ("doc_id",), min_length: int = 3) -> DataFrame:
    """Chunks of a registered splitter: keep, chunk_no, chunk; chunks of up to ``min_length`` characters go."""
    if splitter not in SPLITTERS:
        raise ValueError(f"unknown splitter {splitter!r}; there are {sorted(SPLITTERS)} and 'semantic' (semantic_chunks)")
    small_batches(docs.sparkSession)
    split, measure = SPLITTERS[splitter], measure_of(length)

    @F.pandas_udf("array<string>")
    def chunks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([split(t, size, overlap, measure) for t in texts])

    rows = docs.select(*keep, F.posexplode(chunks("text")).alias("chunk_no", "chunk"))
    return long_enough(rows, min_length)


SPLITTERS: dict[str, Callable[..., list[str]]] = {"recursive": split_recursive, "markdown": split_markdown}


def long_enough(chunks: DataFrame, min_length: int = 3) -> DataFrame:
    return chunks.filter(F.length(T.strip(F.col("chunk"))) > min_length)


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[.?!])\s+"), lambda s: s != "")


def semantic_chunks(docs: DataFrame, embed: Callable[[Column], Column], *, percentile: float = 0.85, min_size: int = 1000, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Sentences with one neighbour on each side are embedded; a chunk ends where the cosine distance to the next exceeds the document's percentile and it has ``min_size`` characters."""
    doc = Window.partitionBy(*keep).orderBy("i")
    rows = docs.select(*keep, F.posexplode(sentences(F.col("text"))).alias("i", "sentence"))
    rows = rows.withColumn("group", F.concat_ws(" ", F.lag("sentence").over(doc), "sentence", F.lead("sentence").over(doc)))
    rows = rows.withColumn("vector", embed(F.col("group")))
    rows = rows.withColumn("distance", 1 - V.cosine(F.col("vector"), F.lead("vector").over(doc)))
    rows = rows.withColumn("limit", F.percentile("distance", F.lit(percentile)).over(Window.partitionBy(*keep)))
    rows = rows.withColumn("cut", F.coalesce(F.col("distance") > F.col("limit"), F.lit(False)))
    listed = rows.groupBy(*keep).agg(F.array_sort(F.collect_list(F.struct("i", "sentence", "cut"))).alias("s"))
    # a fold over a document's sentences: (finished chunks, the one being filled)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, x: Column) -> Column:
        grown = F.concat(acc["open"], F.when(acc["open"] == "", "").otherwise(" "), x["sentence"])
        full = x["cut"] & (F.length(grown) >= min_size)
        return F.struct(F.when(full, F.concat(acc["done"], F.array(grown))).otherwise(acc["done"]).alias("done"), F.when(full, "").otherwise(grown).alias("open"))

    folded = F.aggregate("s", start, step, lambda acc: F.filter(F.concat(acc["done"], F.array(acc["open"])), lambda c: c != ""))
    return long_enough(listed.select(*keep, F.posexplode(folded).alias("chunk_no", "chunk")))


def pages(chunks: DataFrame, *, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Chunks with page (where they start) and page_end, carried over chunks without a marker.

    A marker [PAGE_n] ends page n. Run this before dropping short chunks: they move the page on too. A chunk that ends
    with a marker ends on its page, and a chunk without a marker that follows is put on that page as well.
    """
    found = F.expr(r"transform(regexp_extract_all(chunk, '\\[PAGE_(\\d+)\\]', 1), x -> cast(x as int))")
    last = F.element_at(found, -1)
    ends = F.endswith(F.col("chunk"), F.concat(F.lit("[PAGE_"), last.cast("string"), F.lit("]")))
    own_end = F.when(F.size(found) > 0, last + F.when(ends, 0).otherwise(1))
    rows = chunks.withColumn("_end", own_end)
    before = Window.partitionBy(*keep).orderBy("chunk_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_prev", F.coalesce(F.last("_end", ignorenulls=True).over(before), F.lit(1)))
    starts = F.startswith(F.col("chunk"), F.concat(F.lit("[PAGE_"), F.element_at(found, 1).cast("string"), F.lit("]")))
    page = F.when((F.size(found) > 0) & starts, F.element_at(found, 1) + 1).otherwise(F.col("_prev"))
    return rows.withColumn("page", page).withColumn("page_end", F.coalesce("_end", "_prev")).drop("_end", "_prev")


def with_context(chunks: DataFrame, *, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Chunks with prev_chunk ('' for the first) and first_chunks (the document's first four, joined by line feeds)."""
    doc = Window.partitionBy(*keep).orderBy("chunk_no")
    first = Window.partitionBy(*keep).orderBy("chunk_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    head = [F.nth_value("chunk", i).over(first) for i in (1, 2, 3, 4)]
    return chunks.withColumn("prev_chunk", F.lag("chunk", 1, "").over(doc)).withColumn("first_chunks", F.concat_ws("\n", *head)).withColumn("n_chunks", F.count(F.lit(1)).over(first))


def contextualise(chunks: DataFrame, context: Callable[[Column, Column, Column, Column], Column], *, source: str = "source", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """with_context rows whose chunk is prefixed by a model's context; documents of one chunk and failed contexts stay plain."""
    rows = with_context(chunks, keep=keep)
    said = F.coalesce(context(F.col(source), F.col("first_chunks"), F.col("prev_chunk"), F.col("chunk")), F.lit(""))
    whole = F.concat(F.lit("Context: "), said, F.lit("\n\nChunk: "), F.col("chunk"))
    return rows.withColumn("chunk", F.when(F.col("n_chunks") < 2, F.col("chunk")).otherwise(whole))


def finished(chunks: DataFrame, *, context: Callable[[Column, Column, Column, Column], Column] | None = None, source: str = "source", keep: tuple[str, ...] = ("doc_id",), min_length: int = 3) -> DataFrame:
    """All chunks of documents as they are stored: page, then context, then without those of up to ``min_length`` characters.

    Short chunks still move the page on, and are the context of their neighbours. ``context`` is a model's (see contextualise).
    """
    rows = pages(chunks, keep=keep).withColumn("_plain", F.col("chunk"))
    rows = contextualise(rows, context, source=source, keep=keep) if context is not None else rows
    return rows.filter(F.length(T.strip(F.col("_plain"))) > min_length).drop("_plain", "page_end", "prev_chunk", "first_chunks", "n_chunks")


def regroup_chunks(chunks: DataFrame, size: int, *, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Neighbouring chunks joined by line feeds while their lengths add up to at most ``size``: a fold inside the JVM."""
    listed = chunks.groupBy(*keep).agg(F.array_sort(F.collect_list(F.struct("chunk_no", "chunk"))).alias("c"))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"), F.lit(0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        n = F.length(x["chunk"])
        fits = acc["open"].isNotNull() & (acc["n"] + n <= size)
        done = F.when(fits | acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))
        grown = F.when(fits, F.concat(acc["open"], F.lit("\n"), x["chunk"])).otherwise(x["chunk"])
        return F.struct(done.alias("done"), grown.alias("open"), F.when(fits, acc["n"] + n).otherwise(n).alias("n"))

    folded = F.aggregate("c", start, step, lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))
    return listed.select(*keep, F.posexplode(folded).alias("chunk_no", "chunk"))
