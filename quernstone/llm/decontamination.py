"""Benchmark decontamination by one Aho-Corasick automaton over word windows of all test items.

Items and documents are normalised to words (A-Z lowered; runs of letters, digits and non-ASCII characters). Every
window of ``window`` words of an item is a pattern; an item of fewer words is one pattern. The automaton reads word
numbers instead of characters, so a text is scanned once, word by word, and a match ends at a word; words that no item
has can't match. Word numbers map back to places in the original text (``spans``).

The items are a test set: small next to the corpus. Automata are built on the driver from at most ``max_words`` of their words each; a pass sends
automata of ``PASS_WORDS`` words together to the workers, which scan each in turn over the same batch. Items of more words take further passes
over the documents, so neither the driver nor a worker ever holds more than one pass; their matches, rows of hit documents alone, are put
together afterwards.

Defined cases: null and empty texts have no words and no hits; texts of any length are scanned whole; items without words are ignored; a window
that several items share counts for each; repeated items with one id count once; a null item_id hits, but isn't listed or counted; without items
nothing is hit; repeated documents are rows of their own; columns of any name are kept, those named like a result give way to it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.columns import free_name, own
from quernstone.runtime import small_batches, staged

#: Bytes that part words: ASCII other than digits and letters.
BREAKS = bytes(i if 0x30 <= i <= 0x39 or 0x61 <= i <= 0x7A or i >= 0x80 else i + 32 if 0x41 <= i <= 0x5A else 32 for i in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
RAW_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(BREAKS).split()


class Matcher:
    """The automaton of some items: (item_id or None, text)."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        patterns: dict[tuple[int, ...], set] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                patterns.setdefault(tuple(ids[i : i + window]), set()).add(item)
        self.patterns = [(k, sorted(v - {None})) for k, v in patterns.items()]
        self._automaton = None

    def __getstate__(self) -> dict:
        return {"vocabulary": self.vocabulary, "patterns": self.patterns, "_automaton": None}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state

    @property
    def automaton(self):
        """Built once per worker: the pickled form is just the patterns."""
        if self._automaton is None and self.patterns:
            self._automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for k, v in self.patterns:
                self._automaton.add_word(k, (len(k), v))
            self._automaton.make_automaton()
        return self._automaton

    def scan(self, words: list[bytes]) -> list[tuple[int, int, list]]:
        """(first word, word after the last, item ids) of each match."""
        if not words or self.automaton is None:
            return []
        get = self.vocabulary.get
        return [(end + 1 - n, end + 1, items) for end, (n, items) in self.automaton.iter(tuple([get(w, 0) for w in words]))]


def merge(matches: list[tuple[int, int, list]]) -> list[tuple[int, int]]:
    """Disjoint word ranges that cover the matches."""
    out: list[list[int]] = []
    for a, b, _ in sorted(matches, key=lambda m: m[:2]):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets in the original text of word ranges."""
    places = [m.span() for m in RAW_WORD.finditer(text)]
    return [(places[a][0], places[b - 1][1]) for a, b in ranges]


PASS_WORDS = 5_000_000  # of items, in the automata of one pass


def passes(benchmark: DataFrame, window: int, max_words: int, pass_words: int) -> Iterator[list[Matcher]]:
    """The automata of all items by passes: each of at most ``max_words`` words, a pass of at most ``pass_words`` (or one item)."""
    out, held, n, total = [], [], 0, 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null").orderBy("item_id", "text").toLocalIterator():
        k = len(words_of(r.text))
        if held and (n + k > max_words or total + k > pass_words):
            out.append(Matcher(held, window))
            held, n = [], 0
        if out and total + k > pass_words:
            yield out
            out, total = [], 0
        held.append((r.item_id, r.text))
        n, total = n + k, total + k
    if held:
        out.append(Matcher(held, window))
    if out:
        yield out


RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, items array<long>, spans array<struct<start:int,end:int>>"


def _raw(words: list[bytes], matchers: list[Matcher]) -> tuple[list[tuple[int, int]], list]:
    """(disjoint word ranges, item ids) of a text's matches."""
    found = [m for matcher in matchers for m in matcher.scan(words)]
    return merge(found), sorted({i for m in found for i in m[2]}, key=str)


def _row(text: str | None, n_words: int, ranges: list[tuple[int, int]], items: list) -> tuple:
    digest = sha256(",".join(map(str, items)).encode()).hexdigest()
    return n_words, sum(b - a for a, b in ranges), len(items), digest, items, [{"start": a, "end": b} for a, b in spans(text, ranges)] if ranges else []


def overlap_column(docs: DataFrame, matchers: list[Matcher]) -> Column:
    """n_words, n_hit, n_items, items_sha256, items and spans of each text of ``docs``, as one struct."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(matchers)  # one pass

    @F.pandas_udf(RESULT)
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                words = words_of(text)
                rows.append(_row(text, len(words), *_raw(words, shared.value)))
            yield pd.DataFrame(rows, columns=["n_words", "n_hit", "n_items", "items_sha256", "items", "spans"])

    return scanned("text")


def _pass(docs: DataFrame, row: str, matchers: list[Matcher]) -> DataFrame:
    """(row, ranges, items) of the documents that a pass hits, written once."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(matchers)

    @F.pandas_udf("ranges array<struct<a:int,b:int>>, items array<long>")
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = [_raw(words_of(t), shared.value) for t in texts]
            yield pd.DataFrame({"ranges": [[{"a": a, "b": b} for a, b in r] for r, _ in found], "items": [i for _, i in found]})

    out = staged(docs.select(F.col(row), scanned("text").alias("x")).filter(F.size("x.ranges") > 0).select(row, "x.ranges", "x.items"), "pass")
    shared.unpersist()
    return out


def with_overlaps(docs: DataFrame, benchmark: DataFrame, hit: str, window: int, max_words: int, pass_words: int) -> DataFrame:
    """``docs`` with the struct ``hit`` (RESULT) of each text."""
    parts = passes(benchmark, window, max_words, pass_words)
    first, second = next(parts, []), next(parts, None)
    if second is None:
        return docs.withColumn(hit, overlap_column(docs, first))
    row = free_name(docs, "row")
    rows = staged(docs.withColumn(row, F.monotonically_increasing_id()), "documents")
    found = None
    for matchers in chain((first, second), parts):
        part = _pass(rows, row, matchers)
        found = part if found is None else found.unionAll(part)
    both = found.groupBy(row).agg(F.flatten(F.collect_list("ranges")).alias("ranges"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    met = free_name(rows, "met")
    joined = rows.join(both.select(F.col(row), F.struct("ranges", "items").alias(met)), row, "left")

    @F.pandas_udf(RESULT)
    def told(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, ranges, items in batches:
            rows = []
            for text, r, i in zip(texts, ranges, items):
                words = len(words_of(text))
                rows.append(_row(text, words, [] if r is None else merge([(x["a"], x["b"], []) for x in r]), [] if i is None else sorted((int(x) for x in i), key=str)))
            yield pd.DataFrame(rows, columns=["n_words", "n_hit", "n_items", "items_sha256", "items", "spans"])

    return joined.withColumn(hit, told("text", f"{met}.ranges", f"{met}.items")).drop(row, met)


RESULTS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans")


def find_overlaps(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, max_words: int = 500_000, pass_words: int = PASS_WORDS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: ``keep``, n_words, n_hit, n_items, items_sha256, contaminated, items, spans; no shuffle while the items fit one pass.

    ``spans`` are the [start, end) character ranges of the original text that the hits cover. Columns of ``keep`` that are named like
    a result give way to it.
    """
    hit = free_name(docs, "hit")
    out = with_overlaps(docs, benchmark, hit, window, max_words, pass_words)
    made = [(F.col(f"{hit}.n_hit") > 0).alias(c) if c == "contaminated" else F.col(f"{hit}.{c}") for c in RESULTS]
    return out.select(*[c for c in keep if c.lower() not in RESULTS], *made)


def keep_clean(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, max_words: int = 500_000, pass_words: int = PASS_WORDS) -> DataFrame:
    """The rows of ``docs`` without any hit, with all their columns, whatever their names; of repeated rows all stay or all go."""
    hit = free_name(docs, "hit")
    return with_overlaps(docs, benchmark, hit, window, max_words, pass_words).filter(F.col(f"{hit}.n_hit") == 0).select(*own(docs))
