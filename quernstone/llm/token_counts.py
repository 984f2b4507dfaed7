"""Token counts by heap-and-linked-list byte-pair merging, without emitting identifiers.

For a SentencePiece BPE model: the symbols of a text are its characters; the heap holds adjacent pairs whose joined
text is a piece, and the pair with the best score (the leftmost among equals) is popped and merged until none is
left. The count is the initial symbols minus the merges, plus the further bytes of characters that have no piece
(byte fallback). A pair can only merge inside a stretch that no piece crosses: pieces hold the space mark at their
start or as runs, and none holds a line feed, so stretches from a space (run) to the next are merged on their own
and their counts are kept in a bounded cache per worker. Likewise closing punctuation is cut off where no piece holds
a letter before it. ``Merger`` checks these facts on the model it loads.

Defined cases: null and empty texts have 0 tokens; special strings inside a text are ordinary text, as the library
treats them by default; repeated rows are counted each; a text that is one very long stretch costs n log n.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.text import CASED, LINE_SPACE, HashMemo, column_words
from quernstone.runtime import small_batches

MARK = "▁"
CACHE = 100_000  # entries of a generation; the one before stays readable
CACHE_KEYS = 2_000_000  # stretches as they stand, by hash
CACHED_CHARS = 64  # longer stretches are merged each time


class Merger:
    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = model.get_piece_size()
        special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
        scores = {model.id_to_piece(i): model.get_score(i) for i in range(n) if not special(i)}
        order = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {p: order[s] for p, s in scores.items()}
        self.bytes = any(model.is_byte(i) for i in range(n))
        if any(MARK in p.lstrip(MARK) or ("\n" in p and len(p) > 1) for p in self.rank):
            raise ValueError("a piece crosses a space or a line: texts can't be cut there")
        self.line = 1 if self.bytes or "\n" in self.rank else None
        if self.line is None:
            raise ValueError("line feeds have no piece of their own")
        self.cache: list[dict[str, int]] = [{}, {}]  # of stretches without and with a mark before them
        self.older: list[dict[str, int]] = [{}, {}]
        self.memo = HashMemo(CACHE_KEYS)
        joined = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        self.closing = "".join(c for c in ".,;:!?|*#$%&" if not any(x[1] == c and (x[0].isalnum() or x[0] == MARK) for x in joined))

    def merge(self, symbols: str) -> int:
        """The tokens of one stretch."""
        rank, n = self.rank, len(symbols)
        text: list[str | None] = list(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := rank.get(symbols[i : i + 2])) is not None]
        heapify(heap)
        merges = 0
        while heap:
            _, i, size = heappop(heap)
            left = text[i]
            if left is None or (j := after[i]) >= n or len(left) + len(text[j]) != size:
                continue  # one of the two has changed since
            text[i] = left = left + text[j]
            text[j] = None
            after[i] = k = after[j]
            merges += 1
            if k < n:
                before[k] = i
                if (r := rank.get(left + text[k])) is not None:
                    heappush(heap, (r, i, size + len(text[k])))
            if (h := before[i]) >= 0 and (r := rank.get(text[h] + left)) is not None:
                heappush(heap, (r, h, len(text[h]) + size))
        extra = sum(len(c.encode("utf-8", "surrogatepass")) - 1 for c in text if c is not None and len(c) == 1 and c not in rank) if self.bytes else 0
        return n - merges + extra

    def _stretch(self, part: str, marked: bool) -> int:
        """The tokens of a stretch that the cache doesn't have as it is."""
        core = part.rstrip(self.closing)
        if core != part and core and core[-1].isalnum():
            return self._cached(core, marked) + self._cached(part[len(core) :], False)
        return self._cached(part, marked)

    def _cached(self, part: str, marked: bool) -> int:
        if len(part) > CACHED_CHARS:
            return self.merge(MARK + part if marked else part)
        cache = self.cache[marked]
        got = cache.get(part)
        if got is None:
            if len(cache) >= CACHE:
                self.older[marked], self.cache[marked] = cache, (cache := {})
            got = self.older[marked].get(part)
            cache[part] = got = self.merge(MARK + part if marked else part) if got is None else got
        return got

    def count(self, text: str | None) -> int:
        """The tokens of a whole text."""
        if not text:
            return 0
        total, cache, stretch = 0, self.cache[True], self._stretch
        for k, line in enumerate(text.replace(MARK, " ").split("\n")):
            parts = line.split(" ")
            if k:
                total += self.line
                total += stretch(parts[0], False) if parts[0] else 0
                parts = parts[1:]
            if "" not in parts:
                for p in parts:
                    got = cache.get(p)
                    total += stretch(p, True) if got is None else got
                continue
            run = 0  # marks before the stretch that follows
            for p in parts:
                run += 1
                if p:
                    total += stretch(p, True) if run == 1 else self.merge(MARK * run + p)
                    run = 0
            total += self.merge(MARK * run) if run else 0
        return total


    def count_column(self, texts: pa.Array) -> np.ndarray:
        """The tokens of each text of a column.

        Texts whose words stand between single spaces and line feeds are counted by array operations: each distinct
        stretch of a piece of the column is looked up once, by its hash. The others take ``count``.
        """
        w = column_words(texts, LINE_SPACE, CASED)
        raw, offsets = w.raw, w.offsets
        tokens = np.zeros(len(w.starts), dtype=np.int64)
        if len(w.starts):
            begins = np.zeros(len(raw) + 1, dtype=bool)
            begins[offsets] = True
            marked = begins[w.starts] | (raw[w.starts - 1] == 32)
            keys = w.hashes ^ (marked.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            distinct, at, inverse = np.unique(keys, return_index=True, return_inverse=True)
            counts, found = self.memo.find(distinct)
            new = np.flatnonzero(~found)
            if len(new):
                data = raw.tobytes()
                places = zip(w.starts[at[new]].tolist(), w.ends[at[new]].tolist(), marked[at[new]].tolist())
                counts[new] = [self._stretch(data[a:b].decode("utf-8", "replace"), m) for a, b, m in places]
                self.memo.add(distinct[new], counts[new])
            tokens = counts[inverse]
        out = w.per_text(tokens) + np.diff(np.searchsorted(np.flatnonzero(raw == 10), offsets)) * self.line
        # runs of spaces, spaces or line feeds at a border, and space marks in the text itself
        blank = raw == 32
        after, before = np.append(LINE_SPACE[raw[1:]], True), np.zeros(len(raw), dtype=bool)
        after[offsets[(offsets > 0) & (offsets < len(raw))] - 1] = True
        first = offsets[:-1][np.diff(offsets) > 0]
        before[first] = True
        odd = np.concatenate([np.flatnonzero(blank & (after[: len(raw)] | before)), first[raw[first] == 10]])
        mark = np.flatnonzero(raw == 0x96)
        mark = mark[(mark > 0) & (mark < len(raw) - 1)]
        mark = mark[(raw[mark - 1] == 0xE2) & (raw[mark + 1] == 0x81)]
        for i in np.unique(np.searchsorted(offsets, np.concatenate([odd, mark]), side="right") - 1).tolist():
            out[i] = self.count(raw[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
        return out


_MERGERS: dict[str, Merger] = {}


def merger(model_file: str) -> Merger:
    """One per worker process, so that caches last over tasks."""
    if model_file not in _MERGERS:
        _MERGERS[model_file] = Merger(model_file)
    return _MERGERS[model_file]


def count_tokens(docs: DataFrame, model_file: str, *, text_col: str = "text", limit: int = 4096) -> DataFrame:
    """``docs`` with n_bytes, n_tokens (long) and over_limit (n_tokens > limit); no shuffle."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = merger(model_file).count_column
        for texts in batches:
            yield pd.Series(count(pa.array(texts, pa.large_string())), dtype="int64")

    n = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    return docs.withColumn("n_bytes", n).withColumn("n_tokens", counted(text_col)).withColumn("over_limit", F.col("n_tokens") > limit)
