"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is its own hash plus its character n-grams; all share one table of embeddings, so an unseen misspelling
still meets most of its n-grams. A window of consecutive words is the mean of its words' vectors (each the mean of
its n-grams; a word that stands in the window already adds nothing again) and goes through a linear softmax; both layers are trained together. A document scores as its most
toxic window, in training (the gradient goes through that window) and in scoring, so a few lines in a long text count.

Windows cover the whole text: ``WINDOW`` words each, the last one stretched back to full length.

Training begins with one diagonal Newton step over whole documents and goes on with joint AdaGrad epochs (``train``). It takes a bounded sample of labelled rows (``max_rows`` toxic, twice as many others, ``max_chars`` in all, in hash order);
scoring covers every document. As the model is linear in the word vectors, a word adds a fixed amount to its window,
kept in a bounded cache per worker.

Defined cases: null and empty texts score as the softmax's bias alone; without labelled rows of both classes every score is
the share of positive labels (0 if there is none); a label of null is no label; repeated doc_ids are scored each; texts of any length
are scored whole; an empty table gives an empty result; labels of documents that aren't there count for nothing; columns other than doc_id and
text are carried along (``score_documents`` replaces score and predicted, ``keep_clean`` replaces none).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.columns import free_name, own
from quernstone.llm.text import HashMemo, column_words
from quernstone.runtime import small_batches

BUCKETS, DIM, NGRAMS = 1 << 17, 8, (3, 4, 5, 6)
WINDOW = 64
STANDS_OUT = 3  # standard errors from which on a row's first step is taken for more than chance
SMALL = 0.1  # what is left of the other components' first values, so that the first step leads at the start
CACHE = 2_000_000  # words whose margins a worker keeps


def words_of(text: str | None) -> list[str]:
    """Lower-case pieces between ASCII white space, as column_words parts them."""
    return [w.decode() for w in text.lower().encode("utf-8", "replace").split()] if text else []


def ngram_ids(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, starts): the table rows of each word's n-grams and of the word itself, in one flat array."""
    joined = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    owner = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(first + lengths, lengths) - np.arange(len(joined))  # characters up to the word's end
    mixed = (joined + np.uint64(0x9E37)) * np.uint64(0x9E3779B97F4A7C15)
    parts, owners = [], []
    rolling = np.zeros(len(joined), dtype=np.uint64)
    whole = np.zeros(len(joined), dtype=np.uint64)
    whole[1:] = np.cumsum(mixed * (np.arange(len(joined), dtype=np.uint64) * np.uint64(2) + np.uint64(1)), dtype=np.uint64)[:-1]
    for n in range(1, max(NGRAMS) + 1):
        shifted = np.zeros(len(joined), dtype=np.uint64)
        shifted[: len(joined) - n + 1] = mixed[n - 1 :]
        rolling = rolling * np.uint64(0x100000001B3) ^ (shifted + np.uint64(n))
        if n in NGRAMS:
            ok = left >= n
            parts.append(rolling[ok])
            owners.append(owner[ok])
    position = np.arange(len(joined), dtype=np.uint64)
    local = position - np.repeat(first, lengths).astype(np.uint64)
    powers = mixed * (local * np.uint64(2) + np.uint64(1)) ^ (mixed >> np.uint64(29))
    parts.append(np.add.reduceat(powers, first) * np.uint64(0xC2B2AE3D27D4EB4F))
    owners.append(np.arange(len(words)))
    ids, who = np.concatenate(parts), np.concatenate(owners)
    order = np.argsort(who, kind="stable")
    ids = ids[order]
    ids ^= ids >> np.uint64(32)
    ids *= np.uint64(0xD6E8FEB86659FD93)
    ids ^= ids >> np.uint64(29)
    counts = np.bincount(who, minlength=len(words))
    return (ids % np.uint64(BUCKETS)).astype(np.int64), np.concatenate(([0], np.cumsum(counts)[:-1]))


def _all_ngrams(words: list[str], size: int = 10_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(table rows, starts, counts) of many words, made in small parts."""
    parts, counts = [], []
    for i in range(0, len(words), size):
        ids, starts = ngram_ids(words[i : i + size])
        parts.append(ids.astype(np.int32))
        counts.append(np.diff(np.append(starts, len(ids))))
    per_word = np.concatenate(counts)
    return np.concatenate(parts), np.cumsum(per_word) - per_word, per_word


@dataclass
class Model:
    table: np.ndarray  # BUCKETS x DIM
    top: np.ndarray  # DIM x 2
    bias: np.ndarray  # 2
    prior: float | None = None  # the score of everything, where there was nothing to learn
    _memo: HashMemo = field(default_factory=lambda: HashMemo(CACHE), repr=False)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_memo"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._memo = HashMemo(CACHE)

    def margins(self, words: list[str]) -> np.ndarray:
        """What each word adds to the mean logit difference of its window."""
        if not hasattr(self, "_row"):
            self._row = self.table @ (self.top[:, 1] - self.top[:, 0])
        out = []
        for i in range(0, len(words), 5000):
            ids, starts = ngram_ids(words[i : i + 5000])
            out.append(np.add.reduceat(self._row[ids], starts) / np.diff(np.append(starts, len(ids))))
        return np.concatenate(out)

    def score_column(self, texts: pa.Array) -> np.ndarray:
        """The score of each text of a column; distinct words are looked up once."""
        if self.prior is not None:
            return np.full(len(texts), self.prior)
        w = column_words(pa.compute.utf8_lower(texts))
        values = np.zeros(len(w.hashes))
        if len(w.hashes):
            keys, first, inverse = np.unique(w.hashes, return_index=True, return_inverse=True)
            known, found = self._memo.find(keys)
            new = np.flatnonzero(~found)
            if len(new):
                data = w.raw.tobytes()
                made = self.margins([data[a:b].decode("utf-8", "replace") for a, b in zip(w.starts[first[new]].tolist(), w.ends[first[new]].tolist())])
                known[new] = made.view(np.int64)
                self._memo.add(keys[new], known[new])
            values = known.view(np.float64)[inverse]
        best, at = np.zeros(len(w.sizes)), 0
        for i, n in enumerate(w.sizes.tolist()):
            if n:
                best[i] = window_means(values[at : at + n], *counted(previous(w.hashes[at : at + n]))).max()
            at += n
        return 1.0 / (1.0 + np.exp(-np.clip(best + self.bias[1] - self.bias[0], -60, 60)))

    def score(self, text: str | None) -> float:
        return float(self.score_column(pa.array([text], pa.string()))[0])


def window_starts(n: int) -> np.ndarray:
    """Starts of windows of WINDOW words, half overlapping, that cover n words; the last ends at the end."""
    if n <= WINDOW:
        return np.zeros(1, dtype=np.int64)
    return np.append(np.arange(0, n - WINDOW, WINDOW // 2), n - WINDOW)


def previous(codes: np.ndarray) -> np.ndarray:
    """The place where each word stood last before, -1 if nowhere."""
    order = np.argsort(codes, kind="stable")
    out = np.full(len(codes), -1, dtype=np.int64)
    same = codes[order[1:]] == codes[order[:-1]]
    out[order[1:][same]] = order[:-1][same]
    return out


def counted(before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of the windows in which each word counts: those that hold it and start after the place ``before``
    where it stood last, so that a window counts each of its words once."""
    n = len(before)
    starts, at = window_starts(n), np.arange(n)
    return np.searchsorted(starts, np.maximum(before, at - min(WINDOW, n)), side="right"), np.searchsorted(starts, at, side="right")


def window_means(values: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    windows = len(window_starts(len(values)))
    change = np.bincount(first, values, windows + 1) - np.bincount(end, values, windows + 1)
    return np.cumsum(change[:windows]) / min(WINDOW, len(values))


def newton_step(docs: list[np.ndarray], y: np.ndarray, share: float, ids: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each table row the step of a logistic loss at its start, gradient over curvature, on the row's presence in whole documents.

    A step within ``STANDS_OUT`` standard errors of none (gradient over the root of the curvature) is not taken.
    """
    gradient, curvature = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for d, label in zip(docs, y.tolist()):
        words = np.unique(d)
        per_word = counts[words]
        before = np.cumsum(per_word) - per_word
        seen = np.zeros(BUCKETS, dtype=bool)
        seen[ids[np.repeat(starts[words] - before, per_word) + np.arange(per_word.sum())]] = True
        gradient += seen * (label - share)
        curvature += seen * (share * (1 - share))
    clear = np.abs(gradient) >= STANDS_OUT * np.sqrt(np.maximum(curvature, 1e-9))
    return np.where(clear, gradient / (curvature + 0.25), 0.0)


def train(texts: list[str | None], labels: list[int], *, epochs: int = 6, batch: int = 32, rate: float = 0.2, seed: int = 7, first: float = 16.0, step: float = 2.0) -> Model:
    """Gradient epochs on the table and the softmax together.

    The vectors start small and random but for their first component, which starts at 0 and has weight ``first`` in the softmax. In the first
    epoch it takes ``step`` times its ``newton_step`` over whole documents, as nothing tells yet which windows count; the other
    epochs are joint AdaGrad steps of all components and of the softmax through each document's most toxic window. Without epochs nothing is learned.
    """
    y = np.array(labels, dtype=np.int64)
    share = float(y.mean()) if len(y) else 0.0
    rng = np.random.default_rng(seed)
    model = Model(rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)), rng.uniform(-1, 1, (DIM, 2)), np.zeros(2))
    if len(y) == 0 or share in (0.0, 1.0):
        model.prior = share
        return model
    vocabulary: dict[str, int] = {}
    docs = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t)] or [vocabulary.setdefault("", len(vocabulary))], dtype=np.int32) for t in texts]
    ids, starts, counts = _all_ngrams(list(vocabulary))
    del vocabulary
    model.table *= SMALL
    model.table[:, 0] = step * newton_step(docs, y, share, ids, starts, counts) if epochs else 0.0
    model.top[0] = (-first, first)
    model.bias[:] = np.log([1 - share, share]) / 2
    befores = [previous(d).astype(np.int32) for d in docs]
    squares = [np.full(model.table.shape[0], 1e-3), np.full(model.top.shape, 1e-3), np.full(2, 1e-3)]
    for _ in range(epochs - 1):
        margin = np.add.reduceat((model.table @ (model.top[:, 1] - model.top[:, 0]))[ids], starts) / counts
        bags, widths = [], []
        for d, before in zip(docs, befores):
            at = window_starts(len(d))[int(np.argmax(window_means(margin[d], *counted(before))))] if len(d) > WINDOW else 0
            one = d[at : at + WINDOW]
            bags.append(one[before[at : at + WINDOW] < at])
            widths.append(len(one))
        order = rng.permutation(len(docs))
        for lo in range(0, len(order), batch):
            some = order[lo : lo + batch]
            words = np.concatenate([bags[i] for i in some])
            sizes, wide = np.array([len(bags[i]) for i in some]), np.array([widths[i] for i in some])
            per_word = counts[words]
            offsets = np.concatenate(([0], np.cumsum(per_word)))
            flat = ids[np.repeat(starts[words] - offsets[:-1], per_word) + np.arange(offsets[-1])]
            vectors = np.add.reduceat(model.table[flat], offsets[:-1], axis=0) / per_word[:, None]
            hidden = np.add.reduceat(vectors, np.concatenate(([0], np.cumsum(sizes)[:-1])), axis=0) / wide[:, None]
            logits = hidden @ model.top + model.bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(some)), y[some]] -= 1.0
            back = p @ model.top.T  # to the hidden layer
            step = p.T
            for value, grad, square in ((model.top, hidden.T @ p / len(some), squares[1]), (model.bias, step.mean(axis=1), squares[2])):
                square += grad**2
                value -= rate / 5 * grad / np.sqrt(square)
            share_of = np.repeat(back / wide[:, None], sizes, axis=0) / per_word[:, None]
            grads = np.repeat(share_of, per_word, axis=0)
            rows, inverse = np.unique(flat, return_inverse=True)
            summed = np.stack([np.bincount(inverse, grads[:, k], len(rows)) for k in range(DIM)], axis=1)
            squares[0][rows] += (summed**2).mean(axis=1)
            model.table[rows] -= rate * summed / np.sqrt(squares[0][rows])[:, None]
    return model


def training_sample(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", max_rows: int = 3000, max_chars: int = 14_000_000) -> pd.DataFrame:
    """At most ``max_rows`` labelled toxic documents and twice as many others, first in hash order.

    ``max_chars`` bounds their characters, two sevenths for the toxic ones (with more, the bias alone nears the threshold); a text that no longer fits is passed over.
    """
    marked = labels.filter(F.col(label).isNotNull()).select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y"))
    marked = marked.groupBy("_id").agg(F.max("_y").alias("_y"))  # a document marked twice counts as its higher mark
    there = docs.select(F.col("doc_id").alias("_id")).join(marked, "_id").withColumn("_h", F.xxhash64("_id"))
    out = []
    for y, rows, chars in ((1, max_rows, max_chars * 2 // 7), (0, 2 * max_rows, max_chars * 5 // 7)):
        drawn = there.filter(F.col("_y") == y).orderBy("_h", "_id").limit(rows).distinct()  # a bounded table, so texts aren't shuffled
        pool = docs.select("doc_id", "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("_id")).select("_h", "text", F.coalesce(F.length("text"), F.lit(0)).alias("_n"))
        got, total = [], 0
        for r in pool.filter(F.col("_n") <= chars).orderBy("_h", "text").limit(rows).toLocalIterator():
            if total + r._n <= chars:
                total += r._n
                got.append(r.text)
        out.append(pd.DataFrame({"text": got, "y": y}))
    return pd.concat(out, ignore_index=True)


def score_column_of(docs: DataFrame, model: Model) -> Column:
    """The score of each whole text of ``docs``."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # BUCKETS x DIM numbers, whatever the input

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(shared.value.score_column(pa.array(texts, pa.string())))

    return scored("text")


def score_documents(docs: DataFrame, model: Model, *, threshold: float = 0.3) -> DataFrame:
    """``docs`` with score (double) and predicted (1 if score >= threshold), which replace columns of these names."""
    return docs.withColumn("score", score_column_of(docs, model)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(docs: DataFrame, model: Model, *, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns, whatever their names."""
    name = free_name(docs, "toxicity_score")
    return docs.withColumn(name, score_column_of(docs, model)).filter(F.col(name) < threshold).select(*own(docs))


def learn(docs: DataFrame, labels: DataFrame, **options) -> Model:
    """The model for ``docs`` and ``labels``; callers leave held-out rows out of ``labels``."""
    fit = {k: options.pop(k) for k in ("epochs", "batch", "rate", "seed", "first", "step") if k in options}
    sample = training_sample(docs, labels, **options)
    return train(sample["text"].tolist(), sample["y"].astype(int).tolist(), **fit)
