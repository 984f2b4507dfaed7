"""Language-model scoring by a hashed maximum-entropy model with a class-factored softmax.

log P(word | history) = log P(class | history) + log P(word | class). A word's class follows from its ending: endings are
hashed to ``ENDINGS`` codes, and codes with similar neighbours form a class (k-means over the singular vectors of how often
codes follow each other in the training texts). The class softmax is a maximum-entropy model: the word before, the
word two before (a skip), both together and both their classes are hashed to rows of one weight table, and the rows of a
history add up to the classes' logits. Within a class the words seen in training are the leaves of a tree: a word's hash
gives its digits, ``WAYS`` branches each, of as many levels as the vocabulary needs (``DEEPEST`` at most). Each level is a softmax
over the branches with the same history features, hashed together with the node, and with the branches' smoothed counts as base
measure; words that share a leaf part it by their smoothed counts. One unseen word keeps 0.1 of its class's mass. So every word,
seen or not, has a probability that depends on its history, and all of them add up to one.

Counts, of every training token, are made by word hash (64 bits) and summed by Spark. Training is one pass of
distributed gradient updates: each task runs minibatch AdaGrad over its own documents from the same start; the tables
are averaged row by row, each weighted by how often the task met the row, in rounds of at most ``MERGE`` tables. More ``epochs`` repeat that.

Scoring reads each text once in numpy batches. Words among the commonest ``HEAD`` (a threshold from a histogram of
counts keeps them below that) find their counts in a shared array; the others are joined to the count table by hash.

Defined cases: null and empty texts are the end token alone; without any training row counts and N are 0 and classes equally likely;
repeated rows count each; texts of any length are read whole; an empty table gives an empty result; other columns, whatever their names, are carried
along, but for those named like a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.columns import own
from quernstone.llm.text import pieces, word_hashes, word_spans
from quernstone.runtime import small_batches, staged

ENDINGS, CLASSES = 512, 12
ROWS = 1 << 14  # of each feature family in the weight table
FAMILIES = 4
WAYS, DEEPEST = 16, 4  # branches of a tree node, levels below the class
TREE_ROWS = 1 << 16  # of each feature family in the tree's weight table
HEAD = 1 << 19
MERGE, BLOCK_ROWS = 32, 16_384
STEP_TOKENS, CHUNK = 131_072, 2048
END = np.uint64(0xE4D0E4D0E4D0E4D1)
_U = np.uint64


def column_tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts' tokens in a row, each text's end token last: hashes, ending codes, first token and tokens of each text."""
    all_hashes, all_codes, all_sizes = [np.empty(0, dtype=np.uint64)], [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    for raw, offsets in pieces(texts):
        starts, ends, sizes = word_spans(raw, offsets)
        place = np.arange(len(starts)) + np.repeat(np.arange(len(sizes)), sizes)
        total = len(starts) + len(sizes)
        hashes, codes = np.full(total, END), np.zeros(total, dtype=np.int64)
        hashes[place] = word_hashes(raw, starts, ends)
        code = np.zeros(len(starts), dtype=np.int64)
        for k in (1, 2, 3):
            at = ends - k
            byte = raw[np.maximum(at, 0)]
            byte |= ((byte >= 65) & (byte <= 90)) * np.uint8(32)
            code = code * 257 + (byte.astype(np.int64) + 1) * (at >= starts)
        codes[place] = ((code * 0x9E3779B1) >> 7) % (ENDINGS - 1) + 1  # 0 is the end token's
        all_hashes.append(hashes)
        all_codes.append(codes)
        all_sizes.append(sizes + 1)
    sizes = np.concatenate(all_sizes)
    return np.concatenate(all_hashes), np.concatenate(all_codes), np.cumsum(sizes) - sizes, sizes


def cluster(follows: np.ndarray, *, rounds: int = 30, seed: int = 3) -> np.ndarray:
    """The class of each ending code, from the counts of codes that follow each other; the end token has the last class alone."""
    rng = np.random.default_rng(seed)
    total = max(follows.sum(), 1.0)
    both = np.concatenate([follows, follows.T], axis=1)
    expected = both.sum(axis=1, keepdims=True) * both.sum(axis=0, keepdims=True) / total
    lift = np.log(np.maximum((both + 0.5) / (expected + 0.5), 1.0))
    u, s, _ = np.linalg.svd(lift, full_matrices=False)
    points = u[:, : CLASSES * 2] * s[: CLASSES * 2]
    points /= np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-9)
    weight = np.sqrt(both.sum(axis=1)) + 1e-9
    k = CLASSES - 1
    centres = points[rng.choice(len(points), k, replace=False, p=weight / weight.sum())]
    for _ in range(rounds):
        own = (points @ centres.T).argmax(axis=1)
        for c in range(k):
            if (own == c).any():
                centres[c] = np.average(points[own == c], axis=0, weights=weight[own == c])
                centres[c] /= max(np.linalg.norm(centres[c]), 1e-9)
    own[0] = CLASSES - 1
    return own.astype(np.int64)


def features(hashes: np.ndarray, classes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(FAMILIES, tokens) table rows of each token's history; ``first`` are the texts' first tokens."""
    one, c1 = np.roll(hashes, 1), np.roll(classes, 1)
    one[first], c1[first] = _U(1), CLASSES
    two, c2 = np.roll(one, 1), np.roll(c1, 1)
    two[first], c2[first] = _U(2), CLASSES
    rows = np.empty((FAMILIES, len(hashes)), dtype=np.int64)
    rows[0] = one >> _U(50)
    rows[1] = (two & _U(ROWS - 1)) + _U(ROWS)
    rows[2] = (((one + two * _U(3)) * _U(0x9E3779B97F4A7C15)) >> _U(50)) + _U(2 * ROWS)
    rows[3] = 3 * ROWS + (c1 * (CLASSES + 1) + c2)
    return rows


class Tree:
    """Where the words of each class stand in its tree: the mass of every branch, from the mass of the leaves."""

    def __init__(self, leaves: np.ndarray):  # CLASSES x WAYS ** levels
        self.levels = round(np.log(leaves.shape[1]) / np.log(WAYS))
        self.leaves = leaves.astype(np.float32)
        masses = [self.leaves.reshape(CLASSES * WAYS**k, WAYS, -1).sum(axis=2) for k in range(self.levels)]
        self.first = np.cumsum([0, *map(len, masses)])[:-1]  # the first node of each level
        self.mass = np.concatenate(masses)  # of each node's branches
        self.parts = (self.mass > 0).sum(axis=1) > 1  # nodes with something to decide
        self.totals = leaves.sum(axis=1)

    def leaf(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> _U(8)) % _U(WAYS**self.levels)).astype(np.int64)

    def steps(self, hashes: np.ndarray, classes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The decisions on the ways to seen words: (token, rows, branch taken, node) of each."""
        leaf = self.leaf(hashes)
        full = self.leaves[classes, leaf] > 0
        tokens, branches, nodes = [], [], []
        for k in range(self.levels):
            down = leaf // WAYS ** (self.levels - k - 1)
            node = self.first[k] + classes * WAYS**k + down // WAYS
            t = np.flatnonzero(full & self.parts[node])
            tokens.append(t)
            branches.append(down[t] % WAYS)
            nodes.append(node[t])
        token, branch, node = map(np.concatenate, (tokens, branches, nodes))
        place = (node.astype(np.uint64) + _U(1)) * _U(0xC2B2AE3D27D4EB4F)
        rows = np.empty((FAMILIES, len(token)), dtype=np.int64)
        for f in range(FAMILIES):
            mixed = (keys[f][token] ^ place) * _U(0x9E3779B97F4A7C15)
            rows[f] = ((mixed ^ (mixed >> _U(32))) * _U(0xD6E8FEB86659FD93) >> _U(32)) % _U(TREE_ROWS)
            rows[f] += f * TREE_ROWS
        return token, rows, branch, node

    def log_lift(self, table: np.ndarray, hashes: np.ndarray, classes: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """log10 of each word's probability within its class by its history, less that by smoothed counts; 0 for words not seen."""
        token, rows, branch, node = self.steps(hashes, classes, keys)
        lp = np.bincount(token, log_probabilities(table, rows, branch, self.mass, node), len(hashes)) / np.log(10)
        held, all_held = self.leaves[classes, self.leaf(hashes)].astype(np.float64), self.totals[classes]
        return np.where(held > 0, lp + np.log10(np.maximum(all_held, 1e-9)) - np.log10(np.maximum(held, 1e-9)), 0.0)


def histories(hashes: np.ndarray, classes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(FAMILIES, tokens) 64-bit keys of each token's history, of the same families as ``features``."""
    one, c1 = np.roll(hashes, 1), np.roll(classes, 1)
    one[first], c1[first] = _U(1), CLASSES
    two, c2 = np.roll(one, 1), np.roll(c1, 1)
    two[first], c2[first] = _U(2), CLASSES
    pair = (c1 * (CLASSES + 1) + c2 + 1).astype(np.uint64)
    return np.stack([one, two * _U(5), (one + two * _U(3)) * _U(0x9E3779B97F4A7C15), pair * _U(0x9E3779B97F4A7C15)])


def scores(table: np.ndarray, rows: np.ndarray, base: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(logits, their exponentials times the base measure) of each token's classes; weights stay small enough to need no shift."""
    logits = table.take(rows[0], axis=0, mode="clip")
    for k in range(1, FAMILIES):
        logits += table.take(rows[k], axis=0, mode="clip")
    np.clip(logits, -40, 40, out=logits)
    return logits, np.exp(logits) if base is None else np.exp(logits) * base


def log_probabilities(table: np.ndarray, rows: np.ndarray, target: np.ndarray, mass: np.ndarray | None = None, node: np.ndarray | None = None) -> np.ndarray:
    """Natural log of each token's class probability; of its branch's, with the ``mass`` of each ``node``'s branches."""
    out, ones = np.empty(len(target)), np.ones(table.shape[1], dtype=np.float32)
    for at in range(0, len(target), CHUNK):
        part = slice(at, at + CHUNK)
        base = None if mass is None else mass[node[part]]
        logits, e = scores(table, rows[:, part], base)
        each = np.arange(len(logits))
        out[part] = logits[each, target[part]] - np.log(e @ ones)
        if base is not None:
            out[part] += np.log(base[each, target[part]])
    return out


def update(table: np.ndarray, squares: np.ndarray, seen: np.ndarray, rows: np.ndarray, target: np.ndarray, rate: float, rng: np.random.Generator, mass: np.ndarray | None = None, node: np.ndarray | None = None) -> None:
    """One minibatch gradient step.

    The gradient of a row is how often its histories have a class less how often the model expects it; the second part
    is estimated without bias by one class drawn from the model for each token.
    """
    drawn, width, size = np.empty_like(target), table.shape[1], len(table) // FAMILIES
    ones, upto = np.ones(width, dtype=np.float32), np.triu(np.ones((width, width), dtype=np.float32))
    for at in range(0, len(target), CHUNK):
        part = slice(at, at + CHUNK)
        below = scores(table, rows[:, part], None if mass is None else mass[node[part]])[1] @ upto
        level = rng.random(len(below), dtype=np.float32) * below[:, -1]
        drawn[part] = np.minimum((below < level[:, None]).astype(np.float32) @ ones, width - 1)
    for k in range(FAMILIES):
        local = (rows[k] - k * size) * width
        part = slice(k * size, (k + 1) * size)
        grad = (np.bincount(local + drawn, minlength=size * width) - np.bincount(local + target, minlength=size * width)).astype(np.float32).reshape(size, width)
        squares[part] += (grad * grad).mean(axis=1)
        table[part] -= rate * grad / np.sqrt(squares[part])[:, None]
        seen[part] += np.bincount(rows[k] - k * size, minlength=size)


def empty_table() -> np.ndarray:
    return np.zeros((FAMILIES * ROWS, CLASSES), dtype=np.float32)


def empty_tree_table() -> np.ndarray:
    return np.zeros((FAMILIES * TREE_ROWS, WAYS), dtype=np.float32)


def plant(counts: DataFrame, class_of: np.ndarray, distinct: int) -> Tree:
    """The tree of the counted words, of as many levels as give each word about a leaf."""
    levels = next(k for k in range(1, DEEPEST + 1) if k == DEEPEST or CLASSES * WAYS**k >= distinct)
    own = F.element_at(F.array(*[F.lit(int(c)) for c in class_of]), F.col("code") + 1)
    leaf = F.shiftrightunsigned("word", 8) % F.lit(WAYS**levels)
    found = counts.groupBy(own.alias("cls"), leaf.alias("leaf")).agg((F.sum("n") + 0.1 * F.count(F.lit(1))).alias("mass")).toPandas()  # at most CLASSES * WAYS ** DEEPEST rows
    leaves = np.zeros((CLASSES, WAYS**levels))
    leaves[found["cls"].to_numpy(np.int64), found["leaf"].to_numpy(np.int64)] = found["mass"].to_numpy(np.float64)
    return Tree(leaves)


def count_words(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """Over all tokens: (word hash, ending code, n) as a table, and how often ending codes follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size, follows = 0, np.zeros(ENDINGS * ENDINGS, dtype=np.int64)

        def table(word: np.ndarray, code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(code.astype(np.int32)), pa.array(n.astype(np.int64))], ["word", "code", "n"])

        def flush() -> pa.RecordBatch:
            h, c = (np.concatenate(x) for x in zip(*held))
            word, first, n = np.unique(h, return_index=True, return_counts=True)
            return table(word, c[first], n)

        for batch in batches:
            h, c, first, _ = column_tokens(batch.column("text"))
            pair = np.roll(c, 1)
            pair[first] = 0
            follows += np.bincount(pair * ENDINGS + c, minlength=len(follows))
            held.append((h, c.astype(np.int16)))
            size += len(h)
            if size > 5_000_000:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()
        met = np.flatnonzero(follows)
        yield table(met, np.full(len(met), -1), follows[met])

    counts = docs.select("text").mapInArrow(run, "word long, code int, n long")
    counts = counts.groupBy("word", (F.col("code") < 0).alias("pair")).agg(F.max("code").alias("code"), F.sum("n").alias("n"))
    counts = staged(counts, "lm-counts")
    follows = np.zeros(ENDINGS * ENDINGS)
    for r in counts.filter("pair").select("word", "n").toLocalIterator():  # at most ENDINGS * ENDINGS rows
        follows[r.word] = r.n
    return counts.filter("not pair").select("word", "code", "n"), follows.reshape(ENDINGS, ENDINGS)


def train_table(docs: DataFrame, class_of: np.ndarray, tree: Tree, *, epochs: int = 1, rate: float = 0.15) -> tuple[np.ndarray, np.ndarray]:
    """The weight tables of the classes and of the tree after ``epochs`` rounds of local gradient passes and averaging."""
    spark = docs.sparkSession
    tables = empty_table(), empty_tree_table()
    blocks = [-(-len(t) // BLOCK_ROWS) for t in tables]
    planted = spark.sparkContext.broadcast(tree)
    for epoch in range(epochs):
        start = spark.sparkContext.broadcast(tables if epoch else None)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            owns = (empty_table(), empty_tree_table()) if start.value is None else tuple(t.copy() for t in start.value)
            squares, seen = [np.full(len(t), 1e-2, dtype=np.float32) for t in owns], [np.zeros(len(t), dtype=np.float32) for t in owns]
            tree = planted.value
            rng = np.random.default_rng(5)
            task = None
            for batch in batches:
                task = batch.column("task")[0].as_py() if len(batch.column("task")) else task
                h, c, first, _ = column_tokens(batch.column("text"))
                target = class_of[c]
                rows, keys = features(h, target, first), histories(h, target, first)
                for at in range(0, len(h), STEP_TOKENS):
                    part = slice(at, at + STEP_TOKENS)
                    update(owns[0], squares[0], seen[0], rows[:, part], target[part], rate, rng)
                    _, ways, branch, node = tree.steps(h[part], target[part], keys[:, part])
                    update(owns[1], squares[1], seen[1], ways, branch, rate, rng, tree.mass, node)
            if task is not None:
                for b in range(sum(blocks)):
                    k = int(b >= blocks[0])
                    at = (b - k * blocks[0]) * BLOCK_ROWS
                    part = slice(at, at + BLOCK_ROWS)
                    met = np.flatnonzero(seen[k][part] > 0)
                    if len(met):
                        yield pa.RecordBatch.from_pandas(pd.DataFrame({"block": np.array([b], np.int32), "task": [task], "rows": [met.astype("<u2").tobytes()], "seen": [seen[k][part][met].tobytes()], "weights": [owns[k][part][met].astype(np.float16).tobytes()]}))

        def merge(pdf: pd.DataFrame) -> pd.DataFrame:
            width = CLASSES if pdf["block"].iloc[0] < blocks[0] else WAYS
            total, weight = np.zeros((BLOCK_ROWS, width), dtype=np.float32), np.zeros(BLOCK_ROWS, dtype=np.float32)
            for r, s, w in zip(pdf["rows"], pdf["seen"], pdf["weights"]):
                r, s = np.frombuffer(r, "<u2"), np.frombuffer(s, np.float32)
                total[r] += s[:, None] * np.frombuffer(w, np.float16).reshape(-1, width).astype(np.float32)
                weight[r] += s
            met = np.flatnonzero(weight > 0)
            mean = (total[met] / weight[met][:, None]).astype(np.float16)
            return pd.DataFrame({"block": [pdf["block"].iloc[0]], "task": [int(pdf["task"].iloc[0]) // MERGE], "rows": [met.astype("<u2").tobytes()], "seen": [weight[met].tobytes()], "weights": [mean.tobytes()]})

        schema = "block int, task long, rows binary, seen binary, weights binary"
        parts = staged(docs.select("text", F.spark_partition_id().cast("long").alias("task")).mapInArrow(run, schema), "lm-updates")
        tasks = (parts.agg(F.max("task")).head()[0] or 0) + 1
        while True:
            parts = staged(parts.groupBy("block", F.floor(F.col("task") / MERGE).alias("g")).applyInPandas(merge, schema), "lm-merged")
            tasks = -(-tasks // MERGE)
            if tasks <= 1:
                break
        tables = tuple(t.copy() for t in tables)
        for r in parts.toLocalIterator():  # the tables themselves, whatever the corpus
            k = int(r.block >= blocks[0])
            rows = (r.block - k * blocks[0]) * BLOCK_ROWS + np.frombuffer(r.rows, "<u2").astype(np.int64)
            tables[k][rows] = np.frombuffer(r.weights, np.float16).reshape(len(rows), -1)
    return tables


RESULTS = ("n_tokens", "n_known", "train_tokens", "base_score", "score")


def score_corpus(docs: DataFrame, *, train_where: Column, epochs: int = 1) -> DataFrame:
    """``docs`` without text, plus n_tokens, n_known, train_tokens, base_score, score; columns of these names give way to the results."""
    spark = docs.sparkSession
    small_batches(spark, 256)
    train = docs.filter(train_where).select("text")
    carried = [c for c in docs.columns if c.lower() not in ("text", *RESULTS)]
    columns = dict(zip(docs.columns, own(docs)))
    docs = docs.select("text", *[columns[name].alias(f"c{i}") for i, name in enumerate(carried)])
    counts, follows = count_words(train)
    n_all, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).head()
    class_of = cluster(follows)
    tree = plant(counts, class_of, distinct)
    table, tree_table = train_table(train, class_of, tree, epochs=epochs)

    level = F.floor(F.log2("n") * 8)
    histogram = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("level")).collect()
    floor, total = None, 0
    for r in histogram:
        if total + r.words > HEAD:
            break
        floor, total = r.level, total + r.words
    head = counts.filter(level >= floor) if floor is not None else counts.limit(0)
    got = head.select("word", "n").toPandas()  # at most HEAD rows by the histogram
    order = np.argsort(got["word"].to_numpy().view(np.uint64) if len(got) else np.empty(0, np.uint64))
    words, known = got["word"].to_numpy(np.int64).view(np.uint64)[order], got["n"].to_numpy(np.int64)[order]
    complete = total == distinct

    # the mass of each class: its tokens and 0.1 for each of its words and for one unseen
    mass = np.full(CLASSES, 0.1)
    for r in counts.groupBy("code").agg((F.sum("n") + 0.1 * F.count(F.lit(1))).alias("m")).collect():  # ENDINGS rows
        mass[class_of[r.code]] += r.m
    log_mass = np.log10(mass)
    shared = spark.sparkContext.broadcast((table.astype(np.float16), tree_table.astype(np.float16), tree, words, known))
    log_total = float(np.log10(n_all + 0.1 * (distinct + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half, half_tree, tree, head_words, head_counts = shared.value
        weights, tree_weights = half.astype(np.float32), half_tree.astype(np.float32)
        for batch in batches:
            h, c, first, sizes = column_tokens(batch.column("text"))
            if not len(sizes):
                continue
            cls = class_of[c]
            rows = features(h, cls, first)
            lp = log_probabilities(weights, rows, cls)
            lift = tree.log_lift(tree_weights, h, cls, histories(h, cls, first))  # of a word that was seen
            value = lp / np.log(10) - log_mass[cls]
            n = np.zeros(len(h), dtype=np.int64)
            if len(head_words):
                distinct, inverse = np.unique(h, return_inverse=True)
                at = np.minimum(np.searchsorted(head_words, distinct), len(head_words) - 1)
                n = np.where(head_words[at] == distinct, head_counts[at], 0)[inverse]
            settled = (n > 0) | complete
            part = np.where(settled, np.log10(n + 0.1), 0.0)
            value += np.where(n > 0, lift, 0.0)
            tail = ~settled
            ends = np.concatenate(([0], np.cumsum(np.add.reduceat(tail.astype(np.int32), first), dtype=np.int32))).astype(np.int32)
            rest = pa.ListArray.from_arrays(pa.array(ends), pa.array(h[tail].view(np.int64)))
            lifts = pa.ListArray.from_arrays(pa.array(ends), pa.array(lift[tail].astype(np.float32)))
            made = {"n_tokens": pa.array(sizes), "n_known": pa.array(np.add.reduceat((n > 0).astype(np.int64), first)), "model": pa.array(np.add.reduceat(value, first)), "counted": pa.array(np.add.reduceat(part, first)), "rest": rest, "lifts": lifts}
            kept = [k for k in batch.schema.names if k != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in kept], *made.values()], [*kept, *made])

    # rows are numbered after they are written, so that the tail can come back to them
    keep = [f for f in docs.schema.fields if f.name != "text"]
    inner = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep) + ", n_tokens long, n_known long, model double, counted double, rest array<long>, lifts array<float>"
    scored = staged(docs.mapInArrow(run, inner), "lm-scored").withColumn("_row", F.monotonically_increasing_id())
    if complete:
        joined = scored.withColumn("tail", F.lit(0.0)).withColumn("tail_lift", F.lit(0.0)).withColumn("tail_known", F.lit(0).cast("long"))
    else:
        scored = staged(scored, "lm-rows")
        tail = scored.select("_row", F.explode(F.arrays_zip("rest", "lifts")).alias("x")).groupBy("_row", F.col("x.rest").alias("word")).agg(F.count(F.lit(1)).alias("tf"), F.sum("x.lifts").alias("lift"))
        tail = tail.join(counts.select("word", "n"), "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        per_row = tail.groupBy("_row").agg(F.sum(F.col("tf") * F.log10(F.col("n") + 0.1)).alias("tail"), F.sum(F.when(F.col("n") > 0, F.col("tf")).otherwise(0)).alias("tail_known"), F.sum(F.when(F.col("n") > 0, F.col("lift")).otherwise(0.0)).alias("tail_lift"))
        joined = scored.join(per_row, "_row", "left")
    counted = F.col("counted") + F.coalesce("tail", F.lit(0.0))
    return joined.select(
        *[F.col(f.name).alias(name) for f, name in zip(keep, carried)], "n_tokens", (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (counted - F.col("n_tokens") * F.lit(log_total)).alias("base_score"), (counted + F.col("model") + F.coalesce("tail_lift", F.lit(0.0))).alias("score"),
    )
