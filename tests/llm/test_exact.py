"""Exact duplicates, the source audit and whitening against brute force and on defined cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.llm import exact_dedup, source_audit, whitening
from quernstone.llm.queries import queries

DATA = "/root/testdata/sf0.001"


# --- exact duplicates --------------------------------------------------------------------------------------------


def brute_duplicates(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, (doc_id, text) in enumerate(rows):
        groups[norm(text)].append((doc_id is None, doc_id or 0, i))
    out = []
    for text, members in groups.items():
        keep = min(members)[:2]
        n_kept = 0
        for absent, doc_id, _ in members:
            kept = (absent, doc_id) == keep and not n_kept
            n_kept += kept
            out.append((None if absent else doc_id, None if keep[0] else keep[1], len(members), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def duplicate_rows():
    rng = random.Random(1)
    rows = [(i, "copied  text\n of everyone") for i in range(300, 600)]
    rows += [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(1, 4)))) for i in range(300)]
    same_head = "x" * 400
    rows += [(700, same_head + "1"), (701, same_head + "2"), (702, same_head + "1"), (703, "y" * 300_000 + " z"), (704, "y" * 300_000 + "\t\tz")]
    rows += [(800, None), (801, ""), (802, " "), (803, "\n\t "), (None, "of nobody"), (None, "of nobody"), (804, "of nobody"), (None, "alone"), (805, "ünï\x0bcode"), (806, "ünï code"), (807, "ünï code")]
    return rows + [(900, "again"), (900, "again"), (901, "again")]


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_exact_duplicates_equal_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(exact_dedup, "BROADCAST_GROUPS", broadcast)
    rows = duplicate_rows()
    rng = random.Random(2)
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "extra", 1) for i, t in rows], "doc_id long, text string, kept string, row int").repartition(5)
    got = sorted(map(tuple, exact_dedup.exact_duplicates(docs, hash_all=True).collect()), key=repr)
    assert got == brute_duplicates(rows)
    lazy = exact_dedup.exact_duplicates(docs).collect()
    assert sorted((r[:4] for r in lazy), key=repr) == sorted((r[:4] for r in got), key=repr)
    assert any(r.text_sha256 is None for r in lazy) and all(r.text_sha256 for r in lazy if r.group_size > 1)


def test_most_rows_are_narrowed_out_before_their_content(spark):
    docs = spark.createDataFrame([(i, f"{i} " * (i + 1)) for i in range(50)] + [(100, "5 " * 6)], "doc_id long, text string")
    assert [r.rows for r in exact_dedup.surviving_groups(docs).collect()] == [2]


def test_keep_first_keeps_columns_and_one_row_each(spark):
    rows = duplicate_rows()
    docs = spark.createDataFrame([(i, t, f"s{n}", n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, text_sha256 string, sha int")
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    want = brute_duplicates(rows)
    assert len(got) == sum(r[3] for r in want)
    assert sorted((i for i, _ in got), key=repr) == sorted((r[0] for r in want if r[3]), key=repr)


def test_exact_duplicates_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.exact_duplicates(empty, hash_all=True).collect() == [] and exact_dedup.keep_first(empty).collect() == []


# --- source audit ------------------------------------------------------------------------------------------------


def brute_audit(rows, min_docs, top):
    lower = str.maketrans(source_audit.UPPER, source_audit.LOWER)
    counts, held, groups = Counter(), Counter(), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))
        for t in found:
            counts[lang, source, t] += 1
        for t in set(found):
            held[lang, t] += 1
    out = []
    p_of = lambda n, size, v: 1 + 1_000_000_000 * (n + 5) // (size + 5 * v)
    for lang in {g[0] for g in groups}:
        kept = [t for (x, t), n in held.items() if x == lang and n >= min_docs]
        mine = sorted(s for x, s in groups if x == lang)
        n = {(s, t): counts[lang, s, t] for s in mine for t in kept}
        total = {t: sum(n[s, t] for s in mine) for t in kept}
        size = {s: sum(n[s, t] for t in kept) for s in mine}
        p = {(s, t): p_of(n[s, t], size[s], len(kept)) for s in mine for t in kept}
        q = {t: p_of(total[t], sum(total.values()), len(kept)) for t in kept}
        for s in mine:
            pair = sorted(((-sum(abs(p[s, t] - p[o, t]) for t in kept), o.encode()) for o in mine if o != s))
            term = sorted((q[t] - p[s, t], t.encode()) for t in kept if n[s, t] > 0 and p[s, t] > q[t])[:top]
            for part, some in (("pair", pair), ("term", term)):
                out += [(lang, s, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(some, 1)]
    return sorted(out)


def test_audit_equals_brute_force(spark):
    rng = random.Random(3)
    words = ["Der", "der", "die", "Ärger", "ärger", "x-ray", "don't", "日本語", "a1b2", "ZZ", "q"]
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 12))), rng.choice(["de", "de", "de", "en", None]), rng.choice(["hot"] * 5 + ["a", "b", "", None])) for _ in range(400)]
    rows += [(None, "de", "no text"), ("", "fr", "x"), ("\n 12 ...", "fr", "y"), ("rare words here", "it", "z"), ("the " * 50_000, "en", "long"), ("der", "de", "a")] + rows[:20]
    docs = spark.createDataFrame([(*r, 1, "t") for r in rows], "text string, lang string, source string, n int, term string").repartition(3)
    got = sorted(map(tuple, source_audit.audit(docs, min_docs=20, top=3).collect()))
    assert got == brute_audit(rows, 20, 3)
    assert ("fr", "x", "pair", "y", 0, 1) in got and not [r for r in got if r[0] == "it"]


def test_audit_of_nothing(spark):
    assert source_audit.audit(spark.createDataFrame([], "text string, lang string, source string")).collect() == []


def test_shares_are_exact_beyond_a_long(spark):
    pairs = [(1, 1), (5, 7), (9_000_000_000_000_001, 9_000_000_000_000_007), (123_456_789_012_345, 987_654_321_098_765), (6, 10**15)]
    out = spark.createDataFrame(pairs, "a long, b long").select(source_audit.share(F.col("a"), F.col("b")).alias("p")).collect()
    assert [r.p for r in out] == [1 + 10**9 * a // b for a, b in pairs]


# --- whitening ---------------------------------------------------------------------------------------------------


def brute_whitening(vectors, k=8):
    x = np.floor(1024 * np.array(vectors, dtype=np.float64)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for row in x]
    centred = x - s / n
    values, parts = np.linalg.eigh(centred.T @ centred / n)
    values, parts = values[::-1][:k], parts[:, ::-1][:, :k]
    return deviation, centred @ parts / np.sqrt(values), values / (centred**2).sum() * n


def compare(got, vectors, k=8, by="vec_id"):
    deviation, whitened, explained = brute_whitening(vectors, k)
    table = defaultdict(dict)
    for r in got:
        table[r[by]][r.component] = r
    assert len(got) == len(vectors) * whitened.shape[1]
    for c in range(whitened.shape[1]):
        mine = np.array([table[i][c + 1].whitened for i in range(len(vectors))])
        assert min(np.abs(mine - whitened[:, c]).max(), np.abs(mine + whitened[:, c]).max()) < 1e-8
        assert abs(got[0].identity_error) < 1e-9
        assert abs(table[0][c + 1].explained - explained[c]) < 1e-10 * explained[c]
    assert [int(table[i][1].deviation) for i in range(len(vectors))] == deviation


def test_whitening_equals_eigendecomposition(spark):
    rng = np.random.default_rng(4)
    vectors = (rng.standard_normal((300, 40)) * np.linspace(3, 0.1, 40)).astype(np.float32).tolist()
    bad = [(900, None), (901, [None] + [0.0] * 39), (902, [float("nan")] + [0.0] * 39), (903, [float("inf")] + [0.0] * 39), (904, [1e30] + [0.0] * 39), (905, [1.0]), (906, [])]
    rows = [(i, v, 7, "x") for i, v in enumerate(vectors)] + [(i, v, 0, None) for i, v in bad]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int, component string").repartition(6)
    compare(whitening.whiten(df).collect(), vectors)


def test_whitening_query_equals_eigendecomposition(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").orderBy("vec_id").collect()
    assert [r.vec_id for r in rows] == list(range(len(rows)))
    df = queries()["op13_whitening"](spark, DATA)
    assert dict(df.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    compare(df.collect(), [r.embedding for r in rows])


def test_whitening_of_few_equal_or_no_rows(spark):
    make = lambda vs: spark.createDataFrame(list(enumerate(vs)), "vec_id long, embedding array<double>")
    assert whitening.whiten(make([])).collect() == []
    assert whitening.whiten(make([[1.0, 2.0]] * 5)).collect() == []
    two = whitening.whiten(make([[0.0, 0.0, 1.0], [1.0, 0.0, 1.0], [1.0, 0.0, 1.0]])).collect()  # one direction with variance; a repeated row
    assert {r.component for r in two} == {1} and len(two) == 3 and abs(two[0].explained - 1) < 1e-12 and abs(two[0].identity_error) < 1e-12
    short = whitening.whiten(make([[0.0, 1.0], [2.0, 5.0], [3.0, 3.0], [8.0, 1.0]])).collect()
    assert {r.component for r in short} == {1, 2} and abs(sum(r.explained for r in short) / 4 - 1) < 1e-12


def test_lanczos_restarts_on_breakdown():
    rng = np.random.default_rng(5)
    q, _ = np.linalg.qr(rng.standard_normal((30, 30)))
    for values in (np.r_[[5.0] * 6, [2.0] * 4, [0.0] * 20], np.r_[[1.0] * 30], np.arange(30.0)):
        a = (q * values) @ q.T
        got, vectors, passes, residual = whitening.block_lanczos(lambda x: a @ x, 30, 8, block=3)
        assert np.allclose(got, np.sort(values)[::-1][:8], atol=1e-11) and residual < 1e-10
        assert np.allclose(vectors.T @ vectors, np.eye(8), atol=1e-12)
        assert np.allclose(a @ vectors, vectors * got, atol=1e-10)


def test_lanczos_needs_few_passes_when_values_fall(spark):
    rng = np.random.default_rng(6)
    q, _ = np.linalg.qr(rng.standard_normal((400, 400)))
    a = (q * 0.7 ** np.arange(400)) @ q.T
    got, _, passes, residual = whitening.block_lanczos(lambda x: a @ x, 400, 8)
    assert residual <= whitening.TOLERANCE and passes <= 12 and np.allclose(got, 0.7 ** np.arange(8), rtol=1e-12)
