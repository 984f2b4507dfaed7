"""Toxicity, token counts, token files, language model and decontamination against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quernstone.llm import decontamination, language_model, token_counts, token_files, toxicity
from quernstone.llm import queries as llm_queries
from quernstone.llm.text import HashMemo, column_words
from quernstone.runtime import table

public_tokenizers = pytest.importorskip("public_tokenizers")
DATA = "/root/testdata/sf0.001"
ODD = ["", " ", "  ", "   a  b   ", "\n", "\n\n a", "▁a ▁ b", "<s>hi</s> <unk> <0x0A>", "日本語 テキスト😀", "a\tb\r\nc", "\x00x", "x" * 3000, "ab" * 1500, " " * 50, "a" + " " * 37 + "b\n     \n  c", "it's I'M 'S", "é ́e  x　y \x1c\x1d z\x85w", "<|endoftext|>hi<|startoftext|>", "ΑΣ Σ", "H̱ ẖ", None]


def random_texts(n=1500, seed=1):
    rng = random.Random(seed)
    letters = [*"ab ▁\n\té😀<>s0128的 ", "the", "ing", "  ", "'s", ","]
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(n)]


@pytest.fixture(scope="module")
def odd_docs(spark):
    texts = ODD + random_texts(200)
    rows = [(i if i % 17 else None, t, "keep") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string")


def test_words_have_one_hash():
    texts = ODD + random_texts()
    w = column_words(pa.array(texts))
    words = [x for t in texts for x in (t or "").encode().lower().split()]
    assert len(words) == len(w.hashes) and w.sizes.tolist() == [len((t or "").encode().split()) for t in texts]
    assert len(set(words)) == len(set(zip(words, w.hashes.tolist()))) == len(set(w.hashes.tolist()))


def test_hash_memo_starts_anew():
    memo = HashMemo(100)
    for at in range(0, 300, 30):
        keys = np.arange(at, at + 30, dtype=np.uint64)
        memo.add(keys, keys.astype(np.int64) * 2)
        values, found = memo.find(keys)
        assert found.all() and (values == keys * np.uint64(2)).all() and len(memo) <= 100


def test_token_counts_match_the_library(spark, odd_docs):
    import sentencepiece

    file = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=file)
    texts = ODD + random_texts(3000, 2) + [r.text for r in table(spark, DATA, "documents").collect()]
    random.Random(3).shuffle(texts)
    want = [len(library.encode(t or "")) for t in texts]
    merger = token_counts.Merger(file)
    assert merger.count_column(pa.array(texts, pa.string())).tolist() == want
    assert [merger.count(t) for t in texts] == want
    out = token_counts.count_tokens(odd_docs, file, limit=20)
    assert out.columns[:3] == ["doc_id", "text", "score"]
    for r in out.collect():
        n = len(library.encode(r.text or ""))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), n, n > 20)
    assert token_counts.count_tokens(odd_docs.limit(0), file).count() == 0


@pytest.mark.parametrize("ids", [[], [5], [7] * 5000, [2**32 - 1, 0] * 3000, list(range(10_000)), [1] * 4000 + [2**31] + [1] * 4000])
def test_token_file_round_trip(ids):
    ids = np.array(ids, dtype=np.uint32)
    lengths = [0, len(ids) // 3, len(ids) - len(ids) // 3, 0]
    f = token_files.TokenFile(token_files.encode_file([3, None, -5, 9], lengths, ids))
    assert (f.ids(0, len(ids)) == ids).all() and (f.ids(len(ids) // 4, len(ids) // 2) == ids[len(ids) // 4 : len(ids) // 2]).all()
    places = np.cumsum([0, *lengths])
    want = [(d, int(a), n, zlib.crc32(ids[a : a + n].astype("<u4").tobytes())) for d, a, n in zip([3, None, -5, 9], places, lengths)]
    assert list(f.documents()) == want
    with pytest.raises(ValueError):
        token_files.TokenFile(b"nope" + bytes(40))


def test_outliers_go_to_exceptions():
    ids = np.full(2048, 3, np.uint32)
    ids[[5, 900]] = 60_000
    assert len(token_files.encode_block(ids)) < 40


def test_token_files_match_the_library(spark, odd_docs):
    from tokenizers import Tokenizer

    file = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(file)
    encoder = token_files.encoder(file)
    assert encoder.by_chunk
    texts = ODD + random_texts(3000, 4) + [r.text for r in table(spark, DATA, "documents").collect()]
    assert [e.tolist() for e in encoder.encode(pa.array(texts, pa.string()))] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    folder = token_files.token_folder(spark)
    manifest = token_files.write_token_files(odd_docs, folder, file, ids_per_file=300)
    assert manifest.count() > 2
    got = token_files.read_token_files(spark, folder, manifest).orderBy("start", "n_tokens").collect()
    rows = [(r.doc_id, [*library.encode(r.text or "", add_special_tokens=False).ids, 2]) for r in odd_docs.collect()]
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((d, len(i), crc(i)) for d, i in rows)
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda d: (d is not None, d or 0))
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    empty = token_files.token_folder(spark)
    assert token_files.read_token_files(spark, empty, token_files.write_token_files(odd_docs.limit(0), empty, file)).count() == 0


def toxic_corpus():
    rng = random.Random(5)
    plain = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    bad = ["horrid", "wretch", "vermin"]
    rows = []
    for i in range(700):
        words = [rng.choice(plain) for _ in range(rng.randint(20, 300))]
        toxic = int(i % 4 == 0)
        if toxic:
            at = rng.randrange(len(words) - 10)
            words[at : at + 8] = [rng.choice(bad) for _ in range(3)] + words[at : at + 5]
        rows.append((i, " ".join(words), toxic))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = toxic_corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 5], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    out = {r.doc_id: r for r in toxicity.score_documents(docs, model).collect()}
    held = [(out[i].predicted, y) for i, _, y in rows if i % 5 == 0]
    assert sum(p == y for p, y in held) / len(held) > 0.9
    # an unseen misspelling shares n-grams; a long clean text around a toxic line hides nothing; nor does repetition matter
    clean = " ".join(t for _, t, y in rows[:9] if not y)
    assert model.score("some horridd wretchh verminn here") > model.score("some other plain words here")
    assert model.score(clean + " horrid wretch vermin horrid wretch vermin " + clean) > 0.3 > model.score(clean)


def test_toxicity_edges(spark):
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 100_000), (3, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (9, 1)], "doc_id long, toxic int")
    model = toxicity.learn(odd, labels)
    assert [r.score for r in toxicity.score_documents(odd, model).collect()] == [0.0] * 4
    both = toxicity.learn(odd, spark.createDataFrame([(1, 0), (3, 1)], "doc_id long, toxic int"))
    scores = [r.score for r in toxicity.score_documents(odd.withColumn("predicted", F.lit("x")), both).collect()]
    assert all(0 <= s <= 1 for s in scores) and scores[0] == scores[1]
    assert toxicity.score_documents(odd.limit(0), both).count() == 0


def test_training_sample_is_bounded_and_full(spark):
    docs = spark.createDataFrame([(i, "x" * (500 if i == 3 else 10)) for i in range(100)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(-5000, 100)], "doc_id long, toxic int")  # most labels have no document
    got = toxicity.training_sample(docs, labels, max_rows=20, max_chars=2100)
    assert got.groupby("y").size().to_dict() == {0: 40, 1: 20}
    assert toxicity.training_sample(docs, labels, max_rows=20, max_chars=700).text.str.len().sum() <= 700


def test_toxicity_counts_a_word_once_in_each_window():
    rng = random.Random(9)
    model = toxicity.train(["vile wretch", "good day"] * 20, [1, 0] * 20)
    for n in (1, 5, 63, 64, 65, 96, 128, 400):
        words = [f"w{rng.randint(0, 40)}" for _ in range(n)]
        if n == 96:
            words = [f"x{i}" for i in range(n)]
            words[0] = words[62] = "vile"
            words[60] = words[90] = "wretch"
        value = dict(zip(sorted(set(words)), model.margins(sorted(set(words)))))
        size = min(n, toxicity.WINDOW)
        best = max(sum(value[w] for w in set(words[s : s + size])) / size for s in toxicity.window_starts(n))
        assert model.score(" ".join(words)) == pytest.approx(1 / (1 + math.exp(model.bias[0] - model.bias[1] - best)), abs=1e-9)


def test_toxicity_by_plain_loops():
    """Scores from loops over windows, words and n-grams; an n-gram has one table row wherever it stands."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    model = toxicity.train([" ".join(words[i : i + 9]) for i in range(290)], [int(i % 3 == 0) for i in range(290)])
    ids, starts = toxicity.ngram_ids(words)
    rows, grams_of = {}, {}
    for w, a, b in zip(words, starts, [*starts[1:], len(ids)]):
        held = f"<{w}>"
        grams_of[w] = [(n, held[i : i + n]) for n in toxicity.NGRAMS for i in range(len(held) - n + 1)] + [("word", held)]
        for gram, row in zip(grams_of[w], ids[a:b].tolist(), strict=True):
            assert rows.setdefault(gram, row) == row
    assert len(set(rows.values())) > 0.98 * len(rows)
    for n in (1, 7, 64, 65, 200, 300):
        best = -math.inf
        for s in toxicity.window_starts(n).tolist():
            vector = np.zeros(toxicity.DIM)
            for w in set(words[s : s + toxicity.WINDOW][: n - s]):
                vector += sum(model.table[rows[g]] for g in grams_of[w]) / len(grams_of[w])
            logits = vector / min(n, toxicity.WINDOW) @ model.top + model.bias
            best = max(best, logits[1] - logits[0])
        assert model.score(" ".join(words[:n])) == pytest.approx(1 / (1 + math.exp(-best)), abs=1e-9)


def folded(spark, sf, folds, **options):
    """(scores of toxic rows, scores of others) of the labelled training rows of a table, each scored by a model that hasn't seen its fold."""
    data = f"/root/testdata/{sf}"
    rows = table(spark, data, "labels").filter("toxic is not null and crc32(cast(doc_id as string)) % 4 <> 2").join(table(spark, data, "documents"), "doc_id").select("doc_id", "text", "toxic").orderBy("doc_id").toPandas()
    fold = rows.doc_id.map(lambda i: zlib.crc32(f"f{i}".encode()) % folds).to_numpy()
    score, y = np.zeros(len(rows)), rows.toxic.to_numpy()
    for k in range(folds):
        model = toxicity.train(rows.text[fold != k].tolist(), y[fold != k].tolist(), **options)
        score[fold == k] = [model.score(t) for t in rows.text[fold == k]]
    return score[y == 1], score[y == 0]


def area(bad, good):
    return (bad[:, None] > good).mean() + (bad[:, None] == good).mean() / 2


def test_toxicity_learns_from_few_labels(spark):
    """On folds of the training rows, from which every choice was made: about 28 toxic labels to learn from at sf0.01, 165 at sf0.1."""
    bad, good = folded(spark, "sf0.01", 4)
    assert area(bad, good) >= 0.85 and (bad >= 0.3).mean() >= 0.4 and (good >= 0.3).mean() <= 0.05
    bad, good = folded(spark, "sf0.1", 2)
    assert area(bad, good) >= 0.94 and (bad >= 0.3).mean() >= 0.5 and (good >= 0.3).mean() <= 0.02


def test_toxicity_knows_nothing_without_training(spark):
    bad, good = folded(spark, "sf0.01", 4, epochs=0)
    assert 0.35 <= area(bad, good) <= 0.65


def base_score(words, counts):
    n, v = sum(counts.values()), len(counts)
    return sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)


@pytest.mark.parametrize("head", [1 << 19, 50])
def test_language_model(spark, monkeypatch, head):
    monkeypatch.setattr(language_model, "HEAD", head)
    rng = random.Random(8)
    left, right = [f"l{i}en" for i in range(60)], [f"r{i}os" for i in range(60)]
    texts = [" ".join(rng.choice(side).title() for _ in range(rng.randint(1, 60))) for side in [left, right] * 150] + ODD
    docs = spark.createDataFrame([(i, t, i % 10 == 0, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, held_out boolean, n_tokens string, model string")
    out = {r.doc_id: r for r in language_model.score_corpus(docs, train_where=~F.col("held_out")).collect()}
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t in enumerate(texts)}
    counts = Counter(w for i, ws in tokens.items() if i % 10 for w in ws)
    for i, ws in tokens.items():
        r = out[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(counts[w] > 0 for w in ws), sum(counts.values()))
        assert r.base_score == pytest.approx(base_score(ws, counts), abs=1e-6)
    assert all(r.model == "y" for r in out.values())
    held = [r for i, r in out.items() if i % 10 == 0]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 50


def test_language_model_is_a_distribution(spark):
    texts = ["aa bb aa", "bb cc", "aa cc dd"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(10 + i, w) for i, w in enumerate(["aa", "bb", "cc", "dd", ""])], "doc_id long, text string")
    out = {r.doc_id: r for r in language_model.score_corpus(docs, train_where=F.col("doc_id") < 10).collect()}
    first = [10 ** out[14].score]  # the end at once
    assert 0 < sum(first) < 1 and all(r.score < 0 for r in out.values())
    assert language_model.score_corpus(docs, train_where=F.col("doc_id") > 99).filter("train_tokens = 0").count() == docs.count()
    assert language_model.score_corpus(docs.limit(0), train_where=F.lit(True)).count() == 0


def test_language_model_knows_the_two_words_before():
    # the third word's class follows from the two words before it together (equal or not), from neither of them alone
    rng = random.Random(6)
    texts = [f"{a} {b} {'ccos' if a == b else 'dduq'}" for a, b in ((rng.choice(["pxxen", "qxxen"]), rng.choice(["pxxen", "qxxen"])) for _ in range(400))]
    hashes, codes, first, _ = language_model.column_tokens(pa.array(texts))
    target = np.where(codes == codes[0], 0, np.where(codes == 0, 1, 2))
    target[hashes == language_model.column_tokens(pa.array(["ccos"]))[0][0]] = 3
    table, rows = language_model.empty_table(), language_model.features(hashes, np.minimum(target, 2), first)
    squares, seen = np.full(len(table), 1e-2, dtype=np.float32), np.zeros(len(table), dtype=np.float32)
    for at in range(40):
        language_model.update(table, squares, seen, rows, target, 0.15, np.random.default_rng(at))
    third = language_model.log_probabilities(table, rows, target)[first + 2]
    assert np.exp(third).min() > 0.8


@pytest.mark.parametrize("head", [1 << 19, 2])
def test_language_model_knows_collocations_within_a_class(spark, monkeypatch, head):
    # words of one ending, so of one class, and equally frequent: only the word before tells which one follows
    monkeypatch.setattr(language_model, "HEAD", head)
    texts = ["red pxxen", "blue qxxen"] * 1000
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(5000, "red qxxen"), (5001, "blue pxxen"), (5002, "red unseenxen")], "doc_id long, text string")
    out = {r.doc_id: r.score for r in language_model.score_corpus(docs, train_where=F.col("doc_id") < 5000, epochs=4).collect()}
    assert out[0] > out[5000] + 0.5 and out[1] > out[5001] + 0.5 and out[5002] < out[5000]


def test_tree_of_a_class_is_a_distribution():
    rng = np.random.default_rng(2)
    hashes, n = rng.integers(0, 1 << 63, 300, dtype=np.uint64), rng.integers(1, 50, 300) + 0.1
    leaves = np.zeros((language_model.CLASSES, language_model.WAYS**2))
    np.add.at(leaves[3], language_model.Tree(leaves).leaf(hashes), n)
    tree, keys = language_model.Tree(leaves), np.repeat(rng.integers(0, 1 << 63, (language_model.FAMILIES, 1), dtype=np.uint64), 300, axis=1)
    table = rng.normal(0, 1, language_model.empty_tree_table().shape).astype(np.float32)
    lift = tree.log_lift(table, hashes, np.full(300, 3), keys)
    assert np.abs(lift).max() > 0.1 and (n / n.sum() * 10**lift).sum() == pytest.approx(1, abs=1e-4)


def brute_overlap(text, items, window=10):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda t: (t or "").translate({i: i + 32 for i in range(65, 91)})
    words = pattern.findall(lower(text))
    hit, found = set(), set()
    for item, t in items:
        w = pattern.findall(lower(t))
        n = min(window, len(w))
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
        for i in range(len(words) - n + 1) if n else []:
            if tuple(words[i : i + n]) in grams:
                hit.update(range(i, i + n))
                found.add(item)
    listed = sorted(map(str, found))
    return len(words), len(hit), len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(), len(hit) > 0


@pytest.mark.parametrize("max_words", [500_000, 40])
def test_decontamination(spark, max_words):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(30)] + ["é", "日本"]
    long = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(1, long(30)), (2, long(12)), (10, "W1, w2!"), (3, ""), (4, None), (5, long(25)), (5, long(15))]
    texts = [None, "", "...", long(200), "x " + items[0][1].upper().replace(" ", " -- ") + " y", items[5][1] + items[1][1], items[1][1][3:] + " " + items[6][1], *(long(rng.randint(0, 80)) for _ in range(60))]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = {r.doc_id: r for r in decontamination.find_overlaps(docs, bench, max_words=max_words).collect()}
    for i, t in enumerate(texts):
        r = out[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute_overlap(t, items), i
        for a, b in r.spans:
            assert t[a:b].strip(" .,-!") == t[a:b]
    assert decontamination.find_overlaps(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert decontamination.find_overlaps(docs.limit(0), bench).count() == 0


def test_items_of_several_passes_give_the_same(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 25)))) for i in range(30)] + [(30, None), (31, ""), (None, "nobody's item")]
    texts = [" ".join(rng.choices(words, k=5)) + " " + items[i % 30][1].upper() + ", " + " ".join(rng.choices(words, k=4)) + " " + items[(i * 7) % 30][1] for i in range(40)]
    texts += [None, "", "!?", "nobody's item here", "long " * 40_000 + items[3][1] + " w1" * 40_000] + texts[:3]
    docs = spark.createDataFrame([(i, t, "x", 5) for i, t in enumerate(texts)], "doc_id long, text string, row string, hit int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    plain = lambda df: sorted((repr(r) for r in df.collect()))
    one = decontamination.find_overlaps(docs, bench, keep=("doc_id", "row", "hit"))
    many = decontamination.find_overlaps(docs, bench, keep=("doc_id", "row", "hit"), max_words=30, pass_words=60)
    assert plain(one) == plain(many) and one.filter("contaminated").count() >= 40
    assert len(list(decontamination.passes(bench, 10, 30, 60))) > 3
    kept = decontamination.keep_clean(docs, bench, max_words=30, pass_words=60)
    assert kept.columns == docs.columns and plain(kept) == plain(decontamination.keep_clean(docs, bench))
