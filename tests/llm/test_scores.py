"""Classifier, language model and nearest neighbours: held-out figures and brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import hmm, nearest, quality
from tidemark.llm.queries import op1_quality, op4_nearest, op5_hmm

SF = "/root/testdata/sf0.01"


def auc(score, label):
    rank = np.empty(len(score))
    rank[np.argsort(score, kind="stable")] = np.arange(len(score))
    n = label.sum()
    return (rank[label == 1].sum() - n * (n - 1) / 2) / (n * (len(label) - n))


def test_quality_on_held_out_rows(spark):
    rows = op1_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert set(rows.held_out) == {True} and rows.score.between(0, 1).all()
    assert auc(rows.score.values, rows.quality.values) > 0.97
    assert ((rows.score >= 0.5).astype(int) == rows.predicted).all()
    assert (rows.predicted == rows.quality).mean() > 0.95


def test_quality_gradient():
    rng = np.random.default_rng(0)
    x = rng.random((9, quality.N_FEATURES)).astype(np.float32)
    first, y, w = np.array([0, 3, 4, 9]), np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])
    model = quality.Model(np.zeros(quality.N_FEATURES), np.ones(quality.N_FEATURES))
    model.p = {k: rng.standard_normal(v.shape) * 0.3 for k, v in model.p.items()}

    def loss():
        s = model.forward(x, first)[-1]
        return -(w * (y * np.log(s) + (1 - y) * np.log(1 - s))).sum() / w.sum()

    for k, g in model.gradient(x, first, y, w).items():
        i = tuple(0 for _ in g.shape)
        at, h = model.p[k][i], 1e-5
        model.p[k][i] = at + h
        up = loss()
        model.p[k][i] = at - h
        assert abs((up - loss()) / (2 * h) - g[i]) < 1e-4
        model.p[k][i] = at


def test_attention_against_loops():
    """The score of a document by the formulas: encodings, gated attention over its passages, weighted sum, logistic unit."""
    rng = np.random.default_rng(4)
    model = quality.Model(rng.random(quality.N_FEATURES), 0.5 + rng.random(quality.N_FEATURES))
    model.p = {k: rng.standard_normal(v.shape) * 0.4 for k, v in model.p.items()}
    p, sizes = model.p, [1, 4, 2]
    x, first = rng.random((7, quality.N_FEATURES)), np.concatenate([[0], np.cumsum(sizes)])
    want = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        encoded, weights = [], []
        for row in x[a:b]:
            z = [max(-6.0, min(6.0, (v - m) / s)) for v, m, s in zip(row, model.mean, model.scale, strict=True)]
            h = [math.tanh(sum(v * p["E"][i, j] for i, v in enumerate(z)) + p["e"][j]) for j in range(quality.HIDDEN)]
            gate = [math.tanh(sum(v * p["V"][i, j] for i, v in enumerate(h))) / (1 + math.exp(-sum(v * p["U"][i, j] for i, v in enumerate(h)))) for j in range(quality.ATTENTION)]
            encoded.append(h)
            weights.append(math.exp(sum(g * w for g, w in zip(gate, p["w"], strict=True))))
        bag = [sum(w * h[j] for w, h in zip(weights, encoded, strict=True)) / sum(weights) for j in range(quality.HIDDEN)]
        want.append(1 / (1 + math.exp(-sum(v * c for v, c in zip(bag, p["c"], strict=True)) - p["b"][0])))
    assert np.allclose(model.forward(x, first)[-1], want, atol=1e-9)


def test_quality_takes_any_text(docs, empty, spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(1, None), (None, 1), (2, 0)], "doc_id long, quality int")
    out = quality.score(docs, quality.train(docs, labels))
    assert out.count() == docs.count() and out.where("score is null or score < 0 or score > 1").count() == 0
    assert out.columns == [*(c for c in docs.columns if c != "score"), "score"]
    assert quality.score(empty, quality.train(empty, labels.limit(0))).collect() == []
    assert quality.train(docs, labels.where("quality = 1")) is not None


def learned(monkeypatch, docs, labels, **more):
    """Bags and labels that training learns from."""
    seen = []
    monkeypatch.setattr(quality, "fit", lambda bags, y: seen.append((bags, y)))
    quality.train(docs, labels, **more)
    return seen[0]


def test_training_takes_all_passages(spark, monkeypatch):
    texts = [" ".join(f"{'odd' if p == i else 'w'}{j}" for p in range(40) for j in range(quality.PASSAGE_WORDS)) for i in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    bags, y = learned(monkeypatch, docs, labels)
    assert [len(b) for b in bags] == [40] * 12 and list(y) == [0, 1] * 6
    monkeypatch.setattr(quality, "SAMPLE_PASSAGES", 100)
    assert [len(b) for b in learned(monkeypatch, docs, labels)[0]] == [40] * 3  # fewer rows, but whole ones


def test_training_takes_one_row_of_a_document(spark, monkeypatch):
    rows = [(0, f"b{i} " * (65 + i)) for i in range(50)] + [(0, "a b"), (0, None), (1, "c"), (2, "d " * 200), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)] + [(1, 0)], "doc_id long, quality int")
    bags, y = learned(monkeypatch, docs, labels, sample=4)
    assert [len(b) for b in bags] == [1, 1, 4, 1] and list(y) == [0, 0, 0, 1]


def test_passages_are_encoded_alike_anywhere():
    texts = ["alpha beta " * 90, "", "   ", "Gamma!", "ünï " * 70]
    raw = [t.encode() for t in texts]
    whole, first = quality.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    for i, r in enumerate(raw):
        alone, n = quality.encode(np.frombuffer(r, np.uint8), np.array([0, len(r)]))
        assert np.allclose(alone, whole[first[i] : first[i + 1]]) and len(alone) == n[-1]


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def check_base(rows, got, learn):
    counts = Counter(t for i, x in rows if learn(i) for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, x in rows:
        own = tokens(x)
        want.append((str(i), len(own), sum(counts[t] > 0 for t in own), n, round(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in own), 4)))
    assert sorted(want) == sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got)


def test_base_scores(spark, docs, corpus):
    def learn(i):
        return zlib.crc32(str("" if i is None else i).encode()) % 7 != 2

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check_base(rows, op5_hmm(spark, SF).collect(), learn)
    learned = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(7)) != 2
    check_base(corpus, hmm.score_texts(docs, learned, rounds=1, sent=50).collect(), learn)  # most words are joined
    check_base(corpus, hmm.score_texts(docs, F.lit(False)).collect(), lambda i: False)


def test_model_beats_its_classes_held_out(spark):
    rows = op5_hmm(spark, SF).where("held_out").agg(F.avg(F.col("score") / F.col("n_tokens")), F.avg(F.col("base_score") / F.col("n_tokens"))).first()
    assert rows[0] > rows[1] + 0.01


def test_empty_corpus(empty):
    assert hmm.score_texts(empty, F.lit(True)).collect() == []


def small_model(seed=0):
    rng = np.random.default_rng(seed)
    norm = lambda x: x / x.sum(-1, keepdims=True)
    return hmm.Model(norm(rng.random(hmm.STATES)), norm(rng.random((hmm.STATES, hmm.STATES))), norm(rng.random((hmm.STATES, hmm.CLASSES))))


def test_forward_recursion_is_the_sum_over_paths():
    m, texts = small_model(), [[3, 1, 4, 1], [5], [9, 2]]
    got = m.log10(np.array(sum(texts, []), np.uint16), np.array([0, 4, 5, 7]))
    for value, text in zip(got, texts, strict=True):
        paths = m.start * m.emit[:, text[0]]
        for t in text[1:]:
            paths = np.array([sum(paths[i] * m.move[i, j] for i in range(hmm.STATES)) * m.emit[j, t] for j in range(hmm.STATES)])
        assert abs(value - math.log10(paths.sum())) < 1e-9


def plain_counts(m, text):
    """Expected counts of one text, by forward and backward recursion without scaling, and its probability."""
    n, k = len(text), range(hmm.STATES)
    fore, back = np.zeros((n, hmm.STATES), np.longdouble), np.ones((n, hmm.STATES), np.longdouble)
    for t in range(n):
        fore[t] = (m.start if t == 0 else [sum(fore[t - 1][i] * m.move[i, j] for i in k) for j in k]) * m.emit[:, text[t]]
    for t in range(n - 2, -1, -1):
        back[t] = [sum(m.move[i, j] * m.emit[j, text[t + 1]] * back[t + 1][j] for j in k) for i in k]
    p = fore[-1].sum()
    share = fore * back / p
    move, by_class = np.zeros((hmm.STATES, hmm.STATES)), np.zeros((hmm.STATES, hmm.CLASSES))
    for t in range(n):
        by_class[:, text[t]] += share[t]
        if t:
            move += fore[t - 1][:, None] * m.move * (m.emit[:, text[t]] * back[t])[None] / p
    return np.concatenate([share[0], move.ravel(), by_class.ravel()]), p


@pytest.mark.parametrize("segment", [1, 7, 1 << 16])
def test_expected_counts_of_whole_texts(segment, monkeypatch):
    monkeypatch.setattr(hmm, "SEGMENT", segment)
    rng, m = np.random.default_rng(2), small_model(3)
    texts = [rng.integers(0, 6, n).astype(np.uint16) for n in (1, 90, 3, 3, 150, 20)]
    ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    want = sum(plain_counts(m, t)[0] for t in texts).astype(float)
    assert np.allclose(m.expected(np.concatenate(texts), ends), want, atol=1e-9)
    assert m.expected(np.zeros(0, np.uint16), np.array([0])).sum() == 0
    same = np.concatenate([texts[1]] * 10)  # equal lengths: segments end where texts do
    assert np.allclose(m.expected(same, np.arange(11) * 90), 10 * plain_counts(m, texts[1])[0].astype(float), atol=1e-8)
    assert [b - a for a, b in hmm.groups(ends, 95)] == [3, 1, 1, 1]


def test_baum_welch_never_lowers_the_likelihood():
    rng = np.random.default_rng(2)
    text, ends = rng.integers(0, 6, 300).astype(np.uint16), np.array([0, 300])
    m, before = small_model(3), -np.inf
    for _ in range(6):
        now = m.log10(text, ends)[0]
        assert now >= before - 1e-9
        before, c = now, m.expected(text, ends)
        start, move, emit = np.split(c, [hmm.STATES, hmm.STATES + hmm.STATES**2])
        assert abs(start.sum() - 1) < 1e-9 and abs(move.sum() - 299) < 1e-9
        move, emit = move.reshape(hmm.STATES, -1), emit.reshape(hmm.STATES, -1)
        m = hmm.Model(start, move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


@pytest.mark.parametrize("rounds", [0, 1])
def test_scores_against_the_plain_model(spark, rounds):
    """Classes, masses, Baum-Welch and likelihood made anew with loops; words that are known, joined, and unknown."""
    draw = random.Random(5)
    word = lambda: f"w{min(int(draw.expovariate(0.01)), 700)}"
    rows = [(i, " ".join(word() for _ in range(draw.choice([0, 1, 5, 40, 90])))) for i in range(40)] + [(99, "never seen W1"), (98, None)]
    learn = lambda i: i < 30
    got = hmm.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") < 30, rounds=rounds, sent=300).collect()
    counts = Counter(t for i, x in rows if learn(i) for t in tokens(x) if t is not None)
    code = {t: hmm.word_hashes(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0][0] for i, x in rows for t in tokens(x) if t is not None}
    own = {t: c for c, t in enumerate(sorted(counts, key=lambda t: (-counts[t], np.int64(code[t].view(np.int64))))[: hmm.OWN_CLASSES])}
    of = lambda t: hmm.END if t is None else own.get(t, hmm.OWN_CLASSES + int(code[t]) % hmm.SHARED_CLASSES)
    mass = np.array([1.0 if c >= hmm.OWN_CLASSES or c >= len(own) else 0.0 for c in range(hmm.CLASSES)])
    for t, n in counts.items():
        mass[of(t)] += n + 1
    n_end = sum(learn(i) for i, _ in rows)
    mass[hmm.END] = n_end + 1
    m = hmm.Model.first(mass)
    for _ in range(rounds):
        m = hmm.Model.of_counts(sum(plain_counts(m, [of(t) for t in tokens(x)])[0] for i, x in rows if learn(i)).astype(float), mass)
    want = {}
    for i, x in rows:
        own_tokens = tokens(x)
        p = float(np.log10(plain_counts(m, [of(t) for t in own_tokens])[1]))
        want[i] = p + sum(math.log10(((n_end if t is None else counts[t]) + 1) / mass[of(t)]) for t in own_tokens)
    assert all(abs(r.score - want[r.doc_id]) < 1e-6 for r in got) and len(got) == len(rows)


def test_shares_of_classes_add_up(spark):
    """Of all texts of one word, known or standing for a shared class, and the empty one: their probabilities by the model are shares of one."""
    texts = ["a b c c d", "e a e a", ""]
    single = ["", *"abcde"]
    docs = spark.createDataFrame([*enumerate(texts), *((10 + i, t) for i, t in enumerate(single))], "doc_id long, text string")
    got = {r.doc_id: 10**r.score for r in hmm.score_texts(docs, F.col("doc_id") < 3, rounds=2).collect()}
    assert all(0 < got[10 + i] < 1 for i in range(6)) and 0 < sum(got[10 + i] for i in range(6)) < 1


def exact(vectors, queries, k):
    out = {}
    for i, x in queries:
        found = sorted((float(np.sqrt(((x - y) ** 2).sum())), j) for j, y in vectors if j != i)
        out[i] = found[:k]
    return out


def test_recall(spark):
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = {}
    for r in op4_nearest(spark, SF).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = exact(rows, [r for r in rows if r[0] % 100 == 0], 10)
    hits = 0
    for i, found in want.items():
        own = sorted(got[i])
        assert [r for r, _, _ in own] == list(range(1, 11)) and [s for _, _, s in own] == sorted(s for _, _, s in own)
        by_id = dict(rows)
        assert all(abs(s - float(np.sqrt(((by_id[i] - by_id[j]) ** 2).sum()))) < 1e-12 for _, j, s in own)
        hits += len({j for _, j in found} & {j for _, j, _ in own})
    assert set(got) == set(want) and hits >= 0.9 * 10 * len(want)


def searched(x, every, parts=1, confidence=nearest.CONFIDENCE):
    """Share of rows left open for a query, and recall among them."""
    codes, ids = nearest.Codes(x[: nearest.SAMPLE_ROWS]), np.arange(len(x))
    centre, packed, sizes = codes.encode(x)
    asked, pairs = ids[::every], []
    for part in range(parts):
        search = nearest.Search(codes, 10, confidence, asked, x[asked])
        for c in np.unique(centre):
            rows = np.flatnonzero((centre == c) & (ids % parts == part))
            if len(rows):
                search.add(int(c), ids[rows], ids[rows], packed[rows], sizes[rows])
        query, name, *_ = search.left()
        pairs += zip(asked[query].tolist(), name.tolist(), strict=True)
    hits, found = 0, set(pairs)
    for i in asked.tolist():
        away = ((x - x[i]) ** 2).sum(1)
        away[i] = np.inf
        hits += sum((i, j) in found for j in np.lexsort((ids, away))[:10].tolist())
    return len(pairs) / len(asked) / len(x), hits / len(asked) / 10


def test_codes_decide(spark):
    """Few rows are left to be measured, and the nearest are among them; with an unlimited bound for certain."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()
    rng = np.random.default_rng(11)
    unit = rng.standard_normal((20_000, 64))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    copies = rng.standard_normal((6_000, 16))
    copies[2000:] = copies[0] + 1e-6 * rng.standard_normal((4_000, 16))
    for name, x in (("table", np.array([r.embedding for r in table], float)), ("unit vectors", unit), ("a group of near copies", copies)):
        share, recall = searched(x, 40)
        print(f"{name}: {share:.2%} of rows measured for a query, recall {recall:.3f}")
        assert share <= 0.1 and recall >= 0.99
        assert searched(x, 400, confidence=math.inf)[1] == 1.0
    assert searched(unit, 400, parts=4)[0] <= 0.1


@pytest.mark.parametrize("noise", [0.0, 1e-9, 1e-3])
def test_groups_of_copies_larger_than_what_is_reranked(spark, noise):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((6000, 16))
    x[2000:] = x[0] + noise * rng.standard_normal((4000, 16))
    ids = rng.permutation(6000)
    rows = [(int(i), v) for i, v in zip(ids, x, strict=True)]
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")
    got = nearest.nearest(vectors, F.col("vec_id") % 200 == 0, k=10).orderBy("query_id", "rank").collect()
    want = exact(rows, [r for r in rows if r[0] % 200 == 0], 10)
    assert [(r.query_id, r.vec_id) for r in got] == [(i, j) for i in sorted(want) for _, j in want[i]]


def test_a_whole_block_against_all_pairs(spark):
    """Unit vectors without structure, the hardest for codes, in blocks as large as they get."""
    x = np.random.default_rng(11).standard_normal((20_000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = nearest.nearest(vectors, F.col("vec_id") % 1000 == 0, k=10).orderBy("query_id", "rank").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for q in range(0, 20_000, 1000):
        away = np.sqrt(((x - x[q]) ** 2).sum(1))
        away[q] = np.inf
        assert [r.vec_id for r in got if r.query_id == q] == np.lexsort((np.arange(len(x)), away))[:10].tolist()


def test_equal_rows_are_candidates_each(spark):
    rows = [(i, [1.0, 0.5]) for i in range(30)] + [(1, [1.0, 0.5])] * 3 + [(0, [1.0, 0.5])] * 20 + [(100, [1.0, 0.4])]
    got = nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0, k=6).orderBy("query_id", "rank").collect()
    assert [r.vec_id for r in got] == [1, 1, 1, 1, 2, 3] + [0] * 6


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.5]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 0.5]), (8, [1.0]), (None, [1.0, 1.0]), (0, [1.0, 0.1])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS x", "2 AS block")
    got = [(r.query_id, r.rank, r.vec_id) for r in nearest.nearest(vectors, F.col("vec_id") % 100 == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 7)]
    assert nearest.nearest(vectors.limit(0), F.lit(True)).collect() == []


def test_very_large_and_small_numbers(spark):
    rows = [(0, [1e200, 0.0]), (1, [1e200, 1e199]), (2, [1.0, 0.0]), (3, [3e200, 0.0]), (4, [1e-200, 0.0]), (5, [1e-200, 1e-201]), (6, [1.7e308, 0.0]), (7, [-1.7e308, 0.0])]
    rows += [(10 + i, [1.0, i / 7]) for i in range(20)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in nearest.nearest(vectors, F.col("vec_id").isin(0, 4, 6, 12), k=3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert [i for i, _ in got[0]] == [1, 2, 4] and got[0][0][1] == pytest.approx(1e199)
    assert [i for i, _ in got[4]] == [5, 2, 10] and got[4][0][1] == pytest.approx(1e-201)
    assert [i for i, _ in got[6]] == [0, 1, 2] and [i for i, _ in got[12]] == [11, 13, 2]
    assert nearest.nearest(vectors.where("vec_id in (0, 1, 3)"), F.col("vec_id") == 0).count() == 2


def test_parallel_errors_weigh_more():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)

    def parallel(threshold):
        q = nearest.Quantiser(x, threshold)
        codes = q.encode(x)
        back = q.books[np.arange(q.parts), codes].reshape(len(x), -1)
        return np.mean(((x - back) * x).sum(1) ** 2)

    assert parallel(0.5) < parallel(0.0)


@pytest.mark.parametrize("size", [6, 7])
def test_scan_adds_up_the_tables(size):
    rng = np.random.default_rng(6)
    x, q = rng.standard_normal((200, size)), rng.standard_normal((3, size))
    model = nearest.Quantiser(x)
    codes = model.encode(x)
    back = model.books[np.arange(model.parts), codes].reshape(len(x), -1)[:, :size]
    assert np.allclose(model.scan(q, model.packed(codes)), q @ back.T, atol=1e-4)
