import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import lexical

ROWS = "doc_id long, text string"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    own = [(i, Counter(terms(t))) for i, t in docs]
    n = sum(1 for _, c in own if c)
    total = sum(c.total() for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in {(i, t) for i, t in items}:
        scored = []
        for doc, c in own:
            m = 25 + 75 * c.total() * n // total if total else 25
            score = sum(many * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, many in Counter(terms(text)).items() if c[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def tables(seed, documents=150):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "日本", "Zz", "x1"]
    text = lambda n: "".join(draw.choices(vocabulary, [1 / (i + 1) for i in range(len(vocabulary))])[0] + draw.choice([" ", ", ", "\n", "--", "_"]) for _ in range(n))
    docs = [(i - 20, text(draw.randrange(1, 80))) for i in range(documents)]
    docs += [(900, None), (901, ""), (902, "?! _"), (None, text(30)), (None, text(30)), (3, docs[5][1]), (904, text(20_000)), (905, "w1 " * 3000)]
    docs += [(1000 + i, docs[2][1]) for i in range(30)] + [(1000, docs[2][1])]  # ties and repeated rows
    draw.shuffle(docs)
    items = [(i, text(draw.randrange(1, 25))) for i in range(20)] + [(-4, docs[2][1]), (50, None), (51, ""), (52, "~~"), (53, "nowhere"), (None, text(4)), (7, "w3 w3 W3 zz"), (54, text(900))]
    return docs, items + items[:3]


def rows(found):
    return sorted((tuple(r) for r in found.collect()), key=str)


@pytest.mark.parametrize(("seed", "k"), [(1, 10), (2, 3), (3, 400)])
def test_against_brute_force(spark, seed, k):
    docs, items = tables(seed)
    found = lexical.search(spark.createDataFrame(docs, ROWS).repartition(5), spark.createDataFrame(items, "item_id long, text string"), k)
    assert rows(found) == brute(docs, items, k)


def test_small_shards_and_blocks_find_the_same(spark, monkeypatch):
    docs, items = tables(4)
    left, right = spark.createDataFrame(docs, ROWS), spark.createDataFrame(items, "item_id long, text string")
    assert rows(lexical.search(left, right, 5, block_bytes=200)) == brute(docs, items, 5)
    texts = [(i, t) for i, t in items if t]
    found = lexical.Terms(texts)
    data = [(t or "").encode() for _, t in docs]
    n, text, term, count = found.counts(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    weight = np.full(len(found), 700)
    ids, null = np.array([i or 0 for i, _ in docs]), np.array([i is None for i, _ in docs])
    whole = lexical.Heaps(found, weight, 100, 4000, 5)
    whole.add(ids, null, n, text, term, count)
    whole.close()
    monkeypatch.setattr(lexical, "SHARD_POSTINGS", 1)
    monkeypatch.setattr(lexical, "CURSORS", 8)
    parts = lexical.Heaps(found, weight, 100, 4000, 5)
    for d in range(len(docs)):
        own = text == d
        parts.add(ids[d : d + 1], null[d : d + 1], n[d : d + 1], text[own] - d, term[own], count[own])
    parts.close()
    assert (parts.score == whole.score).all() and (parts.id == whole.id).all() and (parts.null == whole.null).all()


def test_skips_documents_that_cannot_win():
    """Of many documents with a common term and few with a rare one, few are scored."""
    draw = np.random.default_rng(1)
    n = 20_000
    rare = np.sort(draw.choice(n, 200, replace=False))
    term = np.concatenate([np.zeros(n, np.int64), np.ones(200, np.int64)])
    doc = np.concatenate([np.arange(n), rare])
    impact = np.concatenate([draw.integers(1, 10, n), draw.integers(500, 600, 200)])
    index = lexical.Index(term, doc, impact, n, 2)
    found, score, looked_at = lexical.wand(index, np.array([[0, 1]]), np.ones((1, 2), np.int64), np.zeros(1, np.int64), 10)
    total = np.bincount(doc, impact, n)
    best = np.lexsort((np.arange(n), -total))[:10]
    assert found[0].tolist() == best.tolist() and score[0].tolist() == total[best].tolist()
    assert looked_at < 600


def test_terms_of_one_hash_are_told_apart(monkeypatch):
    class Weak(lexical.Rolling):
        def at(self, start, end):
            return super().at(start, end) % np.uint64(3)

    monkeypatch.setattr(lexical, "Rolling", Weak)
    terms_ = lexical.Terms([(1, "aa bb cc dd aab abb ee")])
    data = b"bb cc zz aa abb aac dd dd"
    n, text, term, count = terms_.counts(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    assert n.tolist() == [8] and dict(zip(term.tolist(), count.tolist(), strict=True)) == {0: 1, 1: 1, 2: 1, 3: 2, 5: 1}


def test_long_documents_do_not_overflow():
    heaps = lexical.Heaps(lexical.Terms([(1, "a")]), np.array([5]), 10**10, 10**13, 3)
    assert heaps.length(np.array([10**8, 10])).tolist() == [25 + 75 * 10**8 * 10**10 // 10**13, 25]


def test_empty_tables_and_other_columns(spark, docs, empty):
    items = spark.createDataFrame([(1, "w1 w2")], "item_id long, text string")
    assert lexical.search(empty, items).collect() == []
    assert lexical.search(docs, items.limit(0)).collect() == []
    clash = items.selectExpr("*", "1 AS doc_id", "2 AS score", "3 AS rank")
    found = lexical.search(docs, clash)
    assert found.columns == ["item_id", "rank", "doc_id", "score"] and rows(found) == rows(lexical.search(docs, items)) != []
