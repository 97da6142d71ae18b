"""Components against all pairs, signatures against the pigeonhole's promise."""

import random
import re

import numpy as np
import pytest

from tidemark.llm import components as components_module
from tidemark.llm import ngram_join
from tidemark.llm.components import components, forest
from tidemark.llm.spread import order_key


def sets_of(rows, n):
    out = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    return out


def brute(rows, n, percent):
    sets, root = sets_of(rows, n), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        least[find(i)] = min(key, least.get(find(i), key))
    return sorted((key, len(sets[i]), least[find(i)]) for i, (key, _) in enumerate(rows))


@pytest.mark.parametrize(("n", "percent", "block"), [(3, 90, 384), (5, 80, 8), (5, 80, 3), (1, 60, 2)])
def test_components(docs, n, percent, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", block)  # with few, the group of near copies is a family of several blocks
    monkeypatch.setattr(ngram_join, "HUBS", 2)
    monkeypatch.setattr(ngram_join, "COMMON_IN_ALL", 4)
    rows = [tuple(r) for r in docs.select(order_key(), "text").collect()]
    got = sorted((r.k, r.n_shingles, r.component) for r in ngram_join.near_duplicates(docs, n, percent).collect())
    assert got == brute(rows, n, percent)


@pytest.mark.parametrize(("block", "whole"), [(16, True), (1, False)])
def test_a_large_family_is_compared_by_few_rows(spark, monkeypatch, block, whole):
    """Near copies share many buckets; they are sent with their family, unless it is so large that its buckets are less."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    draw = random.Random(8)
    base, rows = [f"w{i}" for i in range(200)], []
    for i in range(160):  # some are copies of the base, others have drifted too far from it
        copy = list(base)
        for at in draw.sample(range(200), draw.choice([1, 2, 5, 8])):
            copy[at] = f"x{i}-{at}"
        rows.append((i, " ".join(copy)))
    sent, seen, across, crosswise = [], {}, ngram_join._across, ngram_join._crosswise

    def spied(members, labelled):
        out = across(members, labelled)
        seen.update(members=members.count(), classes=labelled.count(), groups=out.count())
        return out

    def counted(groups):
        sent.append((out := crosswise(groups)).count())
        return out

    monkeypatch.setattr(ngram_join, "_across", spied)
    monkeypatch.setattr(ngram_join, "_crosswise", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.k, r.n_shingles, r.component) for r in ngram_join.near_duplicates(docs, 5, 80).collect())
    assert got == brute(rows, 5, 80)
    assert seen["classes"] > 100 and seen["members"] > 8 * seen["classes"]
    if whole:
        assert 0 < sent[0] <= seen["members"]
    assert (seen["groups"] <= seen["classes"]) == whole


def test_keep_one_takes_the_least_id(docs):
    kept = [r.doc_id for r in ngram_join.keep_one(docs, 3, 90).collect()]
    assert set(kept) >= {7, 400, 402} and not set(kept) & set(range(300, 306))
    assert ngram_join.keep_one(docs).columns == docs.columns


def test_keep_one_takes_one_row_of_repeated_ones(docs, spark):
    a, b, c, d, e = ("".join(f"{x}{i} " for i in range(30)) for x in "abcde")
    rows = [(1, a), (1, a), (2, a), (1, b), (None, c), (None, c), (3, ""), (3, ""), (4, ""), (5, d), (0, d), (5, e), (1, f"{a} a0 a1"), (6, None), (None, b)]
    got = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    left = sorted((str(r.doc_id), r.text or "") for r in got if r.text not in (a, f"{a} a0 a1"))
    assert left == sorted([("1", b), ("None", c), ("3", ""), ("4", ""), ("0", d), ("5", e), ("6", "")])
    assert [r.doc_id for r in got if r.text in (a, f"{a} a0 a1")] == [1]
    once = sorted(map(repr, ngram_join.keep_one(docs).collect()))
    assert sorted(map(repr, ngram_join.keep_one(docs.unionAll(docs)).collect())) == once


def test_similar_sets_share_a_signature():
    """For pairs at the very threshold, at many sizes."""
    draw = random.Random(1)
    for percent in (80, 90):
        for _ in range(400):
            size = draw.randrange(10, 400)
            a = {draw.getrandbits(63) for _ in range(size)}
            b = set(a)
            while True:  # as many changes as the threshold bears
                c = set(b)
                if draw.random() < 0.5:
                    c.discard(draw.choice(sorted(c)))
                else:
                    c.add(draw.getrandbits(63))
                if 100 * len(a & c) < percent * len(a | c):
                    break
                b = c
            keys = np.concatenate([np.array(sorted(s), np.uint64) for s in (a, b)])
            known = keys[np.random.default_rng(size).random(len(keys)) < draw.choice([0, 0.3, 0.9])]
            sig, who = ngram_join.signatures(keys, np.array([0, len(a), len(a) + len(b)]), percent, np.sort(known))
            assert a == b or set(sig[who == 0]) & set(sig[who == 1]), (percent, len(a), len(b))


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(5, 5)]
    random.Random(2).shuffle(links)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(80)}


def least_nodes(links):
    root = {x: x for link in links for x in link}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in root}


@pytest.mark.parametrize("seed", range(8))
def test_forest(seed):
    draw = random.Random(seed)
    links = [(draw.randrange(-60, 60), draw.randrange(-60, 60)) for _ in range(10 * seed)]
    x, y = forest(np.array([a for a, _ in links], np.int64), np.array([b for _, b in links], np.int64))
    assert dict(zip(x.tolist(), y.tolist(), strict=True)) == {k: v for k, v in least_nodes(links).items() if k != v}


@pytest.mark.parametrize("held", [3, 2**19])
def test_components_of_odd_graphs(spark, held, monkeypatch):
    """A long path in no order, a hub above its nodes, and sparse and negative nodes."""
    monkeypatch.setattr(components_module, "HELD", held)
    draw = random.Random(6)
    path = draw.sample(range(10_000, 20_000), 700)
    links = list(zip(path, path[1:], strict=False)) + [(90_000, 30_000 + i) for i in range(300)]
    links += [(draw.randrange(-900, 900), draw.randrange(-900, 900)) for _ in range(700)]
    draw.shuffle(links)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()}
    assert got == {k: v for k, v in least_nodes([x for x in links if x[0] != x[1]]).items()}


def test_components_start_few_tasks(spark):
    """A step's cost is its tasks, if there are many partitions and few rows in each."""
    draw = random.Random(7)
    links = [(1000 * g + i, 1000 * g + draw.randrange(5)) for g in range(40) for i in range(30) for _ in range(4)]
    table = spark.createDataFrame(links, "a long, b long").coalesce(1)
    sc, n = spark.sparkContext, 24
    conf = {"spark.sql.shuffle.partitions": str(n), "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {key: spark.conf.get(key) for key in conf}
    for key, value in conf.items():
        spark.conf.set(key, value)
    sc.setJobGroup("few", "")
    try:
        got = {r.node: r.component for r in components(table).collect()}
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for key, value in before.items():
            spark.conf.set(key, value)
    assert got == {k: v for k, v in least_nodes([x for x in links if x[0] != x[1]]).items()}
    tracker = sc.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("few") for s in tracker.getJobInfo(j).stageIds}
    assert 2 * n < sum(i.numCompletedTasks for s in stages if (i := tracker.getStageInfo(s))) < 14 * n


def test_families_that_a_task_compares_whole_are_settled_there(docs, monkeypatch):
    """Components are looked for among buckets, and not again among the links found."""
    calls = []
    monkeypatch.setattr(ngram_join, "components", lambda links: calls.append(1) or components(links))
    rows = [tuple(r) for r in docs.select(order_key(), "text").collect()]
    got = sorted((r.k, r.n_shingles, r.component) for r in ngram_join.near_duplicates(docs, 3, 90).collect())
    assert got == brute(rows, 3, 90)
    assert len(calls) == 1


def test_empty(empty):
    assert ngram_join.near_duplicates(empty).collect() == []
    assert ngram_join.keep_one(empty).collect() == []


def test_refuses_odd_parameters(docs):
    with pytest.raises(ValueError):
        ngram_join.near_duplicates(docs, percent=20)


@pytest.mark.parametrize("percent", [80, 90])
@pytest.mark.parametrize("share", [0.0, 0.3, 0.6, 0.85, 1.0])
def test_similar_sets_share_a_signature_where_many_shingles_are_common(percent, share):
    """For each share of common shingles: sets at the very threshold meet, whatever units their thin segments cost them."""
    rng = np.random.default_rng(int(share * 100) + percent)
    common = np.sort(rng.integers(1, 2**63, 4000).astype(np.uint64))
    sets = []
    for _ in range(400):
        size = int(rng.integers(1, 140))
        draw = lambda k: np.where(rng.random(k) < share, rng.choice(common, k), rng.integers(1, 2**63, k).astype(np.uint64))
        base = np.unique(draw(size))
        for _ in range(3):
            change = int(rng.integers(0, len(base) * (100 - percent) // 100 + 1))
            cut = int(rng.integers(0, change + 1))
            sets.append(np.unique(np.concatenate([rng.permutation(base)[cut:], draw(change - cut)])))
    key, first = np.concatenate(sets), np.cumsum([0, *map(len, sets)])
    value, who = ngram_join.signatures(key, first, percent, common)
    own = [set() for _ in sets]
    for v, w in zip(value.tolist(), who.tolist(), strict=True):
        own[w].add(v)
    seen = 0
    for i in range(0, len(sets), 3):
        for a, b in ((i, i + 1), (i, i + 2), (i + 1, i + 2)):
            both = len(np.intersect1d(sets[a], sets[b]))
            either = len(sets[a]) + len(sets[b]) - both
            if both < either and 100 * both >= percent * either:  # equal sets are one class before
                seen += 1
                assert own[a] & own[b]
    assert seen > 100


def test_neighbourhoods_stand_in_for_thin_segments():
    """A set half of common shingles doesn't index its common segments, but neighbourhoods of the others."""
    rng = np.random.default_rng(5)
    common = np.sort(rng.integers(1, 2**63, 60).astype(np.uint64))
    sets = [np.unique(np.concatenate([common, rng.integers(1, 2**63, 40).astype(np.uint64)])) for _ in range(50)]
    value, who = ngram_join.signatures(np.concatenate(sets), np.cumsum([0, *map(len, sets)]), 80, common)
    assert np.bincount(who).max() > ngram_join.band(int(ngram_join.band_of(np.array([100]), 80)[0]), 80)[2]  # more than one for each segment
    _, shared = np.unique(value, return_counts=True)
    assert shared.max() < 5


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_bits_tell_large_sets_apart_and_refuse_no_similar_ones(percent):
    """Sets around the numbers at which bits double, at the very threshold and with little in common."""
    rng = np.random.default_rng(percent)
    sets = []
    for n in (1, 2, 9, 255, 256, 257, 511, 514, 1100, 4096, 4100):
        base = rng.integers(0, 2**64, n, np.uint64)
        sets += [base, base[: max(1, -(-n * percent // 100))], np.concatenate([base, rng.integers(0, 2**64, n * (100 - percent) // percent, np.uint64)])]
        sets += [np.concatenate([base[: n // 10], rng.integers(0, 2**64, n - n // 10, np.uint64)])]
    sets = [np.unique(s) for s in sets]
    size = np.array([len(s) for s in sets])
    bits = ngram_join.parities(np.concatenate(sets), np.concatenate([[0], np.cumsum(size)]))
    may, linked = ngram_join.possible(bits, size, percent), ngram_join.similar(sets, percent)
    assert (may == may.T).all() and linked.sum() >= 40 and not (linked & ~may).any()
    if percent >= 80:
        assert not (may & ~linked)[:, size >= 255][size >= 255].any()


def test_long_texts_that_share_a_passage_are_not_sent(spark, monkeypatch):
    """They meet in buckets if no shingle is known to be common, the more of them the more there are, but only near copies have their sets compared."""
    monkeypatch.setattr(ngram_join, "COMMON", 0)
    draw, sent, met = random.Random(12), [], []
    passage = " ".join(f"p{i}" for i in range(120))
    texts = [f"{passage} {' '.join(f'w{draw.randrange(10**6)}' for _ in range(2000))}" for _ in range(60)]
    rows = [*enumerate(texts), *((100 + i, f"{texts[0]} end{i}") for i in range(3))]
    linked, buckets = ngram_join._linked, ngram_join.buckets
    monkeypatch.setattr(ngram_join, "_linked", lambda *a: sent.append(a[3].count()) or linked(*a))
    monkeypatch.setattr(ngram_join, "buckets", lambda *a: met.append(buckets(*a)) or met[0])
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted((r.k, r.n_shingles, r.component) for r in ngram_join.near_duplicates(docs, 5, 80).collect())
    assert got == brute(rows, 5, 80)
    assert met[0].select("c").distinct().count() > 30
    assert sent == [4]
