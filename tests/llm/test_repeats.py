"""Removal of repeats against a scan of every window, and the recursion on tricky texts."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import substring_dedup, suffix_dedup
from tidemark.llm.repeats import ALONE, CROWDED, SHARED, Bucketed, bucket_kinds, seeds_of
from tidemark.llm.spread import order_key
from tidemark.llm.substring_dedup import extend, remove_repeated_passages
from tidemark.llm.suffix_dedup import pointers, refine, remove_repeated_bytes


def brute(rows, split, length):
    """For each row (key, text): units, and flags of those that go."""
    units = [split(t) for _, t in rows]
    seen, gone = {}, [[False] * len(u) for u in units]
    for pos in range(len(rows)):
        for i in range(len(units[pos]) - length + 1):
            w = tuple(units[pos][i : i + length])
            seen.setdefault(w, []).append((rows[pos][0], pos, i))
    for places in seen.values():
        least = min(k for k, _, _ in places)
        first_in_row = {}
        for k, pos, i in places:
            first_in_row[pos] = min(i, first_in_row.get(pos, i))
        for k, pos, i in places:
            if k > least or i > first_in_row[pos]:
                for j in range(i, i + length):
                    gone[pos][j] = True
    return units, gone


def keyed(docs):
    return [tuple(r) for r in docs.select(order_key().alias("key"), "text", "doc_id").collect()]


@pytest.mark.parametrize(("window", "anchor", "limit", "bits"), [(20, 8, 96, 64), (20, 8, 1, 64), (5, 2, 96, 64), (3, 3, 2, 64), (20, 8, 96, 12), (20, 8, 1, 12), (5, 2, 96, 12)])
def test_passages(docs, window, anchor, limit, bits, monkeypatch):
    """With hashes of 12 bits, too, when many different texts share one."""
    monkeypatch.setattr(substring_dedup, "BUCKET_SPANS", limit)  # with few, most anchors are crowded
    rows = keyed(docs)
    units, gone = brute([r[:2] for r in rows], lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or ""), window)
    want = sorted((d is None, d or 0, " ".join(w for w, g in zip(u, f, strict=True) if not g), len(u), sum(f)) for (_, _, d), u, f in zip(rows, units, gone, strict=True))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text, r.n_words, r.n_removed) for r in remove_repeated_passages(docs, window, anchor, bits).collect())
    assert got == want


@pytest.mark.parametrize(("length", "gram", "limit", "bits"), [(100, 32, 4096, 64), (100, 32, 1, 64), (12, 5, 4096, 64), (100, 32, 4096, 12), (100, 32, 1, 12)])
def test_bytes(docs, length, gram, limit, bits, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BUCKET_SPANS", limit)
    rows = keyed(docs)
    units, gone = brute([r[:2] for r in rows], lambda t: (t or "").encode(), length)
    want = []
    for (_, _, d), u, f in zip(rows, units, gone, strict=True):
        runs = sum(1 for i, g in enumerate(f) if g and not (i and f[i - 1]))
        want.append((d is None, d or 0, bytes(b for b, g in zip(u, f, strict=True) if not g), len(u), sum(f), runs))
    got = [(r.doc_id is None, r.doc_id or 0, bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) for r in remove_repeated_bytes(docs, length, gram, bits).collect()]
    assert sorted(got) == sorted(want)


def test_later_windows_lean_on_the_input(spark):
    """A window counts as earlier even if it is itself removed."""
    text = " ".join(f"v{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text), (2, text), (3, text + " tail")], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_removed) for r in remove_repeated_passages(docs).collect()}
    assert got == {1: (text, 0), 2: ("", 30), 3: ("tail", 30)}


def test_empty_tables(empty):
    assert remove_repeated_passages(empty).collect() == []
    assert remove_repeated_bytes(empty).collect() == []


def test_refuses_odd_sizes(docs):
    with pytest.raises(ValueError):
        remove_repeated_passages(docs, window=5, anchor=6)
    with pytest.raises(ValueError):
        remove_repeated_bytes(docs, length=0)


def bucketed(draw, length, gram, unit):
    """Spans around seeds of two buckets, cut out of few texts with changes: lists of units, and what the operators get."""
    rows, owner, seed, windows, sizes = [], [], [], [], []
    for bucket in range(2):
        core = [unit(draw, bucket + 2) for _ in range(gram)]
        sides = [[unit(draw, 2) for _ in range(2 * (length - gram))] for _ in range(3)]
        count = draw.randrange(2, 30)
        for _ in range(count):
            text = draw.choice(sides)[: length - gram] + core + draw.choice(sides)[length - gram :]
            if draw.random() < 0.5:
                at = draw.choice([i for i in range(len(text)) if not length - gram <= i < length])
                text[at] = unit(draw, 2)
            low = draw.randrange(length - gram + 1)
            high = draw.randrange(low, length - gram + 1)
            rows.append(text[low : high + length])
            seed.append(length - gram - low)
            windows.append(high - low + 1)
            owner.append(draw.randrange(8))
        sizes.append(count)
    return rows, np.array(seed), np.array(windows), np.array(owner), np.cumsum([0, *sizes])


def firsts(rows, windows, owner, length, width):
    least = {}
    for row, n, k in zip(rows, windows, owner, strict=True):
        for s in range(n):
            w = tuple(row[s : s + length])
            least[w] = min(k, least.get(w, k))
    return [[s < n and least[tuple(row[s : s + length])] == k for s in range(width)] for row, n, k in zip(rows, windows, owner, strict=True)]


def test_extension_and_refinement_against_every_window():
    draw = random.Random(6)
    for _ in range(40):
        for length, gram, fun, unit, join in (
            (20, 8, lambda b: extend(b, 20, 8), lambda d, n: b"w%d" % d.randrange(n), b" ".join),
            (100, 32, lambda b: refine(b, 100, 69), lambda d, n: bytes([97 + d.randrange(n)]), b"".join),
        ):
            rows, seed, windows, owner, ends = bucketed(draw, length, gram, unit)
            got = fun(Bucketed([join(r) for r in rows], seed, windows, owner, ends))
            want = np.array(firsts(rows, windows, owner, length, length - gram + 1))
            shown = np.arange(length - gram + 1) < windows[:, None]
            assert (got[shown] == want[shown]).all()


def test_rounds_of_refinement():
    """Pointers order the suffixes and are equal for equal bytes; rounds double the depth, and stop when all is settled."""
    draw = random.Random(8)
    data = np.array([draw.randrange(97, 99) for _ in range(300)] * 3, np.uint8)
    raw, room = data.tobytes(), np.arange(len(data), 0, -1)
    for depth, rounds in ((8, 0), (16, 1), (24, 2), (100, 4)):
        pointer, took = pointers(data, room, depth)
        whole = [i for i in range(len(raw)) if room[i] >= depth]
        assert took == rounds
        order = sorted(whole, key=lambda i: raw[i : i + depth])
        assert [raw[i : i + depth] for i in sorted(whole, key=lambda i: pointer[i])] == [raw[i : i + depth] for i in order]
        same = {}
        for i in whole:
            same.setdefault(raw[i : i + depth], set()).add(pointer[i])
        assert all(len(x) == 1 for x in same.values())
    settled = np.array([draw.randrange(256) for _ in range(500)], np.uint8)
    assert pointers(settled, np.arange(500, 0, -1), 100)[1] == 0


def test_a_passage_in_all_documents_meets_nowhere(spark):
    """One passage amid different words: its anchor's spans are crowded, and each range holds only a part of them."""
    batch = lambda gram, spans: pa.record_batch([pa.array(np.full(len(spans), gram)), pa.array(spans), pa.array(spans), pa.array(np.full(len(spans), 1 + (gram == 7)))], ["gram", "span", "k", "many"])
    kinds = next(bucket_kinds(iter([batch(1, np.arange(3)), batch(5, np.arange(2)), batch(6, np.arange(9)), batch(7, np.arange(1)), batch(9, np.arange(4))]), 5))
    assert kinds.column("kind").to_pylist() == [CROWDED] * 3 + [SHARED] * 2 + [CROWDED] * 9 + [ALONE] + [CROWDED] * 4
    assert kinds.column("many").to_pylist() == [False] * 14 + [True] + [False] * 4
    draw = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(24))
    rows = [(i, " ".join([*(f"w{draw.randrange(10**6)}" for _ in range(15)), passage, *(f"w{draw.randrange(10**6)}" for _ in range(15))])) for i in range(600)]
    got = {r.doc_id: r.n_removed for r in remove_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    assert got == {i: 24 * (i > 0) for i in range(600)}


def test_seeds_are_the_leftmost_least():
    """For texts of few different grams, too; and a run of one value costs no more than its length."""
    rng = np.random.default_rng(3)
    for alphabet in (1, 2, 5, 10**9):
        for _ in range(60):
            width = int(rng.integers(1, 12))
            grams = rng.integers(0, alphabet, int(rng.integers(width, 120))).astype(np.uint64)
            begin, seed = seeds_of(grams, width)
            got = seed[np.searchsorted(begin, np.arange(len(grams) - width + 1), side="right") - 1]
            assert got.tolist() == [i + int(np.argmin(grams[i : i + width])) for i in range(len(grams) - width + 1)]
            assert begin[0] == 0 and (np.diff(begin) > 0).all() and (np.diff(seed) > 0).all()
