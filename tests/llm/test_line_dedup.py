import random

import numpy as np
import pytest

from tidemark.llm import line_dedup
from tidemark.llm.arrays import Rolling, mix
from tidemark.llm.spread import order_key


def chunks_of(text, roll, mean):
    """Chunks of one text by the rule, a line at a time: a chunk ends where the mixed hashes of the last lines say so, and at the end."""
    lines = text.split("\n")
    plain = lambda x: mix(np.array([x % 2**64], np.uint64))
    code = [Rolling(np.frombuffer(x.encode(), np.uint8)).at(np.array([0]), np.array([len(x.encode())]))[0] for x in lines]
    out, now = [], []
    for i, line in enumerate(lines):
        now.append(line)
        rolled = int(code[i])
        for back in range(1, roll):
            if i >= back:
                rolled = int(plain(rolled + int(plain(int(code[i - back]) + back)[0]))[0])
        if (i >= roll - 1 and rolled % mean == 0) or i == len(lines) - 1:
            out.append(now)
            now = []
    return out


def test_boundaries_by_the_rule():
    """Those of many texts side by side are those that the rule gives for each alone."""
    draw = random.Random(3)
    for roll, mean in ((2, 4), (1, 3), (3, 2)):
        texts = ["\n".join(draw.choice(["a", "b", "", "cc"]) for _ in range(draw.randrange(1, 40))) for _ in range(60)]
        raw = [t.encode() for t in texts]
        a, b, which, _, _ = line_dedup.chunks(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]), roll, mean)
        lines = [x for t in texts for x in t.split("\n")]
        got = [[lines[x:y] for x, y, w in zip(a, b, which, strict=True) if w == i] for i in range(len(texts))]
        assert got == [chunks_of(t, roll, mean) for t in texts]


def brute(rows, roll=line_dedup.ROLL_LINES, mean=line_dedup.MEAN_LINES, least=line_dedup.LEAST_LINES):
    owner = {}
    every = [[] if t is None else chunks_of(t, roll, mean) for _, t in rows]
    real = lambda c: len(c) >= least and any(c)
    for (key, _), parts in zip(rows, every, strict=True):
        for c in filter(real, parts):
            owner[tuple(c)] = min(key, owner.get(tuple(c), key))
    out = []
    for (key, text), parts in zip(rows, every, strict=True):
        seen, lines, gone = set(), [], 0
        for c in parts:
            if real(c) and (owner[tuple(c)] != key or tuple(c) in seen):
                gone += len(c)
            else:
                lines += c
                seen.add(tuple(c))
        out.append((key, None if text is None else "\n".join(lines), 1 if text is None else len(text.split("\n")), gone))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def lined(spark):
    poem = [f"line {i} of the poem" for i in range(40)]
    rows = [(i, "\n".join([f"own {i}", *poem[i : i + 20], f"end {i}", ""])) for i in range(12)]
    rows += [(50, "\n".join(poem + poem)), (51, "\n\n\n\n"), (52, ""), (53, None), (54, "single"), (55, "single"), (56, "a\r\nb\r\nc"), (57, "\n".join(poem) + "\n"), (3, "\n".join(poem)), (None, "\n".join(poem)), (None, "\n".join(poem)), (58, "x\n" * 5000)]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS k", "2 AS firsts", "'y' AS row")


def test_against_brute_force(lined):
    rows = [tuple(r) for r in lined.select(order_key(), "text").collect()]
    out = line_dedup.dedup_lines(lined)
    assert out.columns == ["doc_id", "text", "k", "firsts", "row", "n_lines", "n_removed"]
    originals = {}
    for r, (key, text) in zip(lined.collect(), rows, strict=True):
        originals.setdefault(r.doc_id, []).append(key)
    got = sorted(((originals[r.doc_id][0] if r.doc_id is not None else None, r.text, r.n_lines, r.n_removed) for r in out.collect()), key=repr)
    want = sorted(((k if k < 2**62 else None, t, n, g) for k, t, n, g in brute(rows)), key=repr)
    assert got == want


def test_boundaries_withstand_shifts():
    lines = [f"text {i}" for i in range(400)]
    before = {tuple(c) for c in chunks_of("\n".join(lines), 2, 4)}
    after = {tuple(c) for c in chunks_of("\n".join(["new", *lines]), 2, 4)}
    assert len(before - after) <= 2


def test_some_of_it_goes(lined):
    got = {r.doc_id: r for r in line_dedup.dedup_lines(lined).collect() if r.doc_id is not None}
    assert got[57].n_removed > 30 and got[0].n_removed == 0 and got[55].text == "single"


def test_empty(empty):
    assert line_dedup.dedup_lines(empty).collect() == []


