import hashlib
import random
from collections import defaultdict
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from tidemark.llm import prefix_trie

ROWS = "conv_id long, turn long, role string, text string"


def brute(rows, rebuild):
    """Nodes by their whole sequences. Turns of one number have one digest order here: such rows are equal in the tests."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(turns)] for c, turns in convs.items()}
    if rebuild:
        h = {c: crc32(str(c).encode()) % 9 for c in own}
        whole = {c: own.get(c - (abs(c) % 5) * (1 if c >= 0 else -1), [])[: h[c]] + own[c][h[c] :] for c in own}
    else:
        whole = own
    members, ended, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c in sorted(whole):
        turns = tuple(whole[c])
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
            if d:
                children[turns[: d - 1]].add(turns[:d])
        ended[turns].append(c)
    worth = {p: (len(m) - 1) * len(p[-1][1].encode()) if p else 0 for p, m in members.items()}
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in members:
        for d in range(len(p) + 1):
            saved[p[:d]] += worth[p]
            leaves[p[:d]] += not children[p]
    return sorted(
        (m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, ended[p])).encode()).hexdigest())
        for p, m in members.items()
    )


def table(seed, conversations=60, longest=20):
    draw = random.Random(seed)
    texts = ["a", "b", "é" * 3, "", None, "a:b", "long " * 50]
    rows = []
    for c in range(-7, conversations):
        if c % 11 == 4:
            continue
        numbers = draw.sample(range(-5, 100), draw.randrange(1, longest))
        rows += [(c, n if i else None, draw.choice(["user", "assistant", "", None]), draw.choices(texts, [9, 5, 1, 1, 1, 1, 1])[0]) for i, n in enumerate(numbers)]
    same = [(n, "user", "a") for n in range(9)]
    rows += [(1000 + i, *s) for i in range(40) for s in same] + [(1003, *s) for s in same]  # copies; repeated rows
    rows += [(None, 1, "user", "a"), (2**40, 3, None, None), (77, 1, ":x", "y"), (78, 1, ":", "xy"), (79, 1, "1:", "y")]
    draw.shuffle(rows)
    return rows


def nodes(found):
    return sorted((tuple(r) for r in found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()))


def apply(df, rebuild):
    conv = F.col("conv_id")
    return prefix_trie.prefix_trie(df, conv - conv % 5, F.crc32(conv.cast("string")) % 9, 8) if rebuild else prefix_trie.prefix_trie(df)


@pytest.mark.parametrize(("seed", "rebuild"), [(1, True), (2, False)])
def test_against_brute_force(spark, seed, rebuild):
    rows = table(seed)
    assert nodes(apply(spark.createDataFrame(rows, ROWS).repartition(6), rebuild)) == brute(rows, rebuild)


def test_hot_keys_and_stretches(spark, monkeypatch):
    """A long conversation in stretches of few turns, keys over the limit dealt out, ids hashed a few at a time."""
    monkeypatch.setattr(prefix_trie, "STRETCH", 4)
    monkeypatch.setattr(prefix_trie, "IDS", 3)
    monkeypatch.setattr(prefix_trie, "limit_of", lambda df, rows: 3)
    rows = table(3, 25) + [(500, n, "user", str(n % 3)) for n in range(70)] + [(501, n, "user", str(n % 3)) for n in range(66)]
    assert nodes(apply(spark.createDataFrame(rows, ROWS), True)) == brute(rows, True)


def test_odd_tables(spark):
    empty = spark.createDataFrame([], ROWS)
    assert nodes(apply(empty, True)) == nodes(apply(empty, False)) == []
    # 3's hash asks for eight turns of conversation 0, which isn't there, and 3 has fewer itself
    gone = [(c, 0, "user", "x") for c in range(1, 200) if c % 5 and crc32(str(c).encode()) % 9 > 0][:5]
    found = nodes(apply(spark.createDataFrame(gone, ROWS), True))
    assert found == brute(gone, True) and len(found) == 1 and found[0][1:6] == (0, None, 5, 0, 1)
    clash = spark.createDataFrame(table(4, 10), ROWS).selectExpr("*", "1 AS depth", "2 AS name", "3 AS length", "4 AS digest", "5 AS at")
    assert nodes(apply(clash, True)) == brute(table(4, 10), True)
