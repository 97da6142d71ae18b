import pickle
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate
from tidemark.llm.spread import cut

ROWS = "doc_id long, text string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window):
    patterns = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            patterns.setdefault(tuple(w[i : i + window]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(p) for p in patterns}:
            for i in range(len(w) - size + 1):
                if own := patterns.get(tuple(w[i : i + size])):
                    hit |= set(range(i, i + size))
                    found |= own - {None}
        out.append((str(doc), len(w), len(hit), sorted(found)))
    return sorted(out)


def tables(seed):
    draw = random.Random(seed)
    text = lambda n: "".join(draw.choice(["aa", "Bb", "cc", "é", "d1"]) + draw.choice([" ", ", ", "\n", "--"]) for _ in range(n))
    items = [(i - 8, text(draw.randrange(1, 14))) for i in range(25)] + [(90, ""), (91, None), (92, "?!"), (3, text(12)), (93, "zz"), (None, text(9)), (94, text(400))]
    docs = [(i, text(draw.randrange(0, 300))) for i in range(30)] + [(40, None), (41, ""), (None, items[0][1]), (42, text(2000)), (0, "zz"), (43, "x" * 50_000)]
    docs += [(80 + (45 if i is None else i), f"{text(20)} {t} {text(9)}") for i, t in items if t]
    return docs, items


@pytest.mark.parametrize(("seed", "window"), [(1, 4), (2, 7), (3, 1)])
def test_against_brute_force(spark, seed, window):
    docs, items = tables(seed)
    found = decontaminate.find_items(spark.createDataFrame(docs, ROWS), spark.createDataFrame(items, "item_id long, text string"), window)
    got = [(str(r.doc_id), r.n_words, r.n, sorted(r["items"])) for r in found.withColumn("n", decontaminate.hit_words()).collect()]
    assert sorted(got) == brute(docs, items, window)


def test_blocks_find_the_same(spark):
    docs, items = tables(5)
    left, right = spark.createDataFrame(docs, ROWS), spark.createDataFrame(items, "item_id long, text string")
    rows = lambda **k: sorted(map(repr, decontaminate.find_items(left, right, 4, **k).collect()))
    assert rows(block_bytes=100) == rows()


def test_blocks_write_little(spark, monkeypatch):
    """Ten blocks write rows of the texts that they hit, once for each text, and nothing of the others."""
    written = []
    monkeypatch.setattr(decontaminate, "cut", lambda df: written.append(cut(df)) or written[-1])
    docs = [(i, f"clean text {i} " * 50) for i in range(200)] + [(900 + i, "x1 x2 x3 x4") for i in range(90)]
    items = [(i, f"y{i} z{i}") for i in range(40)] + [(-5, "x2 x3"), (-6, "x3 x4")]
    found = decontaminate.find_items(spark.createDataFrame(docs, ROWS), spark.createDataFrame(items, "item_id long, text string"), 2, block_bytes=22)
    assert sorted({(r.doc_id >= 900, tuple(r["items"])) for r in found.collect()}) == [(False, ()), (True, (-6, -5))]
    assert len(written) > 8 and sum(w.count() for w in written) <= 4


def test_ids_of_another_type(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None), (3, "c")], ROWS)
    found = decontaminate.find_items(docs, spark.createDataFrame([("x-1", "a b"), ("x-0", "c"), (None, "b")], "item_id string, text string"), 2)
    assert {r.doc_id: r["items"] for r in found.collect()} == {1: ["x-0", "x-1"], 2: [], 3: ["x-0"]}


def test_tables_skip(spark):
    """The search looks at far fewer places than there are words."""
    t = decontaminate.tables([(1, " ".join(f"p{i}" for i in range(10)))], 10)[0]
    assert t.shift.max() == 9 and (t.shift == 0).sum() == 1


def test_tables_are_arrays():
    """A benchmark of a block's size takes a bounded multiple of its text, and equal windows are one pattern."""
    draw = random.Random(1)
    items = [(i, " ".join(f"w{draw.randrange(5000)}" for _ in range(2000))) for i in range(40)]
    size = sum(len(t) for _, t in items)
    assert len(pickle.dumps(decontaminate.tables(items, 10))) < 13 * size + 2**20
    same = decontaminate.tables([(i, "a b c d e") for i in range(900)] + [(None, "a b c d e")], 5)[0]
    assert len(same.at) == 1 and sorted(same.items(0)) == list(range(900))


def test_items_without_id_contaminate(spark, docs):
    kept = decontaminate.drop_contaminated(docs, spark.createDataFrame([(None, "one")], "item_id long, text string"))
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()} == {403, 404}


def test_clean_rows_keep_their_columns(spark, docs):
    items = spark.createDataFrame([(1, "one")], "item_id long, text string")
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()} == {403, 404}


def test_empty(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_items(empty.select("doc_id", "text"), none).collect() == []
    assert decontaminate.find_items(docs, none).where(F.size("items") > 0).count() == 0
