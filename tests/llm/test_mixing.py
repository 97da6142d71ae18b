import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing


def poisson_cdf(rate, top):
    total, out = 0.0, []
    for k in range(top):
        total += math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1))
        out.append(total)
    return out


@pytest.mark.parametrize("rate", [0.01, 1.0, 7.5, 900.0])
def test_distribution(spark, rate):
    got = spark.range(1).select(mixing.cumulative(F.lit(rate)).alias("c")).first()[0]
    assert all(abs(a - b) < 1e-9 for a, b in zip(got, poisson_cdf(rate, len(got)), strict=True)) and got[-1] > 1 - 1e-9


@pytest.fixture(scope="module")
def sourced(spark):
    return spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 10 < 6, "big").when(F.col("id") % 10 < 9, "mid").alias("source"), F.lit(7).alias("copy"))


def test_mixture_meets_its_weights(sourced):
    got = Counter(r.source for r in mixing.mix_sources(sourced, {"big": 1.0, "mid": 3.0}).collect())
    assert set(got) == {"big", "mid"} and abs(got["big"] - 7500) < 4 * 7500**0.5 and abs(got["mid"] - 22500) < 4 * 22500**0.5
    level = Counter(r.source for r in mixing.mix_sources(sourced, total=9_000).collect())
    want = {s: n**0.5 for s, n in {"big": 18_000, "mid": 9_000, None: 3_000}.items()}
    for s, w in want.items():
        goal = 9_000 * w / sum(want.values())
        assert abs(level[s] - goal) < 4 * goal**0.5


def test_same_whatever_the_partitions(sourced):
    rows = lambda df: sorted((r.doc_id, r.copy) for r in mixing.mix_sources(df).collect())
    assert rows(sourced.repartition(1)) == rows(sourced.repartition(7))
    assert rows(sourced) != sorted((r.doc_id, r.copy) for r in mixing.mix_sources(sourced, seed=1).collect())


def test_joined_rates_are_the_same(sourced, monkeypatch):
    rows = lambda: sorted((r.doc_id, r.copy) for r in mixing.mix_sources(sourced).collect())
    sent = rows()
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert rows() == sent


def test_order_is_shuffled(sourced):
    ids = [r.doc_id for r in mixing.mix_sources(sourced).limit(2000).collect()]
    assert ids != sorted(ids) and max(ids) - min(ids) > 20_000


def test_any_rows(docs, empty):
    """Null, empty and very long texts, repeated and missing ids: each as often as the distribution at its number says."""
    out = mixing.mix_sources(docs)
    assert out.columns == [*docs.columns, "copy"]
    rows, got = docs.collect(), Counter((r.doc_id, r.text, r.source) for r in out.collect())
    sizes = Counter(r.source for r in rows)
    total = sum(n**0.5 for n in sizes.values())
    want = Counter()
    for r in rows:
        rate = sizes[r.source] ** 0.5 / total * len(rows) / sizes[r.source]
        key = hashlib.sha256((r.text or "").encode()).hexdigest() if r.doc_id is None else str(r.doc_id)
        u = int(hashlib.sha256(f"{mixing.SEED}:{key}".encode()).hexdigest()[:13], 16) / 2**52
        want[(r.doc_id, r.text, r.source)] += sum(c <= u for c in poisson_cdf(rate, 60))
    assert got == +want


def test_rows_without_id_are_spread(spark):
    same = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("u").alias("text"), F.lit("s").alias("source"))
    where = mixing.mix_sources(same, total=12_000).groupBy(F.spark_partition_id()).count().collect()
    assert len(where) == 4 and max(r["count"] for r in where) < 2 * sum(r["count"] for r in where) / 4


def test_refuses_negative_weights(docs, empty):
    assert mixing.mix_sources(empty).collect() == []
    with pytest.raises(ValueError):
        mixing.mix_sources(docs, {"s0": -1.0})


def test_main_path_has_no_python(docs):
    plan = mixing.mix_sources(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
