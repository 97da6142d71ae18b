"""Distributed selection against sorted values."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.model import TidemarkError
from tidemark.operators import selection

WANTED = {"least": ("nearest", 0.0), "p50": ("nearest", 0.5), "p90": ("nearest", 0.9), "middle": ("linear", 0.5), "third": ("linear", 1 / 3), "most": ("linear", 1.0)}


def brute(values, flavour, share):
    values = sorted(values)
    if flavour == "nearest":
        return values[max(0, math.ceil(len(values) * share) - 1)]
    at = (len(values) - 1) * share
    low, high = values[math.floor(at)], values[math.ceil(at)]
    return low if low == high or at == math.floor(at) else (math.ceil(at) - at) * low + (at - math.floor(at)) * high


def groups(seed):
    draw = random.Random(seed)
    inf = float("inf")
    return {
        "normal": [draw.gauss(0, 1) for _ in range(900)],
        "ties": [float(draw.randrange(4)) for _ in range(700)],
        "one": [3.5],
        "two": [-1.0, 8.0],
        "equal": [2.0] * 300,
        "tail": [2.0 ** draw.randrange(-300, 300) * draw.choice([-1, 1]) for _ in range(400)],
        "wide": [-1.7e308, 1.7e308, 0.0, 1.0, 2.0],
        "close": [1.0 + i * 2.0**-52 for i in range(200)],
        "tiny": [i * 5e-324 for i in range(100)],
        "infinite": [-inf, -inf, inf, *(float(i) for i in range(50))],
        None: [float(i) for i in range(77)],
    }


@pytest.mark.parametrize(("few", "ranges"), [(20_000, 4_096), (3, 16), (0, 4)])
def test_against_sorting(spark, monkeypatch, few, ranges):
    monkeypatch.setattr(selection, "FEW", few)
    monkeypatch.setattr(selection, "RANGES", ranges)
    own = groups(few)
    if few == 0:  # each round halves so little that a tail of exponents takes a round for each: leave it out
        own = {k: v for k, v in own.items() if k not in ("tail", "wide")}
    rows = [(k, v) for k, values in own.items() for v in values] + [("none", None), ("normal", None), ("normal", float("nan"))]
    random.Random(1).shuffle(rows)
    found = selection.percentiles(spark.createDataFrame(rows, "g string, x double").repartition(5), ("g",), "x", WANTED).collect()
    assert {r.g for r in found} == set(own)
    for r in found:
        for name, of in WANTED.items():
            assert r[name] == brute(own[r.g], *of), (r.g, name)


def test_no_groups_and_no_rows(spark):
    rows = spark.createDataFrame([(1, 2.0), (2, 4.0)], "id long, x double")
    assert selection.percentiles(rows, (), "x", {"m": ("linear", 0.5)}).collect() == [(3.0,)]
    assert selection.percentiles(rows.where("false"), (), "x", {"m": ("linear", 0.5)}).collect() == []
    none = selection.with_percentiles(rows.where("false").agg(F.count("x").alias("n")), rows.where("false"), (), "x", {"m": ("nearest", 0.5)})
    assert none.collect() == [(0, None)]


def test_refuses_other_shares(spark):
    with pytest.raises(TidemarkError):
        selection.percentiles(None, (), "x", {"m": ("linear", 1.5)})
    with pytest.raises(TidemarkError):
        selection.percentiles(None, (), "x", {"m": ("between", 0.5)})
