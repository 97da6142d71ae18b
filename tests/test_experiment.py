import hashlib
import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import bucket
from tidemark.model import Guardrail, TidemarkError
from tidemark.operators import experiment as e


def ids(spark, n=20_000):
    return spark.range(n).select(F.format_string("D-%05d", F.col("id")).alias("entity_id"))


def test_buckets_are_a_hash(spark):
    for row in ids(spark, 500).select("entity_id", bucket(F.col("entity_id"), "salt").alias("b")).collect():
        assert row.b == int.from_bytes(hashlib.sha256(f"salt:{row.entity_id}".encode()).digest()[:8], "big") / 2**64


@pytest.mark.parametrize("split", [0.1, 0.25, 0.5, 0.9])
def test_split_is_met(spark, split):
    assert abs(e.split_observed(ids(spark), split, "s").first()[0] - split) < 0.015


def test_salts_are_independent(spark):
    both = ids(spark).select(e.assign(F.col("entity_id"), 0.5, "a").alias("a"), e.assign(F.col("entity_id"), 0.5, "b").alias("b"))
    assert abs(both.where("a = b").count() / 20_000 - 0.5) < 0.02


def test_arms_at_the_ends(spark):
    assert e.split_observed(ids(spark, 100), 0.0, "s").first()[0] == 0 and e.split_observed(ids(spark, 100), 1.0, "s").first()[0] == 1
    for split in (-0.1, 1.1):
        with pytest.raises(TidemarkError):
            e.assign(F.lit("x"), split, "s")
    for split in (0.0, 1.0):
        with pytest.raises(TidemarkError):
            e.arms(ids(spark, 1), split, "s")


def test_detectable_effects():
    assert round(e.minimum_detectable_effect(6, 400, 400), 4) == 1.1886
    assert round(e.minimum_detectable_effect(6, 1600, 1600), 4) == 0.5943
    assert e.sample_size(1.0, 6) == 566 and e.sample_size(0.16, 6) == 22_075 and e.sample_size(1.0, 0) == 2
    for call in (lambda: e.minimum_detectable_effect(6, 1, 400), lambda: e.minimum_detectable_effect(-1, 4, 4), lambda: e.sample_size(0, 6), lambda: e.z_sum(1.0), lambda: e.z_sum(0.05, 0.0)):
        with pytest.raises(TidemarkError):
            call()


def outcomes(spark, control, treatment, fallback=0.0):
    """Outcomes by arm: each arm's entities get errors that alternate around the given mean."""
    arm = e.assign(F.col("entity_id"), 0.5, "s")
    i = F.row_number().over(Window.orderBy("entity_id"))
    mean = F.when(arm == "treatment", treatment).otherwise(control)
    return ids(spark, 800).select("entity_id", (mean + F.when(i % 2 == 0, 1.0).otherwise(-1.0)).alias("error"), ((arm == "treatment") & (i % 100 < 100 * fallback)).alias("fallback"))


def test_verdicts(spark):
    better = e.analyse(outcomes(spark, 10.0, 8.0), "s").first()
    assert better.conclusive and better.verdict.startswith("treatment wins by 1.9") and "detectable from" in better.verdict and not better.should_stop and better.effect > 1.5
    worse = e.analyse(outcomes(spark, 10.0, 10.5), "s").first()
    assert worse.verdict.startswith("control wins by 0.")
    level = e.analyse(outcomes(spark, 10.0, 10.001), "s").first()
    assert not level.conclusive and level.verdict.startswith("inconclusive: an effect of 0.") and level.mde > 0


def test_guardrails(spark):
    slow = e.analyse(outcomes(spark, 10.0, 12.0), "s").first()
    assert slow.should_stop and slow.verdict.startswith("stop: treatment's error is 1.2")
    falls = e.analyse(outcomes(spark, 10.0, 10.0, fallback=0.2), "s").first()
    assert falls.should_stop and "falls back" in falls.breaches[0]
    assert not e.analyse(outcomes(spark, 10.0, 12.0), "s", guardrail=Guardrail(max_error_ratio=2)).first().should_stop


def test_too_few_to_say(spark):
    got = e.analyse(outcomes(spark, 1.0, 1.0).limit(1), "s").first()
    assert math.isnan(got.effect) and got.mde == math.inf and not got.conclusive and got.pooled_std == 0


def test_no_variance_is_conclusive_at_nothing(spark):
    same = ids(spark, 50).select("entity_id", F.lit(3.0).alias("error"), F.lit(False).alias("fallback"))
    got = e.analyse(same, "s").first()
    assert (got.effect, got.mde, got.conclusive, got.verdict) == (0, 0, True, "control wins by 0.00 minutes, detectable from 0.00")
