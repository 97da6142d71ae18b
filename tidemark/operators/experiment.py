"""Hash-assigned A/B tests that report what they could have detected."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import bucket
from tidemark.model import POWER, SIGNIFICANCE, Guardrail, TidemarkError

CONTROL, TREATMENT = "control", "treatment"


def assign(entity: Column, split: float, salt: str) -> Column:
    if not 0.0 <= split <= 1.0:
        raise TidemarkError("a split is a share from 0 to 1")
    return F.when(bucket(entity, salt) < split, TREATMENT).otherwise(CONTROL)


def check_experiment(split: float) -> None:
    if not 0.0 < split < 1.0:
        raise TidemarkError("an experiment needs rows in both arms: the split lies between 0 and 1")


def z_sum(alpha: float = SIGNIFICANCE, power: float = POWER) -> float:
    if not 0.0 < alpha < 1.0 or not 0.0 < power < 1.0:
        raise TidemarkError("significance and power lie between 0 and 1")
    return NormalDist().inv_cdf(1 - alpha / 2) + NormalDist().inv_cdf(power)


def minimum_detectable_effect(sigma: float, n_control: int, n_treatment: int, alpha: float = SIGNIFICANCE, power: float = POWER) -> float:
    if min(n_control, n_treatment) < 2:
        raise TidemarkError("an arm needs two outcomes at least")
    if sigma < 0:
        raise TidemarkError("a deviation can't be negative")
    return z_sum(alpha, power) * sigma * math.sqrt(1 / n_control + 1 / n_treatment)


def sample_size(effect: float, sigma: float, alpha: float = SIGNIFICANCE, power: float = POWER) -> int:
    """Outcomes that each arm needs to detect the effect."""
    if effect <= 0:
        raise TidemarkError("an effect to detect is more than nothing")
    return 2 if sigma <= 0 else math.ceil(2 * z_sum(alpha, power) ** 2 * sigma**2 / effect**2)


def arms(outcomes: DataFrame, split: float, salt: str) -> DataFrame:
    """n, mean, sample deviation, variance and fallback rate of each arm; the arm is derived from the entity, never passed in."""
    check_experiment(split)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return (
        outcomes.withColumn("arm", assign(F.col("entity_id"), split, salt))
        .groupBy("arm")
        .agg(F.count("error").alias("n"), F.avg("error").alias("mean"), zero(F.stddev_samp("error")).alias("std"), zero(F.var_samp("error")).alias("variance"), zero(F.avg(F.col("fallback").cast("double"))).alias("fallback_rate"))
    )


def side_by_side(arm_rows: DataFrame) -> DataFrame:
    """One row with c_ and t_ columns; an arm without outcomes has n 0 and no mean."""
    of = lambda arm, c: F.max(F.when(F.col("arm") == arm, F.col(c)))
    columns = []
    for prefix, arm in (("c", CONTROL), ("t", TREATMENT)):
        columns += [F.coalesce(of(arm, "n"), F.lit(0)).alias(f"{prefix}_n"), of(arm, "mean").alias(f"{prefix}_mean"), of(arm, "variance").alias(f"{prefix}_var"), F.coalesce(of(arm, "fallback_rate"), F.lit(0.0)).alias(f"{prefix}_fallback")]
    return arm_rows.agg(*columns)


def pooled_std() -> Column:
    """Of the columns of side_by_side; null unless both arms have two outcomes."""
    weighted = (F.col("c_n") - 1) * F.col("c_var") + (F.col("t_n") - 1) * F.col("t_var")
    return F.when((F.col("c_n") >= 2) & (F.col("t_n") >= 2), F.sqrt(weighted / (F.col("c_n") + F.col("t_n") - 2)))


def detectable(alpha: float = SIGNIFICANCE, power: float = POWER) -> Column:
    n = lambda c: F.col(c).cast("double")
    return F.lit(z_sum(alpha, power)) * F.col("pooled_std") * F.sqrt(1 / n("c_n") + 1 / n("t_n"))


def needed(effect: float, alpha: float = SIGNIFICANCE, power: float = POWER) -> Column:
    if effect <= 0:
        raise TidemarkError("an effect to detect is more than nothing")
    size = F.ceil(2 * z_sum(alpha, power) ** 2 * F.col("pooled_std") * F.col("pooled_std") / effect**2)
    return F.when(F.col("pooled_std") <= 0, F.lit(2).cast("long")).otherwise(size)


def breaches(guardrail: Guardrail) -> Column:
    """Reasons to stop, as an array; none without treatment outcomes."""
    rate, most = F.col("t_fallback"), guardrail.max_fallback_rate
    ratio = F.when((F.col("c_n") > 0) & (F.col("c_mean") > 0), F.col("t_mean") / F.col("c_mean"))
    reasons = F.array_compact(
        F.array(
            F.when(rate > most, F.format_string(f"treatment falls back on %.1f%% of trips, more than {most * 100:.1f}%%", rate * 100)),
            F.when(ratio > guardrail.max_error_ratio, F.format_string(f"treatment's error is %.2f times control's, more than {guardrail.max_error_ratio:.2f}", ratio)),
        )
    )
    return F.when(F.col("t_n") > 0, reasons).otherwise(F.array().cast("array<string>"))


def analyse(outcomes: DataFrame, name: str, split: float = 0.5, salt: str | None = None, guardrail: Guardrail | None = None, alpha: float = SIGNIFICANCE, power: float = POWER) -> DataFrame:
    """One row: both arms, the effect (positive if treatment is better), what could be detected, and the verdict."""
    both = side_by_side(arms(outcomes, split, name if salt is None else salt))
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    enough = F.col("pooled_std").isNotNull()
    out = both.withColumn("pooled_std", pooled_std()).withColumns(
        {
            "effect": F.when(enough, F.col("c_mean") - F.col("t_mean")).otherwise(nan),
            "mde": F.when(enough, detectable(alpha, power)).otherwise(inf),
            "breaches": breaches(guardrail or Guardrail()),
        }
    )
    out = out.withColumns({"conclusive": enough & (F.abs("effect") >= F.col("mde")), "should_stop": F.size("breaches") > 0})
    figures = F.format_string("%.2f minutes, detectable from %.2f", F.abs("effect"), F.col("mde"))
    verdict = (
        F.when(F.col("should_stop"), F.concat(F.lit("stop: "), F.array_join("breaches", "; ")))
        .when(~F.col("conclusive"), F.when(enough, F.concat(F.lit("inconclusive: an effect of "), figures)).otherwise("inconclusive: too few outcomes"))
        .otherwise(F.concat(F.when(F.col("effect") > 0, TREATMENT).otherwise(CONTROL), F.lit(" wins by "), figures))
    )
    return out.select(
        F.lit(name).alias("name"),
        F.lit(split).alias("split"),
        F.col("c_n").alias("n_control"),
        F.col("t_n").alias("n_treatment"),
        F.coalesce("c_mean", nan).alias("mean_control"),
        F.coalesce("t_mean", nan).alias("mean_treatment"),
        "effect",
        "mde",
        F.coalesce("pooled_std", F.lit(0.0)).alias("pooled_std"),
        "conclusive",
        "should_stop",
        "breaches",
        verdict.alias("verdict"),
    )


def split_observed(entities: DataFrame, split: float, salt: str, entity: str = "entity_id") -> DataFrame:
    """The share of ids that land in treatment; null if there are none."""
    return entities.agg(F.avg((assign(F.col(entity), split, salt) == TREATMENT).cast("double")).alias("treatment_share"))
