"""Advantages of whole responses' tokens by the name of the estimator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions import arrays
from tracewright.operators import groups
from tracewright.session import settle

CRITERION = "criterion_advantages"
#: Columns read: uid, score, is_onpolicy (grpo); rewards, values, mask, baseline as arrays or numbers by name.
Estimator = Callable[[DataFrame], DataFrame]


def _gae(df: DataFrame) -> DataFrame:
    """Returns are made before the advantages are whitened."""
    d = df.withColumn("advantages", arrays.gae(F.col("rewards"), F.col("values"), 1.0, 0.95))
    d = settle(d.withColumn("returns", F.zip_with("advantages", "values", lambda a, v: a + v)))  # read three times
    return groups.whiten_arrays(d, "advantages", "mask")


def _grpo(df: DataFrame) -> DataFrame:
    if CRITERION in df.columns:
        return criterion_override(df)
    d = groups.outcome_advantage(df, "uid", "score", "is_onpolicy", "__a")
    return d.withColumn("advantages", spread(F.col("__a"), F.col("mask"))).drop("__a")


def criterion_override(df: DataFrame, given: str = CRITERION) -> DataFrame:
    """Advantages that criteria gave replace the group's outcome: an array for each response, as it is within the mask. A
    length that differs from the mask's ends the query."""
    same = F.size(given) == F.size("mask")
    bad = F.raise_error(F.concat(F.lit("criterion advantages of length "), F.size(given).cast("string"), F.lit(" for "), F.size("mask").cast("string"), F.lit(" tokens"))).cast("array<double>")
    return df.withColumn("advantages", F.when(F.coalesce(same, F.lit(False)), F.zip_with(given, "mask", lambda a, m: a * m)).otherwise(bad))


def _discounted(df: DataFrame) -> DataFrame:
    d = settle(df.withColumn("returns", arrays.discounted_returns(F.col("rewards"), F.col("mask"), 1.0)))
    return groups.whiten_arrays(d, "returns", "mask", "advantages")


def _baseline(df: DataFrame) -> DataFrame:
    """Sum of what follows minus the baseline, within the mask."""
    r = F.zip_with("rewards", "mask", lambda a, m: a * m)
    tail = arrays.discounted_returns(r, F.transform("mask", lambda m: F.lit(1)), 1.0)
    return df.withColumn("advantages", F.zip_with(tail, "mask", lambda t, m: t - F.col("baseline") * m))


def spread(value: Column, mask: Column) -> Column:
    return F.transform(mask, lambda m: value * m)


ESTIMATORS: dict[str, Estimator] = {"gae": _gae, "grpo": _grpo, "reinforce_plus_plus": _discounted, "remax": _baseline}


def advantages(df: DataFrame, kind: str) -> DataFrame:
    """df with array column `advantages` (gae and reinforce_plus_plus: whitened over all tokens, with `returns`). grpo
    takes the column criterion_advantages instead of the group's outcome where df has it."""
    if kind not in ESTIMATORS:
        raise ValueError(f"unknown estimator {kind}; known are {', '.join(ESTIMATORS)}")
    return ESTIMATORS[kind](df)
