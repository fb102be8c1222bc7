"""Losses and schedules as column expressions and aggregates over a long table of tokens. Values only: gradients
belong to a training runtime."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.stats import clip
from tracewright.operators.groups import masked_mean

KL = ("kl", "abs", "mse", "low_var_kl")


def kl(logp: Column, ref: Column, kind: str) -> Column:
    """Per-token divergence from a reference policy."""
    d = logp - ref
    if kind == "kl":
        return d
    if kind == "abs":
        return F.abs(d)
    if kind == "mse":
        return 0.5 * d * d
    if kind == "low_var_kl":
        return clip(F.exp(-d) + d - 1.0, -10.0, 10.0)
    raise ValueError(f"kind must be one of {', '.join(KL)}, not {kind}")


def kl_reward(score: Column, logp: Column, ref: Column, mask: Column, beta: float, kind: str = "kl") -> Column:
    """score - beta * kl * mask; the score alone for beta 0."""
    return score if beta == 0 else score - beta * kl(logp, ref, kind) * mask


def policy_loss(df: DataFrame, old: str, new: str, adv: str, mask: str, low: float = 0.2, high: float = 0.2) -> DataFrame:
    """One row (loss, clip_fraction, approx_kl): masked mean of max(-A r, -A clip(r, 1 - low, 1 + high)) with
    r = exp(new - old), share of tokens at which the clipped part is the larger, mean of old - new."""
    gap = clip(F.col(new) - F.col(old), -20.0, 20.0)
    ratio, a, m = F.exp(gap), F.col(adv), F.col(mask)
    plain, cut = -a * ratio, -a * clip(ratio, 1.0 - low, 1.0 + high)
    return df.agg(masked_mean(F.greatest(plain, cut), m).alias("loss"), masked_mean((cut > plain).cast("double"), m).alias("clip_fraction"), masked_mean(-gap, m).alias("approx_kl"))


def value_loss(df: DataFrame, pred: str, ret: str, old: str, mask: str, cliprange: float = 0.5) -> DataFrame:
    """One row (loss, clip_fraction): half the masked mean of the larger of the squared error and that of the
    prediction kept within `cliprange` of the old value."""
    v, r, o, m = (F.col(c) for c in (pred, ret, old, mask))
    kept = F.greatest(F.least(v, o + cliprange), o - cliprange)
    a, b = (v - r) * (v - r), (kept - r) * (kept - r)
    return df.agg((0.5 * masked_mean(F.greatest(a, b), m)).alias("loss"), masked_mean((b > a).cast("double"), m).alias("clip_fraction"))


def entropy_loss(df: DataFrame, entropy: str, mask: str) -> DataFrame:
    return df.agg(masked_mean(F.col(entropy), F.col(mask)).alias("loss"))


def mixed_loss(df: DataFrame, on_policy: str, rl_loss: str, nll: str, mask: str, coef: float) -> DataFrame:
    """One row (loss): (1 - coef) * masked mean of the RL loss over on-policy tokens + coef * that of the negative
    log-likelihood over the others; a side without rows is left out."""
    on, m = F.col(on_policy), F.col(mask)
    a = masked_mean(F.when(on, F.col(rl_loss)), F.when(on, m))
    b = masked_mean(F.when(~on, F.col(nll)), F.when(~on, m))
    return df.agg((F.coalesce((1 - coef) * a, F.lit(0.0)) + F.coalesce(coef * b, F.lit(0.0))).alias("loss"))


def cosine_coefficient(step: Column, total: int, floor: float) -> Column:
    """From 1 at step 0 along a half cosine to `floor` at `total` and beyond; 1 for total <= 0."""
    if total <= 0:
        return F.lit(1.0)
    p = F.least(step.cast("double") / total, F.lit(1.0))
    return floor + (1.0 - floor) * 0.5 * (1.0 + F.cos(math.pi * p))


def learning_rate(step: Column, warmup: int, total: int, least: float = 0.0, kind: str = "cosine") -> Column:
    """Factor of the base rate: linear over `warmup` steps, then constant or half a cosine down to `least`."""
    up = step.cast("double") / max(1, warmup)
    if kind == "constant":
        return F.when(step < warmup, up).otherwise(F.lit(1.0))
    p = (step.cast("double") - warmup) / max(1, total - warmup)
    down = F.greatest(F.lit(0.0), least + (1.0 - least) * 0.5 * (1.0 + F.cos(math.pi * F.least(p, F.lit(1.0)))))
    return F.when(step < warmup, up).otherwise(down)


def adaptive_coefficients(kls: Column, start: float, target: float, horizon: int, n: int) -> Column:
    """Coefficient after each step: times 1 + clip(kl / target - 1, -0.2, 0.2) * n / horizon. A fold over one row's array."""
    seed = F.struct(F.lit(start).alias("b"), F.expr("cast(array() as array<double>)").alias("out"))

    def step(s: Column, k: Column) -> Column:
        b = s["b"] * (1.0 + clip(k / target - 1.0, -0.2, 0.2) * (n / horizon))
        return F.struct(b.alias("b"), F.concat(s["out"], F.array(b)).alias("out"))

    return F.aggregate(kls, seed, step, lambda s: s["out"])
