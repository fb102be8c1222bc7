"""Queries on losses and schedules. lineitem's lines stand in for tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.operators import losses
from tracewright.session import table


def _t(spark, folder):
    d = table(spark, folder, "lineitem")
    return d.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (-F.col("l_discount") * 10).alias("old"), (-F.col("l_tax") * 10).alias("new"), ((F.col("l_quantity") - 25) / 10).alias("adv"),
        (F.col("l_linestatus") == "F").cast("int").alias("mask"), (F.col("l_returnflag") != "R").alias("on"),
    )


_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def kl_variants(spark, folder):
    cols = [F.round(losses.kl(F.col("old"), F.col("new"), k), 6).alias(k if k != "abs" else "abs_kl") for k in losses.KL]
    return _t(spark, folder).select(*_KEYS, *cols)


def kl_shaped_reward(spark, folder):
    return _t(spark, folder).select(*_KEYS, F.round(losses.kl_reward(F.col("adv"), F.col("old"), F.col("new"), F.col("mask"), 0.1, "low_var_kl"), 6).alias("reward"))


def _rounded(d):
    return d.select(*(F.round(c, 6).alias(c) for c in d.columns))


def policy_clip_loss(spark, folder):
    return _rounded(losses.policy_loss(_t(spark, folder), "old", "new", "adv", "mask", 0.2, 0.3))


def value_clip_loss(spark, folder):
    return _rounded(losses.value_loss(_t(spark, folder), "adv", "new", "old", "mask"))


def entropy_loss(spark, folder):
    d = table(spark, folder, "results").select(F.explode("tokens").alias("t")).select(F.col("t.entropy").alias("e"))
    ok = ~F.isnan("e") & (F.col("e") >= 0) & (F.col("e") < float("inf"))
    d = d.select(F.when(ok, F.col("e")).otherwise(F.lit(0.0)).alias("e"), F.coalesce(ok, F.lit(False)).cast("int").alias("mask"))
    return _rounded(losses.entropy_loss(d, "e", "mask"))


def mixed_loss(spark, folder):
    d = _t(spark, folder).withColumn("nll", -F.col("new"))
    return _rounded(losses.mixed_loss(d, "on", "adv", "nll", "mask", 0.3))


def coef_schedules(spark, folder):
    s = F.col("o_orderkey")
    d = table(spark, folder, "orders")
    return d.select("o_orderkey", F.round(losses.cosine_coefficient(s, 10_000, 0.1), 9).alias("coef"), F.round(losses.learning_rate(s, 500, 12_000, 0.05), 9).alias("rate"), F.round(losses.learning_rate(s, 500, 12_000, kind="constant"), 9).alias("constant_rate"))


def adaptive_coef(spark, folder):
    k = F.transform(F.filter("tokens", lambda t: (t["entropy"] >= 0) & (t["entropy"] < float("inf"))), lambda t: t["entropy"])
    d = table(spark, folder, "results").where("tokens is not null").select("result_id", losses.adaptive_coefficients(k, 0.2, 0.3, 1000, 32).alias("c"))
    return d.select("result_id", F.round(F.try_element_at("c", F.lit(-1)), 9).alias("coef"), F.size("c").alias("n_steps"))


QUERIES = {f.__name__: f for f in (kl_variants, kl_shaped_reward, policy_clip_loss, value_clip_loss, entropy_loss, mixed_loss, coef_schedules, adaptive_coef)}

_T = "t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, -l_discount * 10 AS old, -l_tax * 10 AS new, (l_quantity - 25) / 10 AS adv, CAST(l_linestatus = 'F' AS INTEGER) AS mask, l_returnflag <> 'R' AS on_p FROM lineitem)"
_K = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
_MM = "sum({v} * mask) / (sum(mask) + 1e-8)"
ORACLE = {
    "kl_variants": f"WITH {_T} SELECT {_K}, round(old - new, 6) AS kl, round(abs(old - new), 6) AS abs_kl, round(0.5::DOUBLE * (old - new) ** 2, 6) AS mse, round(least(greatest(exp(new - old) - (new - old) - 1, -10), 10), 6) AS low_var_kl FROM t",
    "kl_shaped_reward": f"WITH {_T} SELECT {_K}, round(adv - 0.1::DOUBLE * least(greatest(exp(new - old) - (new - old) - 1, -10), 10) * mask, 6) AS reward FROM t",
    "policy_clip_loss": f"""WITH {_T}, r AS (SELECT mask, adv, exp(least(greatest(new - old, -20), 20)) AS r, old - new AS k FROM t), c AS (SELECT mask, -adv * r AS a, -adv * least(greatest(r, 0.8::DOUBLE), 1.3::DOUBLE) AS b, k FROM r)
SELECT round({_MM.format(v="greatest(a, b)")}, 6) AS loss, round({_MM.format(v="CAST(b > a AS DOUBLE)")}, 6) AS clip_fraction, round({_MM.format(v="k")}, 6) AS approx_kl FROM c""",
    "value_clip_loss": f"""WITH {_T}, c AS (SELECT mask, (adv - new) ** 2 AS a, (greatest(least(adv, old + 0.5::DOUBLE), old - 0.5::DOUBLE) - new) ** 2 AS b FROM t)
SELECT round(0.5 * {_MM.format(v="greatest(a, b)")}, 6) AS loss, round({_MM.format(v="CAST(b > a AS DOUBLE)")}, 6) AS clip_fraction FROM c""",
    "entropy_loss": """WITH e AS (SELECT t.entropy AS e FROM (SELECT unnest(tokens) AS t FROM results)), m AS (SELECT CASE WHEN ok THEN e ELSE 0 END AS e, CASE WHEN ok THEN 1 ELSE 0 END AS mask FROM (SELECT e, e IS NOT NULL AND NOT isnan(e) AND e >= 0 AND NOT isinf(e) AS ok FROM e))
SELECT round(sum(e * mask) / (sum(mask) + 1e-8), 6) AS loss FROM m""",
    "mixed_loss": f"""WITH {_T} SELECT round(0.7::DOUBLE * (SELECT {_MM.format(v="adv")} FROM t WHERE on_p) + 0.3::DOUBLE * (SELECT {_MM.format(v="-new")} FROM t WHERE NOT on_p), 6) AS loss""",
    "coef_schedules": """SELECT o_orderkey, round(0.1::DOUBLE + 0.9::DOUBLE * 0.5 * (1 + cos(pi() * least(o_orderkey / 10000.0::DOUBLE, 1))), 9) AS coef,
 round(CASE WHEN o_orderkey < 500 THEN o_orderkey / 500.0::DOUBLE ELSE greatest(0, 0.05::DOUBLE + 0.95::DOUBLE * 0.5 * (1 + cos(pi() * least((o_orderkey - 500) / 11500.0::DOUBLE, 1)))) END, 9) AS rate,
 round(CASE WHEN o_orderkey < 500 THEN o_orderkey / 500.0::DOUBLE ELSE 1.0::DOUBLE END, 9) AS constant_rate FROM orders""",
    "adaptive_coef": """WITH k AS (SELECT result_id, list_filter(list_transform(tokens, lambda t: t.entropy), lambda x: x >= 0 AND NOT isinf(x) AND NOT isnan(x)) AS k FROM results WHERE tokens IS NOT NULL)
SELECT result_id, CASE WHEN len(k) > 0 THEN round(0.2::DOUBLE * coalesce(list_product(list_transform(k, lambda x: 1 + least(greatest(x / 0.3::DOUBLE - 1, -0.2::DOUBLE), 0.2::DOUBLE) * 0.032::DOUBLE)), 1), 9) END AS coef, CAST(len(k) AS INTEGER) AS n_steps FROM k""",
}
