"""Queries on group statistics and on arrays of values."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import stats
from tracewright.operators import groups
from tracewright.session import table


def lines(spark, folder):
    d = table(spark, folder, "lineitem")
    return d.select(F.col("l_orderkey").alias("uid"), F.col("l_linenumber").alias("resp"), "l_partkey", "l_suppkey", F.col("l_extendedprice").alias("score"), (F.col("l_returnflag") != "R").alias("on_policy"), (F.col("l_linestatus") == "F").cast("int").alias("mask"))


def group_outcome_advantage(spark, folder):
    d = groups.outcome_advantage(lines(spark, folder), "uid", "score", "on_policy")
    return d.select("uid", "resp", "l_partkey", "l_suppkey", F.round("advantage", 6).alias("advantage"))


def group_fallback_advantage(spark, folder):
    d = groups.fallback_advantage(lines(spark, folder), "uid", "score")
    return d.select("uid", "resp", "l_partkey", "l_suppkey", F.round("advantage", 6).alias("advantage"))


def score_by_source(spark, folder):
    r = table(spark, folder, "results").select(F.nullif(F.lower(F.trim("source")), F.lit("")).alias("source"), F.length("response").alias("n"))
    d = groups.score_by_source(r, "source", "n")
    return d.select("source", F.round("mean_score", 6).alias("mean_score"), "n")


def masked_stats(spark, folder):
    d = groups.masked_stats(lines(spark, folder), "score", "mask")
    return d.select(F.round("mean", 4).alias("mean"), F.round(F.col("variance") / 1e6, 4).alias("variance_m"), F.col("total").cast("bigint").alias("total"))


def masked_whiten(spark, folder):
    d = groups.masked_whiten(lines(spark, folder), "score", "mask")
    return d.select("uid", "resp", "l_partkey", "l_suppkey", F.round("whitened", 6).alias("whitened"))


def _entropies(spark, folder):
    d = table(spark, folder, "results").where("tokens is not null")
    ok = F.filter(F.col("tokens")["entropy"], lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x < float("inf")))
    return d.select("result_id", ok.alias("v"))


def top_r_mean(spark, folder):
    return _entropies(spark, folder).select("result_id", F.round(stats.top_r_mean(F.col("v")), 9).alias("top_r_mean"))


def median_mad(spark, folder):
    v = F.col("v")
    return _entropies(spark, folder).select("result_id", F.round(stats.median(v), 9).alias("median"), F.round(stats.mad(v), 9).alias("mad"), F.round(stats.std_pop(v), 9).alias("std"))


def robust_z_scores(spark, folder):
    d = _entropies(spark, folder).select("result_id", F.posexplode(stats.robust_z(F.col("v"))).alias("pos", "z"))
    return d.select("result_id", "pos", F.round("z", 6).alias("z"))


def logit_entropy(spark, folder):
    d = table(spark, folder, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    return d.select("vec_id", F.round(stats.entropy_of_logits(F.col("x")), 9).alias("entropy"))


def label_logprob(spark, folder):
    d = table(spark, folder, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    return d.select("vec_id", F.round(stats.label_log_prob(F.col("x"), F.col("label")), 9).alias("log_prob"))


QUERIES = {f.__name__: f for f in (group_outcome_advantage, group_fallback_advantage, score_by_source, masked_stats, masked_whiten, top_r_mean, median_mad, robust_z_scores, logit_entropy, label_logprob)}

LINES = "SELECT l_orderkey AS uid, l_linenumber AS resp, l_partkey, l_suppkey, l_extendedprice AS score, l_returnflag <> 'R' AS on_policy, CAST(l_linestatus = 'F' AS INTEGER) AS mask FROM lineitem"
_V = "SELECT result_id, list_filter(list_transform(tokens, lambda t: t.entropy), lambda x: x IS NOT NULL AND NOT isnan(x) AND x >= 0 AND NOT isinf(x)) AS v FROM results WHERE tokens IS NOT NULL"
_MM = f"""l AS ({LINES}), a AS (SELECT sum(score * mask) / (sum(mask) + 1e-8) AS mean, sum(mask) AS total FROM l),
b AS (SELECT sum((score - mean) * (score - mean) * mask) / (sum(mask) + 1e-8) * any_value(total) / (any_value(total) - 1) AS variance FROM l, a)"""
_Z = f"""
WITH v AS ({_V}), m AS (SELECT result_id, v, coalesce(list_aggregate(v, 'median'), 0) AS med FROM v),
d AS (SELECT *, coalesce(list_aggregate(list_transform(v, lambda x: abs(x - med)), 'median'), 0) AS mad, coalesce(list_aggregate(v, 'stddev_pop'), 0) AS std FROM m)"""
ORACLE = {
    "group_outcome_advantage": f"""
WITH l AS ({LINES}), g AS (SELECT uid, count(*) AS n, avg(score) AS m, stddev_samp(score) AS s FROM l WHERE on_policy GROUP BY uid)
SELECT l.uid, resp, l_partkey, l_suppkey, round(CASE WHEN NOT on_policy THEN 1.0 WHEN n <= 1 THEN score / (1 + 1e-6) ELSE (score - m) / (s + 1e-6) END, 6) AS advantage
FROM l LEFT JOIN g ON l.uid = g.uid""",
    "group_fallback_advantage": f"""
WITH l AS ({LINES}), g AS (SELECT uid, avg(score) AS m, coalesce(stddev_samp(score), 0) AS s FROM l GROUP BY uid)
SELECT l.uid, resp, l_partkey, l_suppkey, round(CASE WHEN s > 1e-6 THEN (score - m) / (s + 1e-6) ELSE 0.0 END, 6) AS advantage FROM l JOIN g ON l.uid = g.uid""",
    "score_by_source": """
WITH r AS (SELECT coalesce(nullif(lower(trim(source)), ''), 'unknown') AS source, length(response) AS n FROM results)
SELECT source, round(avg(n), 6) AS mean_score, count(n) AS n FROM r GROUP BY source UNION ALL SELECT 'all', round(avg(n), 6), count(n) FROM r""",
    "masked_stats": f"WITH {_MM} SELECT round(mean, 4) AS mean, round(variance / 1e6, 4) AS variance_m, CAST(total AS BIGINT) AS total FROM a, b",
    "masked_whiten": f"WITH {_MM} SELECT uid, resp, l_partkey, l_suppkey, round((score - mean) / sqrt(variance + 1e-8), 6) AS whitened FROM l, a, b",
    "top_r_mean": f"SELECT result_id, round(CASE WHEN len(v) = 0 THEN 0.0 ELSE list_avg(list_slice(list_reverse_sort(v), 1, CAST(ceil(sqrt(len(v))) AS BIGINT))) END, 9) AS top_r_mean FROM ({_V})",
    "median_mad": _Z + "SELECT result_id, round(med, 9) AS median, round(mad, 9) AS mad, round(std, 9) AS std FROM d",
    "robust_z_scores": _Z + """, s AS (SELECT result_id, v, med, greatest(mad, CASE WHEN mad < 0.05 THEN std ELSE 0 END, 0.05, 1e-6) AS s FROM d)
SELECT result_id, CAST(pos AS INTEGER) AS pos, round((x - med) / s, 6) AS z FROM (SELECT result_id, med, s, unnest(range(len(v))) AS pos, unnest(v) AS x FROM s)""",
    "logit_entropy": """
WITH e AS (SELECT vec_id, unnest(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS x FROM embeddings), z AS (SELECT vec_id, ln(sum(exp(x))) AS z FROM e GROUP BY vec_id)
SELECT e.vec_id, round(any_value(z) - sum(exp(x - z) * x), 9) AS entropy FROM e JOIN z ON e.vec_id = z.vec_id GROUP BY e.vec_id""",
    "label_logprob": "SELECT vec_id, round(CAST(embedding[label + 1] AS DOUBLE) - ln(list_sum(list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE))))), 9) AS log_prob FROM embeddings",
}
