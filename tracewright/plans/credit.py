"""Queries on interventions and token credit. Delivered blocks of results; judgements by rule: criterion c1 asks
that the text names a number above 99, c2 that it says "therefore", c3 that it has an answer line."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.operators import credit
from tracewright.session import settle, table

_RULES = {"c1": "(^|[^0-9])[1-9][0-9][0-9]", "c2": "(?i)therefore", "c3": "Answer:"}


def _r(spark, folder):
    return table(spark, folder, "results").where("response is not null and tokens is not null")


def _judge(d, text, keys):
    judged = F.array(*(F.struct(F.lit(k).alias("criterion_id"), F.col(text).rlike(p).alias("judged")) for k, p in _RULES.items()))
    return d.select(*keys, F.explode(judged).alias("j")).select(*keys, "j.criterion_id", "j.judged")


def _effects(spark, folder):
    r = _r(spark, folder)
    items = credit.intervention_items(r, ["result_id"], "response", "candidate_blocks", 6, "remove")
    return credit.criterion_effects(_judge(r, "response", ["result_id"]), _judge(items, "perturbed", ["result_id", "block_index"]), ["result_id"])


def intervention_effects(spark, folder):
    return _effects(spark, folder)


def _parts(spark, folder):
    combined = ((F.col("result_id") % 7) - 3).cast("double")
    r = _r(spark, folder)
    resp = r.select("result_id", F.size("tokens").alias("n_tokens"), combined.alias("combined"))
    b = r.select("result_id", combined.alias("combined"), F.explode("candidate_blocks").alias("b"))
    blocks = b.select("result_id", "combined", "b.block_index", F.col("b.block_max_robust_e").alias("max_z"), F.coalesce("b.token_start", F.lit(-1)).alias("token_start"), F.coalesce("b.token_end", F.lit(-1)).alias("token_end"))
    adv = r.select("result_id", F.explode(F.array(*(F.struct(F.lit(k).alias("criterion_id"), ((F.col("result_id") % (i + 3)) - 1).cast("double").alias("advantage"), F.lit(i + 1).alias("points")) for i, k in enumerate(_RULES)))).alias("a"))
    adv = adv.select("result_id", "a.criterion_id", "a.advantage", "a.points")
    effects = _effects(spark, folder)
    return resp, credit.block_credit(blocks, effects, adv, ["result_id"]), effects


def block_credit(spark, folder):
    _, b, _ = _parts(spark, folder)
    return b.select("result_id", "block_index", F.round("credit", 6).alias("credit"))


def token_credit(spark, folder):
    resp, b, _ = _parts(spark, folder)
    return credit.token_credit(b, resp, ["result_id"]).select("result_id", "token", F.round("credit", 6).alias("credit"))


def credit_metrics(spark, folder):
    resp, b, e = _parts(spark, folder)
    d = credit.credit_metrics(b, resp, e, ["result_id"])
    return d.select(*(F.round(F.col(c).cast("double"), 6).alias(c) for c in d.columns))


def credit_averages(spark, folder):
    """Means over the responses of each one's figures."""
    resp, b, e = _parts(spark, folder)
    d = credit.averaged_metrics(credit.response_metrics(settle(b), resp, settle(e), ["result_id"]))
    return d.select(*(F.round(c, 6).alias(c) for c in d.columns))


QUERIES = {f.__name__: f for f in (intervention_effects, block_credit, token_credit, credit_metrics, credit_averages)}

_E = """
r AS (SELECT * FROM results WHERE response IS NOT NULL AND tokens IS NOT NULL),
b AS (SELECT result_id, response, b, o FROM (SELECT result_id, response, unnest(candidate_blocks) AS b, unnest(range(len(candidate_blocks))) AS o FROM r)),
p AS (SELECT result_id, b.block_index AS block_index, response, CASE WHEN coalesce(b.char_start >= 0 AND b.char_end > b.char_start AND b.char_end <= length(response), false) THEN left(response, b.char_start) || substr(response, b.char_end + 1) ELSE response END AS cut FROM b WHERE o < 6),
j(criterion_id, pat, k) AS (VALUES ('c1', '(^|[^0-9])[1-9][0-9][0-9]', 0), ('c2', '(?i)therefore', 1), ('c3', 'Answer:', 2)),
e AS (SELECT result_id, block_index, criterion_id, k, CAST(CAST(regexp_matches(response, pat) AS INTEGER) - CAST(regexp_matches(cut, pat) AS INTEGER) AS DOUBLE) AS effect FROM p, j),
g AS (SELECT result_id, block_index, sum((result_id % (k + 3) - 1) * abs(effect) * (k + 1)) AS c FROM e WHERE effect <> 0 GROUP BY 1, 2),
c AS (SELECT b.result_id, b.b.block_index AS block_index, coalesce(b.b.token_start, -1) AS ts, coalesce(b.b.token_end, -1) AS te,
 CAST(CASE WHEN coalesce(c, 0) <> 0 THEN c ELSE (b.result_id % 7 - 3) * (1 + greatest(coalesce(b.b.block_max_robust_e, 0), 0)) END AS DOUBLE) AS credit FROM b LEFT JOIN g ON b.result_id = g.result_id AND b.b.block_index = g.block_index),
n AS (SELECT result_id, CAST(len(tokens) AS INTEGER) AS n, CAST(result_id % 7 - 3 AS DOUBLE) AS combined FROM r),
k AS (SELECT c.result_id, ts, least(te, n - 1) AS te, credit, n FROM c JOIN n ON c.result_id = n.result_id WHERE ts >= 0 AND te >= ts AND ts < n AND credit <> 0),
t AS (SELECT result_id, unnest(range(ts, te + 1)) AS token, credit / sqrt(te - ts + 1) AS c FROM k),
u AS (SELECT result_id, token, sum(c) AS c FROM t GROUP BY 1, 2)"""
ORACLE = {
    "intervention_effects": f"WITH {_E} SELECT result_id, block_index, criterion_id, effect FROM e",
    "block_credit": f"WITH {_E} SELECT result_id, block_index, round(credit, 6) AS credit FROM c",
    "token_credit": f"""WITH {_E}, d AS (SELECT result_id, combined, unnest(range(n)) AS token FROM n)
SELECT d.result_id, CAST(d.token AS INTEGER) AS token, round(coalesce(u.c, CASE WHEN d.result_id IN (SELECT result_id FROM k) THEN 0 ELSE combined END), 6) AS credit FROM d LEFT JOIN u ON d.result_id = u.result_id AND d.token = u.token""",
    "credit_metrics": f"WITH {_E} SELECT CAST((SELECT count(*) FROM k) AS DOUBLE) AS nonzero_blocks, round((SELECT count(*) FROM u) / (SELECT sum(n) FROM n)::DOUBLE, 6) AS token_coverage, round((SELECT avg(abs(effect)) FROM e WHERE effect <> 0), 6) AS abs_effect_mean",
    "credit_averages": f"""WITH {_E}, kb AS (SELECT result_id, count(*) AS b FROM k GROUP BY 1), kt AS (SELECT result_id, count(*) AS t FROM u GROUP BY 1), ke AS (SELECT result_id, avg(abs(effect)) AS a FROM e WHERE effect <> 0 GROUP BY 1)
SELECT round(avg(coalesce(b, 0)), 6) AS nonzero_blocks, round(avg(CASE WHEN n > 0 THEN coalesce(t, 0) / n::DOUBLE ELSE 0 END), 6) AS token_coverage, round(avg(coalesce(a, 0)), 6) AS abs_effect_mean,
 round(avg(CAST(a IS NOT NULL AS DOUBLE)), 6) AS used_effects, round(avg(CAST(coalesce(b, 0) = 0 AS DOUBLE)), 6) AS used_fallback
FROM n LEFT JOIN kb ON n.result_id = kb.result_id LEFT JOIN kt ON n.result_id = kt.result_id LEFT JOIN ke ON n.result_id = ke.result_id""",
}
