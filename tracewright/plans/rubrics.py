"""Queries on rubrics, verdicts and criterion advantages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import text as tx
from tracewright.operators import groups, rubrics
from tracewright.plans import texts as text_plans
from tracewright.session import settle, table


def _rubrics(spark, folder):
    return rubrics.check_rubric(table(spark, folder, "rubrics"))


def rubric_validate(spark, folder):
    return _rubrics(spark, folder).select("sample_id", "error", "total", F.coalesce(F.col("total") == F.col("maximum_score"), F.lit(False)).alias("maximum_ok"))


def rubric_criteria(spark, folder):
    d = _rubrics(spark, folder).where("error is null").select("sample_id", F.explode("criteria").alias("c"))
    return d.select("sample_id", "c.criterion_id", "c.category", "c.points")


def json_extract(spark, folder):
    j = rubrics.json_object(F.col("payload"))
    d = table(spark, folder, "verdicts").select("verdict_id", j.alias("j"))
    return d.select("verdict_id", F.get_json_object("j", "$.schema_version").alias("version"), F.col("j").isNotNull().alias("is_object"))


def _verdicts(spark, folder):
    r = _rubrics(spark, folder).where("error is null").select("sample_id", "criteria", "total")
    return rubrics.check_verdict(table(spark, folder, "verdicts").join(r, "sample_id", "left"), "payload", "criteria")


def verifier_validate(spark, folder):
    d = _verdicts(spark, folder).select("verdict_id", "error", "answers")
    return d.select("verdict_id", "error", F.size("answers").alias("n_answers"), F.aggregate("answers", F.lit(0.0), lambda s, x: s + x["final_score"]).alias("points"))


def normalized_scores(spark, folder):
    d = _verdicts(spark, folder).where("error is null").select("verdict_id", "total", F.explode("answers").alias("a"))
    return d.select("verdict_id", "a.answer_index", F.round(rubrics.normalized_score(F.col("a.final_score"), F.col("total")), 6).alias("score"))


def _judged(spark, folder):
    return rubrics.judgement_rows(_verdicts(spark, folder), ["verdict_id"])


def judgement_rows(spark, folder):
    return _judged(spark, folder)


def criterion_advantages(spark, folder):
    # Written once: the figures of groups read it several times, and parsing the payloads is the costly part.
    d = groups.criterion_advantages(settle(_judged(spark, folder)), "verdict_id", "answer_index", "criterion_id", "judged", "points")
    return d.select("verdict_id", "answer_index", F.round("combined", 6).alias("advantage"))


def criterion_metrics(spark, folder):
    z = groups.criterion_z(settle(_judged(spark, folder)), "verdict_id", "criterion_id", "judged")
    d = groups.criterion_metrics(z, "criterion_id", "judged", "advantage")
    return d.select("criterion_id", "n", *(F.round(c, 6).alias(c) for c in ("pass_ratio", "pass_std", "adv_std")))


def attribution_validate(spark, folder):
    """Attributions made from the verdicts (a true judgement: supporting, a false one: missing), checked again."""
    d = _verdicts(spark, folder).where("error is null")
    kind = lambda j: F.when(j, F.lit("supporting_span")).otherwise(F.lit("missing"))
    ids = F.transform("criteria", lambda c: c["criterion_id"])
    make = lambda a: F.zip_with(ids, a["judgement"], lambda c, j: F.struct(c.alias("criterion_id"), kind(j).alias("attribution_type"), F.lit("").alias("quote")))
    answers = F.transform("answers", lambda a: F.struct(a["answer_index"].alias("answer_index"), F.reverse(make(a)).alias("attributions")))
    version = F.when(F.col("verdict_id") % 5 == 0, F.lit("x.shadow_attribution.v0")).otherwise(F.lit("x.shadow_attribution.v1"))
    d = d.select("verdict_id", ids.alias("ids"), F.size("answers").alias("n"), F.concat(F.lit("```json\n"), F.to_json(F.struct(version.alias("schema_version"), answers.alias("answers"))), F.lit("\n```")).alias("payload"))
    d = rubrics.check_attribution(d, "payload", "ids", F.col("n"))
    first = F.array_join(F.transform(F.get("answers", F.lit(0))["attributions"], lambda t: t["criterion_id"]), ",")
    return d.select("verdict_id", "error", first.alias("first_order"))


def rule_scores(spark, folder):
    """Named scorers side by side, as a registry gives them."""
    from tracewright.registry import SCORERS

    d = table(spark, folder, "results").where("response is not null")
    return d.select("result_id", *(F.round(F.coalesce(f(F.col("response"), F.col("gold_answer")), F.lit(0.0)), 6).alias(n) for n, f in SCORERS.items()))


QUERIES = {f.__name__: f for f in (rubric_validate, rubric_criteria, json_extract, verifier_validate, normalized_scores, judgement_rows, criterion_advantages, criterion_metrics, attribution_validate, rule_scores)}

_FINAL, _FORMAT = "|".join(tx.FINAL_ANSWER).replace("'", "''"), "|".join(tx.FORMAT).replace("'", "''")
_C = f"""
u AS (SELECT sample_id, schema_version, maximum_score, rubrics, row_number() OVER () AS rid FROM rubrics),
x AS (SELECT rid, sample_id, unnest(range(len(rubrics))) AS pos, unnest(rubrics) AS r FROM u),
p AS (SELECT rid, sample_id, pos, coalesce(nullif(r.category, ''), 'Task') AS category, coalesce(trim(r.criterion), '') AS criterion, r.points AS raw FROM x),
c AS (SELECT *, lower(concat_ws(' ', category, criterion)) AS t FROM p),
k AS (SELECT rid, sample_id, pos, 'c' || (pos + 1) AS criterion_id, category, criterion, raw, CASE WHEN regexp_matches(t, '{_FINAL}') THEN least(raw, 2) WHEN regexp_matches(t, '{_FORMAT}') THEN least(raw, 1) ELSE raw END AS points FROM c),
e AS (SELECT u.rid, u.sample_id, maximum_score, CASE WHEN NOT coalesce(suffix(schema_version, '.rubric.v1'), false) THEN 'version' WHEN coalesce(len(rubrics), 0) = 0 THEN 'no criterion'
 WHEN (SELECT count(*) FROM k WHERE k.rid = u.rid AND criterion = '') > 0 THEN 'empty criterion' WHEN (SELECT count(*) FROM k WHERE k.rid = u.rid AND NOT coalesce(raw BETWEEN 1 AND 5, false)) > 0 THEN 'points' END AS error FROM u),
g AS (SELECT e.rid, any_value(e.sample_id) AS sample_id, list(k.points ORDER BY pos) AS pts, CAST(sum(k.points) AS INTEGER) AS total FROM e JOIN k ON k.rid = e.rid WHERE error IS NULL GROUP BY e.rid)"""
_J = r"""
f AS (SELECT verdict_id, sample_id, CASE WHEN starts_with(trim(payload, ' ' || chr(10)), '```') THEN regexp_replace(regexp_replace(trim(payload, ' ' || chr(10)), '^```(?:json)?\s*', '', 'i'), '\s*```$', '') ELSE trim(payload, ' ' || chr(10)) END AS t FROM verdicts),
b AS (SELECT *, regexp_extract(t, '(?s)\{.*\}') AS s FROM f),
j AS (SELECT verdict_id, sample_id, CASE WHEN json_valid(t) THEN CASE WHEN json_type(t) = 'OBJECT' THEN t END WHEN json_valid(s) AND s <> '' THEN s END AS j FROM b)"""
_V = f"""{_C}, {_J},
a AS (SELECT verdict_id, sample_id, j, coalesce(suffix(json_extract_string(j, '$.schema_version'), '.batch_verifier.v2'), false) AS ok_v, CAST(json_extract(j, '$.answers') AS JSON[]) AS ans FROM j),
q AS (SELECT verdict_id, pos, json_extract_string(x, '$.answer_index') AS ai, [lower(trim(y)) FOR y IN json_extract_string(x, '$.judgement[*]')] AS jd
 FROM (SELECT verdict_id, unnest(range(len(ans))) AS pos, unnest(ans) AS x FROM a)),
v AS (SELECT a.verdict_id, g.pts, g.total, CASE WHEN j IS NULL THEN 'json' WHEN NOT ok_v THEN 'version' WHEN g.pts IS NULL THEN 'no rubric' WHEN coalesce(len(ans), 0) = 0 THEN 'count'
 WHEN (SELECT count(*) FROM q WHERE q.verdict_id = a.verdict_id AND coalesce(ai, CAST(pos + 1 AS VARCHAR)) <> CAST(pos + 1 AS VARCHAR)) > 0 THEN 'order'
 WHEN (SELECT count(*) FROM q WHERE q.verdict_id = a.verdict_id AND len(jd) <> len(g.pts)) > 0 THEN 'length'
 WHEN (SELECT count(*) FROM q WHERE q.verdict_id = a.verdict_id AND len(list_filter(jd, lambda y: y NOT IN ('true', 'false'))) > 0) > 0 THEN 'judgement' END AS error
 FROM a LEFT JOIN g ON a.sample_id = g.sample_id),
s AS (SELECT v.verdict_id, CAST(q.pos + 1 AS INTEGER) AS answer_index, v.total, jd, pts, CAST(list_sum(list_transform(pts, lambda p, i: CASE WHEN jd[i] = 'true' THEN p ELSE 0 END)) AS DOUBLE) AS score FROM v JOIN q ON v.verdict_id = q.verdict_id WHERE v.error IS NULL),
r AS (SELECT verdict_id, answer_index, unnest(range(1, len(pts) + 1)) AS c, unnest(pts) AS points, unnest(jd) = 'true' AS judged FROM s)"""
ORACLE = {
    "rubric_validate": f"WITH {_C} SELECT e.sample_id, e.error, g.total, coalesce(g.total = e.maximum_score, false) AS maximum_ok FROM e LEFT JOIN g ON e.rid = g.rid",
    "rubric_criteria": f"WITH {_C} SELECT k.sample_id, criterion_id, category, points FROM k JOIN e ON e.rid = k.rid WHERE e.error IS NULL",
    "json_extract": f"WITH {_J} SELECT verdict_id, json_extract_string(j, '$.schema_version') AS version, j IS NOT NULL AS is_object FROM j",
    "verifier_validate": f"WITH {_V} SELECT v.verdict_id, any_value(v.error) AS error, CAST(nullif(count(s.score), 0) AS INTEGER) AS n_answers, sum(s.score) AS points FROM v LEFT JOIN s ON v.verdict_id = s.verdict_id GROUP BY v.verdict_id, v.total, v.pts",
    "normalized_scores": f"WITH {_V} SELECT verdict_id, answer_index, round(CASE WHEN total > 0 THEN greatest(least(score / total, 1), 0) ELSE 0 END, 6) AS score FROM s",
    "judgement_rows": f"WITH {_V} SELECT verdict_id, answer_index, 'c' || c AS criterion_id, points, judged FROM r",
    "criterion_advantages": f"""WITH {_V}, m AS (SELECT verdict_id, c, avg(CAST(judged AS DOUBLE)) AS m, coalesce(stddev_samp(CAST(judged AS DOUBLE)), 0) AS d FROM r GROUP BY 1, 2),
w AS (SELECT r.verdict_id, answer_index, sum(CASE WHEN d > 1e-6 THEN points * (CAST(judged AS DOUBLE) - m) / (d + 1e-6) ELSE 0 END) AS wz, sum(CASE WHEN d > 1e-6 THEN points ELSE 0 END) AS w FROM r JOIN m ON r.verdict_id = m.verdict_id AND r.c = m.c GROUP BY 1, 2),
z AS (SELECT verdict_id, answer_index, CASE WHEN w > 0 THEN wz / w ELSE 0 END AS z FROM w), n AS (SELECT verdict_id, coalesce(stddev_samp(z), 0) AS d FROM z GROUP BY 1)
SELECT z.verdict_id, answer_index, round(CASE WHEN d > 1e-6 THEN z / (d + 1e-6) ELSE z END, 6) AS advantage FROM z JOIN n ON z.verdict_id = n.verdict_id""",
    "criterion_metrics": f"""WITH {_V}, m AS (SELECT verdict_id, c, avg(CAST(judged AS DOUBLE)) AS m, coalesce(stddev_samp(CAST(judged AS DOUBLE)), 0) AS d FROM r GROUP BY 1, 2),
z AS (SELECT r.c, CAST(judged AS DOUBLE) AS j, CASE WHEN d > 1e-6 THEN (CAST(judged AS DOUBLE) - m) / (d + 1e-6) ELSE 0 END AS z FROM r JOIN m ON r.verdict_id = m.verdict_id AND r.c = m.c)
SELECT 'c' || c AS criterion_id, count(*) AS n, round(avg(j), 6) AS pass_ratio, round(stddev_pop(j), 6) AS pass_std, round(stddev_pop(z), 6) AS adv_std FROM z GROUP BY 1""",
    "attribution_validate": f"WITH {_V} SELECT verdict_id, CASE WHEN verdict_id % 5 = 0 THEN 'version' END AS error, CASE WHEN verdict_id % 5 <> 0 THEN array_to_string(list_transform(pts, lambda p, i: 'c' || i), ',') END AS first_order FROM v WHERE error IS NULL",
    "rule_scores": f"""SELECT b.result_id, b.score AS boxed, m.score AS boxed_math, x.overall AS math, t.overall AS think_answer, y.score AS yes_no, c.accuracy AS last_answer FROM ({text_plans.ORACLE["boxed_score"]}) b
JOIN (SELECT result_id, CAST(CASE WHEN b IS NULL THEN 0.0 WHEN {text_plans._same(text_plans._norm("b"), text_plans._norm("gold_answer"))} THEN 1.0 ELSE 0.1 END AS DOUBLE) AS score FROM (SELECT result_id, gold_answer, {text_plans._BOX} AS b FROM {text_plans._R})) m ON m.result_id = b.result_id
JOIN ({text_plans.ORACLE["math_score"]}) x ON x.result_id = b.result_id JOIN ({text_plans.ORACLE["think_answer_score"]}) t ON t.result_id = b.result_id JOIN ({text_plans.ORACLE["yes_no_score"]}) y ON y.result_id = b.result_id JOIN ({text_plans.ORACLE["combined_score"]}) c ON c.result_id = b.result_id""",
}
