"""Queries on prepared records, groups of answers and further batch shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import stats
from tracewright.functions import text as tx
from tracewright.operators import advantages, batches, groups, rubrics
from tracewright.plans import rubrics as rubric_plans
from tracewright.plans import texts as text_plans
from tracewright.session import settle, table


def teacher_filter(spark, folder):
    """Per sample, how many responses stay."""
    d = table(spark, folder, "results").where("response is not null")
    kept = batches.teacher_rows(d, tx.final_label(F.col("response")), F.col("gold_answer"))
    return kept.groupBy("sample_id").agg(F.count(F.lit(1)).alias("kept"))


def onpolicy_groups(spark, folder):
    """Groups of on-policy lines in the order of their first line."""
    d = table(spark, folder, "lineitem").where("l_returnflag <> 'R'").groupBy("l_orderkey").agg(F.min("l_partkey").alias("first"), F.count(F.lit(1)).alias("n"))
    o = batches.with_ordinal(d, [F.col("first"), F.col("l_orderkey")], "place")
    return o.select("l_orderkey", "n", F.col("place").cast("bigint").alias("place"))


def left_pad_collate(spark, folder):
    """Whole id lists in batches of 256 rows, padded to the greatest length of their batch."""
    d = table(spark, folder, "results").where("generated_token_ids is not null").select("result_id", F.col("generated_token_ids").alias("ids"))
    d = batches.splits(batches.with_ordinal(d, [F.col("result_id")]), "ordinal", 256, "batch")
    d = batches.collate_left(d, "ids", 0, "batch")
    return d.select("result_id", *(F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("input_ids", "mask", "position_ids")))


def row_slice(spark, folder):
    d = batches.with_ordinal(table(spark, folder, "customer").select("c_custkey"), [F.col("c_custkey")])
    return batches.rows(d, "ordinal", 100, 150).select("c_custkey")


def reorder_rows(spark, folder):
    d = batches.with_ordinal(table(spark, folder, "customer").select("c_custkey"), [F.col("c_custkey")])
    n = table(spark, folder, "customer").count()
    index = d.select(F.col("ordinal").alias("new_ordinal"), ((F.col("ordinal") * 7 + 3) % n).alias("ordinal"))
    return batches.reorder(d, "ordinal", index).select(F.col("ordinal").cast("bigint").alias("ordinal"), "c_custkey")


def minibatch_epochs(spark, folder):
    """All rows, padded to whole batches of 50."""
    n = table(spark, folder, "customer").count()
    d = batches.with_ordinal(table(spark, folder, "customer").select("c_custkey"), [F.col("c_custkey")])
    d = batches.minibatches(batches.pad_to_divisor(d, "ordinal", n, 50), "ordinal", n + -n % 50, 50, 2)
    return d.groupBy("epoch", "batch").agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("keys"))


def length_info(spark, folder):
    r = table(spark, folder, "results")
    return r.select("result_id", F.coalesce(F.length("prompt"), F.lit(0)).alias("prompt_length"), F.coalesce(F.aggregate("tokens", F.lit(0), lambda s, t: s + (t["char_end"] > t["char_start"]).cast("int")), F.lit(0)).alias("response_length"))


def metric_reduce(spark, folder):
    d = table(spark, folder, "events").select(tx.metric_key(F.concat(F.lit("events "), "event_type")).alias("metric"), "value")
    d = batches.metric_means(d, "metric", "value")
    return d.select("metric", F.round("mean", 6).alias("mean"), "n")


def attribution_spans(spark, folder):
    """Quotes (the texts of all blocks, `block` is the place in their list) located in the response, and the tokens they
    overlap. A response without blocks has one row, without a block."""
    d = table(spark, folder, "results").where("tokens is not null and response is not null").select("result_id", "response", stats.only(F.col("tokens"), "char_start", "char_end").alias("tokens"), F.col("candidate_blocks")["text"].alias("q"))
    texts = F.when(F.size("q") > 0, F.col("q")).otherwise(F.array(F.lit(None).cast("string")))
    found = F.transform(texts, lambda q: rubrics.attribution_span(F.col("response"), F.col("tokens"), q))
    d = d.select("result_id", (F.size("q") > 0).alias("any"), F.posexplode_outer(found).alias("at", "s"))
    return d.select("result_id", F.when(F.col("any"), F.col("at")).alias("block"), "s.char_start", "s.char_end", "s.token_start", "s.token_end")


def score_groups(spark, folder):
    """Verdicts as groups: criterion advantages where the verdict is valid, else z-scores of a rule's score."""
    judged = settle(rubric_plans._judged(spark, folder))
    v = table(spark, folder, "verdicts").select("verdict_id", F.posexplode(F.sequence(F.lit(1), F.lit(6))).alias("p", "answer_index"))
    scores = v.select("verdict_id", "answer_index", ((F.col("verdict_id") * 7 + F.col("answer_index") * 3) % 5).cast("double").alias("score"))
    d = groups.group_scores(judged, scores, "verdict_id", "answer_index")
    return d.select("verdict_id", "answer_index", F.round("advantage", 6).alias("advantage"), "used_rule")


def score_pipeline(spark, folder):
    """Verdicts as groups; every fourth has no teacher's answer left."""
    judged = settle(rubric_plans._judged(spark, folder))
    v = table(spark, folder, "verdicts").select("verdict_id", F.posexplode(F.sequence(F.lit(1), F.lit(6))).alias("p", "answer_index"))
    scores = v.select("verdict_id", "answer_index", ((F.col("verdict_id") * 7 + F.col("answer_index") * 3) % 5).cast("double").alias("score"))
    d = groups.score_pipeline(scores, judged, rubric_plans.normalized_scores(spark, folder), table(spark, folder, "verdicts").where("verdict_id % 4 <> 0"), "verdict_id", "answer_index")
    return d.select("verdict_id", "answer_index", F.round("score", 6).alias("score"), F.round("advantage", 6).alias("advantage"), "error")


def _responses(spark, folder):
    r = table(spark, folder, "results").where("tokens is not null and size(tokens) > 0")
    n = F.transform("tokens", lambda t: t["token_index"].cast("double"))
    mask = F.transform("tokens", lambda t: (t["token_index"] < 100).cast("int"))
    return r.select("result_id", F.col("sample_id").alias("uid"), F.size("tokens").cast("double").alias("score"), (F.col("result_id") % 5 != 0).alias("is_onpolicy"), F.transform("tokens", lambda t: (t["token_id"] % 3).cast("double")).alias("rewards"), n.alias("values"), mask.alias("mask"), F.lit(2.0).alias("baseline"))


def advantage_dispatch(spark, folder):
    out = None
    for kind in advantages.ESTIMATORS:
        d = advantages.advantages(_responses(spark, folder), kind).select("result_id", F.lit(kind).alias("estimator"), F.round(F.get("advantages", F.lit(0)), 6).alias("first"), F.round(F.aggregate("advantages", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))
        out = d if out is None else out.unionByName(d)
    return out


def base_urls(spark, folder):
    d = table(spark, folder, "nation").select("n_nationkey", F.concat(F.lit("https://"), F.lower("n_name"), F.element_at(F.array(*map(F.lit, ("/v1/", "/v1/chat/completions", "/v1/completions//", "/v1"))), (F.col("n_nationkey") % 4 + 1).cast("int"))).alias("u"))
    return d.select("n_nationkey", batches.base_url(F.col("u")).alias("url"))


def image_lists(spark, folder):
    d = table(spark, folder, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.array("p_name", "p_brand")).when(F.col("p_partkey") % 3 == 1, F.expr("cast(array() as array<string>)")).alias("images"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).alias("image"))
    return d.select("p_partkey", F.array_join(batches.image_list(F.col("images"), F.col("image")), ",").alias("images"))


QUERIES = {f.__name__: f for f in (teacher_filter, onpolicy_groups, left_pad_collate, row_slice, reorder_rows, minibatch_epochs, length_info, metric_reduce, attribution_spans, score_groups, score_pipeline, advantage_dispatch, base_urls, image_lists)}

_N = "n AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS o, count(*) OVER () AS n FROM customer)"
ORACLE = {
    "teacher_filter": f"""WITH l AS ({text_plans.ORACLE["label_extract"]})
SELECT sample_id, count(*) AS kept FROM results r JOIN l ON r.result_id = l.result_id WHERE NOT coalesce(upper(trim(gold_answer)) IN ('YES', 'NO'), false) OR label = upper(trim(gold_answer)) GROUP BY 1""",
    "onpolicy_groups": "WITH g AS (SELECT l_orderkey, min(l_partkey) AS f, count(*) AS n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1) SELECT l_orderkey, n, row_number() OVER (ORDER BY f, l_orderkey) - 1 AS place FROM g",
    "left_pad_collate": """WITH d AS (SELECT result_id, generated_token_ids AS ids, (row_number() OVER (ORDER BY result_id) - 1) // 256 AS batch FROM results WHERE generated_token_ids IS NOT NULL), m AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch) - len(ids) AS gap FROM d)
SELECT result_id, array_to_string(list_concat(list_resize(CAST([] AS INTEGER[]), gap, 0), ids), ',') AS input_ids, array_to_string(list_concat(list_resize(CAST([] AS INTEGER[]), gap, 0), list_resize(CAST([] AS INTEGER[]), len(ids), 1)), ',') AS mask,
 array_to_string(list_concat(list_resize(CAST([] AS BIGINT[]), gap, 0), range(len(ids))), ',') AS position_ids FROM m""",
    "row_slice": f"WITH {_N} SELECT c_custkey FROM n WHERE o >= 100 AND o < 150",
    "reorder_rows": f"WITH {_N} SELECT a.o AS ordinal, b.c_custkey FROM n a JOIN n b ON (a.o * 7 + 3) % a.n = b.o",
    "minibatch_epochs": f"WITH {_N}, p AS (SELECT c_custkey, o FROM n UNION ALL SELECT c_custkey, n + o FROM n WHERE o < (50 - n % 50) % 50) SELECT CAST(e AS INTEGER) AS epoch, CAST(o // 50 AS INTEGER) AS batch, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys FROM p, range(2) t(e) GROUP BY 1, 2",
    "length_info": "SELECT result_id, CAST(coalesce(length(prompt), 0) AS INTEGER) AS prompt_length, CAST(coalesce(list_sum(list_transform(tokens, lambda t: CAST(t.char_end > t.char_start AS INTEGER))), 0) AS INTEGER) AS response_length FROM results",
    "metric_reduce": "SELECT 'events_' || event_type AS metric, round(avg(value), 6) AS mean, count(value) AS n FROM events GROUP BY 1",
    "attribution_spans": """WITH r AS (SELECT result_id, tokens, response, candidate_blocks AS cb, unnest(CASE WHEN len(candidate_blocks) > 0 THEN range(len(candidate_blocks)) ELSE [NULL] END) AS block FROM results WHERE tokens IS NOT NULL AND response IS NOT NULL),
q AS (SELECT *, CASE WHEN block IS NOT NULL THEN cb[block + 1].text END AS q FROM r),
p AS (SELECT result_id, block, tokens, CASE WHEN coalesce(q, '') = '' THEN -1 ELSE strpos(response, q) - 1 END AS p, length(q) AS n FROM q),
h AS (SELECT result_id, block, p, n, list_filter(list_transform(tokens, lambda t, i: CASE WHEN t.char_end > p AND t.char_start < p + n THEN i - 1 END), lambda x: x IS NOT NULL) AS h FROM p)
SELECT result_id, CAST(block AS INTEGER) AS block, CAST(p AS INTEGER) AS char_start, CAST(CASE WHEN p >= 0 THEN p + n ELSE -1 END AS INTEGER) AS char_end, CAST(CASE WHEN p >= 0 THEN coalesce(list_min(h), -1) ELSE -1 END AS INTEGER) AS token_start, CAST(CASE WHEN p >= 0 THEN coalesce(list_max(h) + 1, -1) ELSE -1 END AS INTEGER) AS token_end FROM h""",
    "score_groups": rubric_plans.ORACLE["criterion_advantages"].replace("SELECT z.verdict_id, answer_index,", ", adv AS (SELECT z.verdict_id, answer_index,") + """),
sc AS (SELECT verdict_id, CAST(i AS INTEGER) AS answer_index, CAST((verdict_id * 7 + i * 3) % 5 AS DOUBLE) AS score FROM verdicts, range(1, 7) t(i)), fs AS (SELECT verdict_id, avg(score) AS m, stddev_samp(score) AS d FROM sc GROUP BY 1)
SELECT sc.verdict_id, sc.answer_index, coalesce(adv.advantage, round(CASE WHEN fs.d > 1e-6 THEN (score - fs.m) / (fs.d + 1e-6) ELSE 0 END, 6)) AS advantage, adv.advantage IS NULL AS used_rule
FROM sc JOIN fs ON sc.verdict_id = fs.verdict_id LEFT JOIN adv ON sc.verdict_id = adv.verdict_id AND sc.answer_index = adv.answer_index""",
    "score_pipeline": rubric_plans.ORACLE["criterion_advantages"].replace("SELECT z.verdict_id, answer_index,", ", adv AS (SELECT z.verdict_id, answer_index,") + """),
nm AS (SELECT verdict_id, answer_index, round(CASE WHEN total > 0 THEN greatest(least(score / total, 1), 0) ELSE 0 END, 6) AS score FROM s),
sc AS (SELECT verdict_id, CAST(i AS INTEGER) AS answer_index, CAST((verdict_id * 7 + i * 3) % 5 AS DOUBLE) AS score FROM verdicts, range(1, 7) t(i)), fs AS (SELECT verdict_id, avg(score) AS m, stddev_samp(score) AS d FROM sc GROUP BY 1),
er AS (SELECT verdict_id, CASE WHEN verdict_id % 4 = 0 THEN 'teacher' WHEN verdict_id NOT IN (SELECT verdict_id FROM r) THEN 'verdict' END AS error FROM verdicts)
SELECT sc.verdict_id, sc.answer_index, CASE WHEN error IS NOT NULL THEN sc.score ELSE coalesce(nm.score, 0) END AS score,
 CASE WHEN error IS NOT NULL THEN round(CASE WHEN fs.d > 1e-6 THEN (sc.score - fs.m) / (fs.d + 1e-6) ELSE 0 END, 6) ELSE coalesce(adv.advantage, 0) END AS advantage, error
FROM sc JOIN fs ON sc.verdict_id = fs.verdict_id JOIN er ON sc.verdict_id = er.verdict_id LEFT JOIN adv ON sc.verdict_id = adv.verdict_id AND sc.answer_index = adv.answer_index LEFT JOIN nm ON sc.verdict_id = nm.verdict_id AND sc.answer_index = nm.answer_index""",
    "advantage_dispatch": """WITH r AS (SELECT result_id, sample_id AS uid, CAST(len(tokens) AS DOUBLE) AS score, result_id % 5 <> 0 AS on_p, tokens FROM results WHERE len(tokens) > 0),
g AS (SELECT uid, count(*) AS n, avg(score) AS m, stddev_samp(score) AS d FROM r WHERE on_p GROUP BY 1),
a AS (SELECT r.result_id, tokens, CASE WHEN NOT on_p THEN 1.0 WHEN n <= 1 THEN score / (1 + 1e-6) ELSE (score - m) / (d + 1e-6) END AS a FROM r LEFT JOIN g ON r.uid = g.uid),
t AS (SELECT result_id, a, unnest(range(len(tokens))) AS pos, CAST(unnest(tokens).token_index < 100 AS INTEGER) AS m, CAST(unnest(tokens).token_id % 3 AS DOUBLE) AS r, CAST(unnest(tokens).token_index AS DOUBLE) AS v FROM a),
s AS (SELECT *, sum(r * m) OVER f - 2.0 * m AS b, r + coalesce(lead(v) OVER (PARTITION BY result_id ORDER BY pos), 0) - v AS d, sum(1 - m) OVER (PARTITION BY result_id ORDER BY pos) AS z FROM t WINDOW f AS (PARTITION BY result_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
e AS (SELECT x.result_id, x.pos, any_value(x.m) AS m, sum(pow(0.95::DOUBLE, y.pos - x.pos) * y.d) AS g FROM s x JOIN s y ON x.result_id = y.result_id AND y.pos >= x.pos GROUP BY 1, 2),
h AS (SELECT result_id, pos, m, sum(r) OVER (PARTITION BY result_id, z ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS g FROM s),
k AS (SELECT 'gae' AS estimator, * FROM e UNION ALL SELECT 'reinforce_plus_plus', * FROM h),
w AS (SELECT estimator, sum(g * m) / (sum(m) + 1e-8) AS mean, sum(m) AS n FROM k GROUP BY 1),
v AS (SELECT k.estimator, any_value(mean) AS mean, sum((g - mean) * (g - mean) * m) / (any_value(n) + 1e-8) * any_value(n) / (any_value(n) - 1) AS var FROM k JOIN w ON k.estimator = w.estimator GROUP BY 1)
SELECT result_id, 'grpo' AS estimator, round(any_value(a * m) FILTER (pos = 0), 6) AS first, round(sum(a * m), 4) AS total FROM s GROUP BY 1
UNION ALL SELECT result_id, 'remax', round(any_value(b) FILTER (pos = 0), 6), round(sum(b), 4) FROM s GROUP BY 1
UNION ALL SELECT result_id, k.estimator, round(any_value((g - mean) / sqrt(var + 1e-8) * m) FILTER (pos = 0), 6), round(sum((g - mean) / sqrt(var + 1e-8) * m), 4) FROM k JOIN v ON k.estimator = v.estimator GROUP BY 1, 2""",
    "base_urls": "SELECT n_nationkey, 'https://' || lower(n_name) || '/v1' AS url FROM nation",
    "image_lists": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name || ',' || p_brand WHEN p_partkey % 2 = 0 THEN p_type END AS images FROM part",
}
