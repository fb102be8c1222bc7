"""Queries on the figures of a run."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.operators import run_metrics as rm
from tracewright.session import table


def _rounded(d, n=6):
    return d.select(*(F.round(F.col(c).cast("double"), n).alias(c) for c in d.columns))


def batch_metrics(spark, folder):
    d = table(spark, folder, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_linestatus", "l_linenumber")
    figures = {"reward": F.col("l_quantity"), "value": F.col("l_discount"), "advantage": F.col("l_tax")}
    return _rounded(rm.batch_metrics(d, figures, "l_linenumber", masks={"advantage": F.col("l_linestatus") == "F"}))


def explained_variance(spark, folder):
    return _rounded(rm.explained_variance(table(spark, folder, "lineitem").select("l_quantity", "l_linenumber"), "l_quantity", "l_linenumber"))


def timing_per_token(spark, folder):
    d = table(spark, folder, "results").select(F.coalesce(F.size("tokens"), F.lit(0)).alias("r"), (F.coalesce(F.size("tokens"), F.lit(0)) + F.coalesce(F.length("prompt"), F.lit(0))).alias("o"), (F.col("result_id") % 11).cast("double").alias("a"), (F.col("result_id") % 5).cast("double").alias("b"))
    d = rm.timing_per_token(d, {"gen": "a", "update": "b"}, "r", "o")
    return d.select("stage", F.round("ms_per_token", 6).alias("ms_per_token"))


def batch_kl(spark, folder):
    d = table(spark, folder, "lineitem").select("l_orderkey", (F.col("l_tax") - F.col("l_discount")).alias("v"), (F.col("l_linestatus") == "F").cast("int").alias("m"))
    return _rounded(rm.sequence_kl(d, "l_orderkey", "v", "m"))


def flops_estimate(spark, folder):
    d = table(spark, folder, "results").select(F.coalesce(F.size("tokens"), F.lit(0)).alias("n"))
    return _rounded(rm.flops(d, "n", 6e8, 128, 16, 28), 4)


def device_peaks(spark, folder):
    d = table(spark, folder, "part").select("p_partkey", F.concat(F.lit("NVIDIA "), F.element_at(F.array(*map(F.lit, ("H100-80G", "A800", "L40S", "L20", "H20", "910B2", "V100"))), (F.col("p_partkey") % 7 + 1).cast("int"))).alias("name"))
    return d.select("p_partkey", rm.peak_tflops(F.col("name")).alias("tflops"), rm.with_unit((F.col("p_partkey") + 1) * 1000003.0).alias("size"))


def metric_lines(spark, folder):
    d = table(spark, folder, "orders").select(F.col("o_orderkey").alias("step"), F.col("o_totalprice").alias("price"), F.when(F.col("o_custkey") % 3 == 0, F.col("o_custkey")).alias("cust"))
    return d.select("step", rm.metric_line(["price", "cust"]).alias("line"))


def _paths(spark, folder):
    d = table(spark, folder, "customer")
    return d.select(F.concat(F.lit("/run/"), F.when(F.col("c_custkey") % 7 == 0, F.lit("tmp_")).otherwise(F.lit("global_step_")), F.col("c_custkey").cast("string")).alias("path"), F.round("c_acctbal", 2).alias("score"))


def latest_checkpoint(spark, folder):
    return rm.latest_checkpoint(_paths(spark, folder), "path")


def checkpoint_retention(spark, folder):
    return rm.checkpoints_to_drop(_paths(spark, folder), "path", 5, "score").select("path", "step")


def checkpoint_removal(spark, folder):
    """Whole checkpoints beyond the newest 20, shards of those beyond the newest 5."""
    return rm.retention(_paths(spark, folder), "path", "score", 20, 5)


def model_work(spark, folder):
    d = table(spark, folder, "results").select(F.coalesce(F.size("tokens"), F.lit(0)).alias("n"))
    shape = {"hidden_size": 1024, "vocab_size": 50_000, "layers": 28, "heads": 16, "kv_heads": 8, "intermediate_size": 3072}
    out = [rm.model_flops(d, "n", shape | {"model_type": t}, 4.0).select(F.lit(t).alias("model_type"), F.round("tflops", 4).alias("tflops")) for t in ("qwen2", "unheard")]
    return out[0].unionByName(out[1])


def validation_samples(spark, folder):
    d = table(spark, folder, "results").where("error is null").select("result_id", "sample_id", "gold_answer")
    v = rm.validation_table(d, F.lit(3), ["result_id", "sample_id", "gold_answer"], F.sha2(F.concat_ws("-", F.lit("42"), F.col("result_id").cast("string")), 256), 8)
    return v.select("step", F.array_join(F.transform("samples", lambda s: s["result_id"].cast("string")), ",").alias("ids"))


def validation_wide(spark, folder):
    d = table(spark, folder, "results").where("error is null").select("result_id", "sample_id", "gold_answer")
    return rm.validation_row(d, F.lit(3), ["result_id", "sample_id", "gold_answer"], F.sha2(F.concat_ws("-", F.lit("42"), F.col("result_id").cast("string")), 256), 4)


def review_actions(spark, folder):
    d = table(spark, folder, "results").select("result_id", "question", "gold_answer", "error", "top_actions", "candidate_blocks")
    return rm.review(d, 20, "result_id")


def review_report(spark, folder):
    d = table(spark, folder, "results").where("error is null").select("result_id", "sample_id", "question")
    return rm.report(d, ["sample_id", "question"], 20, "result_id")


def run_stats(spark, folder):
    r = table(spark, folder, "results")
    return r.agg(F.count(F.lit(1)).alias("records"), F.count("error").alias("errors"), F.sum(F.coalesce(F.size("top_actions"), F.lit(0))).alias("action_rows"), F.sum(F.coalesce(F.size("candidate_blocks"), F.lit(0))).alias("block_rows"))


QUERIES = {f.__name__: f for f in (batch_metrics, explained_variance, timing_per_token, batch_kl, flops_estimate, device_peaks, metric_lines, latest_checkpoint, checkpoint_retention, checkpoint_removal, model_work, validation_samples, validation_wide, review_actions, review_report, run_stats)}

_P = "p AS (SELECT c_custkey AS step, '/run/global_step_' || c_custkey AS path, round(c_acctbal, 2) AS score FROM customer WHERE c_custkey % 7 <> 0)"
ORACLE = {
    "batch_metrics": """SELECT round(avg(l_quantity), 6) AS reward_mean, round(max(l_quantity), 6) AS reward_max, round(min(l_quantity), 6) AS reward_min, round(avg(l_discount), 6) AS value_mean, round(max(l_discount), 6) AS value_max, round(min(l_discount), 6) AS value_min,
 round(avg(l_tax) FILTER (l_linestatus = 'F'), 6) AS advantage_mean, round(max(l_tax) FILTER (l_linestatus = 'F'), 6) AS advantage_max, round(min(l_tax) FILTER (l_linestatus = 'F'), 6) AS advantage_min,
 round(avg(l_linenumber), 6) AS length_mean, CAST(max(l_linenumber) AS DOUBLE) AS length_max, CAST(min(l_linenumber) AS DOUBLE) AS length_min, round(avg(CAST(l_linenumber >= (SELECT max(l_linenumber) FROM lineitem) AS DOUBLE)), 6) AS clip_ratio FROM lineitem""",
    "explained_variance": "SELECT round(1 - var_samp(l_quantity - l_linenumber) / (var_samp(l_quantity) + 1e-5), 6) AS explained_variance FROM lineitem",
    "timing_per_token": """WITH d AS (SELECT coalesce(len(tokens), 0) AS r, coalesce(len(tokens), 0) + coalesce(length(prompt), 0) AS o, result_id % 11 AS a, result_id % 5 AS b FROM results)
SELECT 'gen' AS stage, round(sum(a) * 1000.0::DOUBLE / sum(r), 6) AS ms_per_token FROM d UNION ALL SELECT 'update', round(sum(b) * 1000.0::DOUBLE / sum(o), 6) FROM d""",
    "batch_kl": "SELECT round(avg(m), 6) AS kl FROM (SELECT sum((l_tax - l_discount) * CAST(l_linestatus = 'F' AS INTEGER)) / (sum(CAST(l_linestatus = 'F' AS INTEGER)) + 1e-8) AS m FROM lineitem GROUP BY l_orderkey)",
    "flops_estimate": "SELECT round((6.0::DOUBLE * 6e8 * sum(n) + 12.0::DOUBLE * sum(n * n) * 57344) / 1e12, 4) AS tflops FROM (SELECT CAST(coalesce(len(tokens), 0) AS DOUBLE) AS n FROM results)",
    "device_peaks": """SELECT p_partkey, CAST(CASE p_partkey % 7 WHEN 0 THEN 989 WHEN 1 THEN 312 WHEN 2 THEN 181.05 WHEN 3 THEN 119.5 WHEN 4 THEN 148 WHEN 5 THEN 354 END AS DOUBLE) AS tflops,
 CASE WHEN n > 1e9 THEN printf('%.2fB', n / 1e9) WHEN n > 1e6 THEN printf('%.2fM', n / 1e6) ELSE printf('%.2fK', n / 1e3) END AS size FROM (SELECT p_partkey, (p_partkey + 1) * 1000003.0::DOUBLE AS n FROM part)""",
    "metric_lines": "SELECT o_orderkey AS step, concat_ws(' - ', 'step:' || o_orderkey, printf('price:%.3f', o_totalprice), CASE WHEN o_custkey % 3 = 0 THEN printf('cust:%.3f', CAST(o_custkey AS DOUBLE)) END) AS line FROM orders",
    "latest_checkpoint": f"WITH {_P} SELECT arg_max(path, step) AS path, max(step) AS step FROM p",
    "checkpoint_retention": f"WITH {_P} SELECT path, step FROM p WHERE step NOT IN (SELECT step FROM p ORDER BY step DESC LIMIT 5) AND step <> (SELECT step FROM p ORDER BY score DESC, step DESC LIMIT 1)",
    "checkpoint_removal": f"""WITH {_P}, b AS (SELECT step FROM p ORDER BY score DESC, step DESC LIMIT 1), o AS (SELECT path, step, row_number() OVER (ORDER BY step DESC) AS n FROM p),
d AS (SELECT path, step, CASE WHEN n > 20 AND step NOT IN (SELECT step FROM b) THEN 'all' END AS d FROM o), k AS (SELECT path, step, row_number() OVER (ORDER BY step DESC) AS n FROM d WHERE d IS NULL)
SELECT path, step, d AS "drop" FROM d WHERE d = 'all' UNION ALL SELECT path, step, 'shards' FROM k WHERE n > 5 AND step NOT IN (SELECT step FROM b)""",
    "model_work": "SELECT 'qwen2' AS model_type, round((6.0::DOUBLE * ((3.0::DOUBLE * 1024 * 3072 + 1024 * 48 * 64) * 28 + 2.0::DOUBLE * 50000 * 1024) * sum(n) + 12.0::DOUBLE * sum(n * n) * 64 * 16 * 28) / 1e12 / 4, 4) AS tflops FROM (SELECT CAST(coalesce(len(tokens), 0) AS DOUBLE) AS n FROM results) UNION ALL SELECT 'unheard', 0",
    "validation_samples": "SELECT 3 AS step, string_agg(CAST(result_id AS VARCHAR), ',' ORDER BY result_id) AS ids FROM (SELECT result_id FROM results WHERE error IS NULL ORDER BY sha256('42-' || result_id) LIMIT 8)",
    "validation_wide": "WITH t AS (SELECT result_id, sample_id, gold_answer FROM results WHERE error IS NULL ORDER BY sha256('42-' || result_id) LIMIT 4), n AS (SELECT *, row_number() OVER (ORDER BY result_id) AS n FROM t) SELECT 3 AS step, "
    + ", ".join(f"any_value({c}) FILTER (n = {i}) AS {c}_{i}" for i in range(1, 5) for c in ("result_id", "sample_id", "gold_answer"))
    + " FROM n",
    "review_actions": """WITH r AS (SELECT * FROM results WHERE error IS NULL ORDER BY result_id LIMIT 20),
t AS (SELECT result_id, array_to_string(list_concat(['## ' || result_id, 'Question: ' || left(coalesce(question, ''), 1200), 'Expected: ' || coalesce(gold_answer, ''), 'Top actions:'],
 coalesce(list_transform(top_actions, lambda a, i: i || '. [' || coalesce(printf('%.3f', a.entropy_robust_z), '-') || '] ' || coalesce(a.text, '')), []), ['Blocks:'],
 coalesce(list_transform(candidate_blocks, lambda b: '- block ' || b.block_index || ' [' || coalesce(printf('%.3f', b.block_max_robust_e), '-') || ']: ' || coalesce(b.text, '')), [])), chr(10)) AS x FROM r)
SELECT string_agg(x, chr(10) || chr(10) ORDER BY result_id) AS text FROM t""",
    "review_report": "SELECT string_agg('## ' || result_id || chr(10) || '- sample_id: ' || left(coalesce(sample_id, ''), 1200) || chr(10) || '- question: ' || left(coalesce(question, ''), 1200), chr(10) || chr(10) ORDER BY result_id) AS text FROM (SELECT * FROM results WHERE error IS NULL ORDER BY result_id LIMIT 20)",
    "run_stats": "SELECT count(*) AS records, count(error) AS errors, CAST(sum(coalesce(len(top_actions), 0)) AS BIGINT) AS action_rows, CAST(sum(coalesce(len(candidate_blocks), 0)) AS BIGINT) AS block_rows FROM results",
}
