"""Queries on sources and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.operators.batches import with_ordinal
from tracewright.session import table, work_folder
from tracewright.sources import files
from tracewright.streaming import jobs


def samples_loaded(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("doc_id").cast("string")).alias("id"), "source", F.col("text").alias("question"), F.col("discipline").alias("answer"))
    o = with_ordinal(d, [F.col("doc_id")])
    return files.samples(o, "ordinal", "documents").select("sample_id", "source", "question", "answer")


def samples_drawn(spark, folder):
    d = table(spark, folder, "samples").dropDuplicates(["sample_id"]).withColumn("ordinal", F.lit(0))
    return files.samples(d, "ordinal", "samples", {"id": "sample_id"}, most=50, seed=7).select("sample_id")


def event_windows(spark, folder):
    d = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    d = jobs.windowed_counts(d)
    return d.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def event_windows_stream(spark, folder):
    """The same as a stream: the last state of every window."""
    d = jobs.run_to_table(spark, jobs.windowed_counts(jobs.replay(spark, folder, "events")), "windows", "update")
    last = d.groupBy("window_start", "event_type").agg(F.max_by(F.struct("n", "total"), "batch_id").alias("s"))
    return last.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "s.n", F.round("s.total", 4).alias("total"))


def stateful_coef_stream(spark, folder):
    d = jobs.run_to_table(spark, jobs.running_coefficient(jobs.replay(spark, folder, "events").select("user_id", "value"), 10.0, 100, 0.2), "coefficients", "update")
    last = d.groupBy("user_id").agg(F.max_by(F.struct("steps", "coefficient"), "batch_id").alias("s"))
    return last.select("user_id", "s.steps", F.round("s.coefficient", 9).alias("coefficient"))


def stream_filter(spark, folder):
    """A filtered copy of a table through an append sink."""
    d = jobs.replay(spark, folder, "events").where("event_type = 'error'").select("event_id", "user_id")
    return jobs.run_to_table(spark, d, "errors")


def jsonl_round_trip(spark, folder):
    """Nested records as JSON lines and back."""
    d = table(spark, folder, "rubrics")
    path = work_folder(spark, "records") + ".jsonl"
    files.write_jsonl(d, path)
    return files.read_records(spark, path, d.schema).select("sample_id", F.size("rubrics").alias("n"), F.get("rubrics", F.lit(0))["criterion"].alias("criterion"), "maximum_score")


def csv_round_trip(spark, folder):
    """Texts with quotes and line breaks as CSV and back: all columns are texts."""
    d = table(spark, folder, "samples")
    path = work_folder(spark, "records") + ".csv"
    files.write_csv(d, path, ["sample_id", "question", "choices", "none"])
    return files.read_records(spark, path).select("sample_id", F.md5(F.coalesce("question", F.lit(""))).alias("question"), F.coalesce(F.length("choices") > 0, F.lit(False)).alias("has_choices"), F.coalesce("none", F.lit("")).alias("none"))


def split_scan(spark, folder):
    """Two splits of a folder, one as parquet and one as JSON lines, by path@split."""
    base = work_folder(spark, "splits")
    d = table(spark, folder, "customer").select("c_custkey", "c_name")
    d.where("c_custkey % 5 <> 0").write.parquet(f"{base}/train.parquet")
    d.where("c_custkey % 5 = 0").write.json(f"{base}/test.jsonl")
    return files.read_split(spark, base).unionByName(files.read_split(spark, f"{base}@test", d.schema)).select("c_custkey", "c_name", "split")


def outputs_written(spark, folder):
    """The files of a run, counted as they were written; the debug lines are appended to."""
    out = files.write_outputs(table(spark, folder, "results"), work_folder(spark, "outputs"))
    for _ in range(2):
        files.append_json(table(spark, folder, "region"), out["stats"] + "-debug")
    flat = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(out["top_actions"] + "_csv").count()
    s = spark.read.json(out["stats"])
    return s.select("records", "errors", "action_rows", "block_rows", F.lit(spark.read.json(out["candidate_blocks"]).count()).cast("bigint").alias("block_lines"), F.lit(flat).cast("bigint").alias("action_lines"), F.lit(spark.read.json(out["stats"] + "-debug").count()).cast("bigint").alias("debug_lines"))


QUERIES = {f.__name__: f for f in (samples_loaded, samples_drawn, event_windows, event_windows_stream, stateful_coef_stream, stream_filter, jsonl_round_trip, csv_round_trip, split_scan, outputs_written)}

_STRIP = "regexp_replace({x}, '^[\\s\\p{{Z}}\\x{{85}}]+|[\\s\\p{{Z}}\\x{{85}}]+$', '', 'g')"
_W = "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"
ORACLE = {
    "samples_loaded": f"""WITH d AS (SELECT doc_id, source, text AS q, discipline, row_number() OVER (ORDER BY doc_id) - 1 AS o FROM documents)
SELECT CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id AS VARCHAR) ELSE 'sample-' || lpad(CAST(o AS VARCHAR), 6, '0') END AS sample_id, coalesce(nullif({_STRIP.format(x="source")}, ''), 'documents') AS source,
 {_STRIP.format(x="q")} AS question, coalesce({_STRIP.format(x="discipline")}, '') AS answer FROM d WHERE coalesce({_STRIP.format(x="q")}, '') <> ''""",
    "samples_drawn": "SELECT sample_id FROM (SELECT DISTINCT sample_id FROM samples) ORDER BY sha256('7' || chr(31) || sample_id) LIMIT 50",
    "event_windows": _W,
    "event_windows_stream": _W,
    "stateful_coef_stream": "SELECT user_id, count(*) AS steps, round(0.2::DOUBLE * (1 + least(greatest(avg(value) / 10 - 1, -0.2::DOUBLE), 0.2::DOUBLE) * count(*) / 100), 9) AS coefficient FROM events GROUP BY user_id",
    "stream_filter": "SELECT event_id, user_id FROM events WHERE event_type = 'error'",
    "jsonl_round_trip": "SELECT sample_id, CAST(len(rubrics) AS INTEGER) AS n, rubrics[1].criterion AS criterion, maximum_score FROM rubrics",
    "csv_round_trip": "SELECT sample_id, md5(coalesce(question, '')) AS question, choices IS NOT NULL AS has_choices, '' AS none FROM samples",
    "split_scan": "SELECT c_custkey, c_name, CASE WHEN c_custkey % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM customer",
    "outputs_written": """WITH o AS (SELECT CAST(sum(coalesce(len(top_actions), 0)) FILTER (error IS NULL) AS BIGINT) AS a, CAST(sum(coalesce(len(candidate_blocks), 0)) FILTER (error IS NULL) AS BIGINT) AS b FROM results)
SELECT count(*) AS records, count(error) AS errors, CAST(sum(coalesce(len(top_actions), 0)) AS BIGINT) AS action_rows, CAST(sum(coalesce(len(candidate_blocks), 0)) AS BIGINT) AS block_rows, any_value(b) AS block_lines, any_value(a) AS action_lines, 2 * (SELECT count(*) FROM region) AS debug_lines FROM results, o""",
}
