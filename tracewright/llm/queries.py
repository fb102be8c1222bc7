"""Registered queries of the training-data operators (problems 1 and 3 to 8) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import mix as mixing
from tracewright.llm import pack as packing
from tracewright.llm import pairs, radix, spam, split
from tracewright.llm.tokens import token_count
from tracewright.session import settle, table

# ---- Problem 1


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split.split_oversized(table(spark, folder, "results").where("error is null"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_pieces(spark, folder).where("piece_index = 0").select("result_id", "need")


def p1_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """The same pieces in tokens, with ranges so small that most texts have several."""
    p = split.split_oversized(table(spark, folder, "results").where("error is null"), range_bytes=1024, halo=16)
    return p.select("result_id", "need", "piece_index", "n_pieces", "token_start", "token_end", "n_tokens", "hard_cut")


_P1_SQL = """
WITH RECURSIVE a AS (
 SELECT result_id, response, list_distinct(list_transform(actions, lambda x: {'i': x.action_index, 'n': coalesce(x.token_count, len(x.token_indices), 0)})) AS s
 FROM results WHERE error IS NULL AND response IS NOT NULL),
b AS (
 SELECT result_id, CASE WHEN len(s) > 0 THEN list_sum(list_transform(s, lambda x: x.n)) ELSE ceil(length(response) / 4.0) END AS total,
  CASE WHEN len(s) > 0 THEN list_max(list_transform(s, lambda x: x.n))
   ELSE list_max(list_transform(string_split(response, chr(10)), lambda x, i: ceil((length(x) + CASE WHEN i < len(string_split(response, chr(10))) THEN 1 ELSE 0 END) / 4.0))) END AS longest
 FROM a)
"""
P1_SQL = _P1_SQL + "SELECT result_id, CASE WHEN longest > 288 THEN 'hard_cut' ELSE 'split' END AS need FROM b WHERE total > 320"
# A unit is a token, or a character of a text without actions.
P1_RANGES_SQL = (
    _P1_SQL
    + """,
c AS (
 SELECT r.result_id, CASE WHEN longest > 288 THEN 'hard_cut' ELSE 'split' END AS need, CASE WHEN len(s) > 0 THEN 1 ELSE 4 END AS u,
  CASE WHEN len(s) > 0 THEN total ELSE length(r.response) END AS total,
  CASE WHEN len(s) > 0 THEN list_transform(list_sort(list_distinct(list_transform(actions, lambda x: {'at': coalesce(x.char_start, 0), 'i': x.action_index, 'n': coalesce(x.token_count, len(x.token_indices), 0)}))), lambda x: x.n)
   ELSE list_transform(string_split(r.response, chr(10)), lambda x, i: length(x) + CASE WHEN i < len(string_split(r.response, chr(10))) THEN 1 ELSE 0 END) END AS sizes
 FROM b JOIN a USING (result_id) JOIN results r USING (result_id) WHERE b.total > 320),
d AS (SELECT result_id, need, u, total, list_transform(sizes, lambda x, i: list_sum(sizes[1:i])) AS ends FROM c),
p AS (
 SELECT result_id, 0 AS piece_index, CAST(0 AS BIGINT) AS f, CAST(CASE WHEN total <= 320 * u THEN total ELSE coalesce(list_max(list_filter(ends, lambda x: x > 32 * u AND x <= 320 * u)), 320 * u) END AS BIGINT) AS t FROM d
 UNION ALL
 SELECT p.result_id, p.piece_index + 1, p.t - 32 * u,
  CAST(CASE WHEN total - (p.t - 32 * u) <= 320 * u THEN total ELSE coalesce(list_max(list_filter(ends, lambda x: x > p.t AND x <= p.t + 288 * u)), p.t + 288 * u) END AS BIGINT)
 FROM p JOIN d USING (result_id) WHERE p.t < total)
SELECT result_id, need, piece_index, CAST(count(*) OVER (PARTITION BY result_id) AS INT) AS n_pieces, CAST(f // u AS INT) AS token_start,
 CAST(f // u + ceil((t - f) / u) AS INT) AS token_end, CAST(ceil((t - f) / u) AS INT) AS n_tokens, t < total AND NOT list_contains(ends, t) AS hard_cut
FROM p JOIN d USING (result_id)"""
)

# ---- Problem 3

METRICS = ("token_entropy", "action_entropy_topr_mean")


def _values(spark: SparkSession, folder: str) -> DataFrame:
    """(source, run_day, metric, value): measured values only. An action that a row lists twice counts once."""
    r = table(spark, folder, "results")
    s = mixing.source_key(F.col("source")).alias("source")
    t = r.select(s, "run_day", F.lit(METRICS[0]).alias("metric"), F.explode("tokens.entropy").alias("value"))
    once = F.array_distinct(F.arrays_zip(F.col("actions.action_index").alias("i"), F.col("actions.entropy_topr_mean").alias("v")))
    a = r.select(s, "run_day", F.lit(METRICS[1]).alias("metric"), F.explode(once["v"]).alias("value"))
    return t.unionByName(a).where(F.col("value") >= 0)


def p3_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Per source; error_bound is stated in each row. Counted by source at once: day tables added up give the same rows."""
    t = settle(radix.digit_table(_values(spark, folder), ["source", "metric"], "value"))
    return radix.percentiles(t, ["source", "metric"])


def _day_digits(spark: SparkSession, folder: str) -> DataFrame:
    return settle(radix.digit_table(_values(spark, folder), ["source", "run_day", "metric"], "value"))


def p3_daily(spark: SparkSession, folder: str) -> DataFrame:
    return radix.percentiles(_day_digits(spark, folder), ["source", "run_day", "metric"])


def p3_weekly(spark: SparkSession, folder: str) -> DataFrame:
    """Per source and week, from the written tables of the days alone."""
    t = _day_digits(spark, folder).withColumn("week", F.trunc("run_day", "week"))
    return radix.percentiles(settle(radix.combine(t, ["source", "week", "metric"])), ["source", "week", "metric"])


def p3_exact(spark: SparkSession, folder: str) -> DataFrame:
    """Per source, all 64 bits followed."""
    d = radix.exact_percentiles(_values(spark, folder), ["source", "metric"], "value")
    return d.select("source", "metric", "p", "n_values", F.round("value", 9).alias("value"))


_VALUES_SQL = """
WITH v AS (
 SELECT nullif(lower(trim(source)), '') AS source, run_day, 'token_entropy' AS metric, unnest(list_transform(tokens, lambda x: x.entropy)) AS value FROM results
 UNION ALL SELECT nullif(lower(trim(source)), ''), run_day, 'action_entropy_topr_mean', unnest(list_distinct(list_transform(actions, lambda x: {'i': x.action_index, 'v': coalesce(x.entropy_topr_mean, -1)}))).v FROM results),
w AS (SELECT *, CAST(date_trunc('week', run_day) AS DATE) AS week FROM v WHERE value >= 0 AND NOT isnan(value) AND NOT isinf(value))"""
P3_EXACT_SQL = (
    _VALUES_SQL
    + """
SELECT source, metric, CAST(p AS DOUBLE) AS p, n AS n_values, round(CAST(q AS DOUBLE), 9) AS value FROM (
 SELECT source, metric, count(*) AS n, unnest([0.5, 0.9, 0.99]) AS p, unnest(quantile_disc(value, [0.5, 0.9, 0.99])) AS q FROM w GROUP BY source, metric)"""
)

def _digit_sql(keys: str) -> str:
    """The exact nearest-rank percentile, and least and greatest value with the same leading 20 bits."""
    return (
        _VALUES_SQL
        + f""",
b AS (SELECT {keys}, value + 0.0 AS value, CAST(CAST(value + 0.0 AS BIT) AS BIGINT) >> 44 AS digit FROM w),
d AS (SELECT {keys}, digit, count(*) AS n, min(value) AS lo, max(value) AS hi FROM b GROUP BY {keys}, digit),
q AS (SELECT {keys}, n, p, CAST(CAST(q + 0.0 AS BIT) AS BIGINT) >> 44 AS digit FROM (SELECT {keys}, count(*) AS n, unnest([0.5, 0.9, 0.99]) AS p, unnest(quantile_disc(value, [0.5, 0.9, 0.99])) AS q FROM b GROUP BY {keys}))
SELECT {", ".join(f"q.{k.strip()}" for k in keys.split(","))}, CAST(p AS DOUBLE) AS p, q.n AS n_values, lo + (hi - lo) / 2 AS value, lo, hi, (hi - lo) / 2 AS error_bound
FROM q JOIN d ON q.digit = d.digit AND {" AND ".join(f"q.{k.strip()} IS NOT DISTINCT FROM d.{k.strip()}" for k in keys.split(","))}"""
    )


# ---- Problems 4 and 5


def _answered(spark: SparkSession, folder: str) -> DataFrame:
    r = table(spark, folder, "results").where("error is null")
    return r.select("result_id", mixing.source_key(F.col("source")).alias("source"), "question", "prompt", "response", "gold_answer")


def p4_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Every response's probability of being cut, and the decision."""
    return pairs.cut_rows(_answered(spark, folder))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return p4_scores(spark, folder).where("is_cut").select("result_id")


def p4_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Per source (null: none given), the share of its responses that were cut."""
    n = p4_scores(spark, folder).groupBy("source").agg(F.count(F.lit(1)).alias("n_responses"), F.sum(F.col("is_cut").cast("bigint")).alias("n_cut"))
    return n.withColumn("cut_share", F.col("n_cut") / F.col("n_responses"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.broken_pairs(_answered(spark, folder))


# ---- Problem 6


def _sized(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents")
    return d.select("doc_id", "source", token_count(F.col("text")).alias("n_tokens"))


def p6_sequences(spark: SparkSession, folder: str) -> DataFrame:
    sized = settle(_sized(spark, folder).select("doc_id", "n_tokens"))  # read twice; the texts only once
    return packing.pack(sized, "doc_id", "n_tokens", sized.count())


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return p6_sequences(spark, folder).where("piece_index = 0 and n_pieces > 1").select("doc_id")


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Sequences, tokens and the share of room left over, with the least possible number of sequences."""
    s = p6_sequences(spark, folder).where("sequence_id is not null").groupBy("sequence_id").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("n"))
    return s.agg(
        F.count(F.lit(1)).alias("n_sequences"), F.sum("n").alias("n_placed"), F.sum("used").alias("n_tokens"), F.max("used").alias("fullest"),
        F.ceil(F.sum("used") / packing.CAPACITY).alias("least_sequences"), (1 - F.sum("used") / (F.count(F.lit(1)) * packing.CAPACITY)).alias("room_left"),
    )


# ---- Problem 7


def _mixed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    sized = settle(_sized(spark, folder))  # (id, source, size): read by several steps, the texts only once
    return mixing.mix(sized, table(spark, folder, "mix_targets"))


def p7_uses(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder)[0]


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder)[1]


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7_shares(spark, folder).where("is_short").select("source")


# ---- Problem 8


def p8_scores(spark: SparkSession, folder: str) -> DataFrame:
    return spam.spam_pages(table(spark, folder, "documents"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_scores(spark, folder).where("is_spam").select("doc_id")


QUERIES = {
    "p1_found": p1_found, "p1_pieces": p1_pieces, "p1_ranges": p1_ranges,
    "p3_percentiles": p3_percentiles, "p3_daily": p3_daily, "p3_weekly": p3_weekly, "p3_exact": p3_exact,
    "p4_found": p4_found, "p4_scores": p4_scores, "p4_sources": p4_sources,
    "p5_found": p5_found,
    "p6_found": p6_found, "p6_sequences": p6_sequences, "p6_fill": p6_fill,
    "p7_found": p7_found, "p7_uses": p7_uses, "p7_shares": p7_shares,
    "p8_found": p8_found, "p8_scores": p8_scores,
}

ORACLE = {
    "p1_found": P1_SQL, "p1_ranges": P1_RANGES_SQL, "p3_exact": P3_EXACT_SQL, "p3_percentiles": _digit_sql("source, metric"),
    "p3_daily": _digit_sql("source, run_day, metric"), "p3_weekly": _digit_sql("source, week, metric"),
}
