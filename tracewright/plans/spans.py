"""Queries on steps, peaks, blocks and overlaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import arrays, stats
from tracewright.operators import spans
from tracewright.session import table


def _r(spark, folder):
    return table(spark, folder, "results").where("response is not null")


def micro_action_split(spark, folder):
    d = _r(spark, folder).select("result_id", F.posexplode(spans.split_actions(F.col("response"))).alias("pos", "s"))
    return d.select("result_id", "pos", "s.char_start", "s.char_end", "s.text")


def span_candidates(spark, folder):
    d = spans.candidates(_r(spark, folder).where("tokens is not null").select("result_id", "response", "tokens"), "response", "tokens")
    # inline_outer: an inner explode is given a filter on the array's size, which is pushed below the stages that make it.
    return d.select("result_id", F.inline_outer("candidate_blocks")).where("block_index is not null")


def _given(spark, folder):
    """The delivered actions, in order and each once, with their delivered z."""
    own = stats.only(F.col("actions"), "action_index", "entropy_robust_z", "char_start", "char_end", "token_indices", "text")
    ok = F.filter(own, lambda a: a["entropy_robust_z"].isNotNull() & ~F.isnan(a["entropy_robust_z"]))
    keyed = F.transform(ok, lambda a: F.struct(a["action_index"].alias("action_index"), F.round(a["entropy_robust_z"], 6).alias("z"), a["char_start"].alias("char_start"), a["char_end"].alias("char_end"), F.coalesce(a["token_indices"], F.expr("cast(array() as array<int>)")).alias("token_indices"), a["text"].alias("text")))
    return _r(spark, folder).where("actions is not null").select("result_id", F.array_sort(F.array_distinct(keyed)).alias("a"))


def topk_spans(spark, folder):
    d = _given(spark, folder).select("result_id", F.posexplode(spans.top_actions(F.col("a"), 5)).alias("rank", "t"))
    return d.select("result_id", "rank", "t.action_index", "t.z")


def local_peaks(spark, folder):
    z = lambda i: F.coalesce(F.when(i >= 0, F.get("a", i)["z"]), F.lit(float("-inf")))
    hit = F.filter(F.transform("a", lambda a, i: F.struct(a["action_index"].alias("action_index"), a["z"].alias("z"), ((a["z"] >= 0.5) & (a["z"] >= z(i - 1)) & (a["z"] > z(i + 1))).alias("peak"))), lambda x: x["peak"])
    return _given(spark, folder).select("result_id", F.explode(hit).alias("p")).select("result_id", "p.action_index", "p.z")


def peak_blocks(spark, folder):
    d = _given(spark, folder).select("result_id", F.posexplode(spans.peak_blocks(F.col("a"), 12, 6)).alias("block_index", "b"))
    return d.select("result_id", "block_index", "b.anchor", F.array_join("b.action_ids", ",").alias("action_ids"), F.round("b.max_z", 6).alias("max_z"))


def token_span_overlap(spark, folder):
    r = _r(spark, folder)
    t = r.select("result_id", F.inline(stats.only(F.col("tokens"), "token_index", "char_start", "char_end"))).withColumnRenamed("token_index", "token_id")
    s = r.select("result_id", F.inline(stats.only(F.col("candidate_blocks"), "block_index", "char_start", "char_end"))).withColumnRenamed("block_index", "span_id")
    return spans.overlap_rows(t.dropDuplicates(["result_id", "token_id"]), s.dropDuplicates(["result_id", "span_id"]), ["result_id"])


def quote_spans(spark, folder):
    """Where the gold answer stands in the response, and the tokens it covers."""
    d = _r(spark, folder).withColumn("at", arrays.quote_span(F.col("response"), F.col("gold_answer"))).where("at >= 0 and tokens is not null")
    hit = arrays.char_overlap(F.col("tokens"), F.col("at"), F.col("at") + F.length("gold_answer"))
    d = d.select("result_id", "at", hit.alias("h"))
    return d.select("result_id", F.col("at").alias("char_start"), F.coalesce(F.array_min("h"), F.lit(-1)).alias("token_start"), F.coalesce(F.array_max("h") + 1, F.lit(-1)).alias("token_end"))


QUERIES = {f.__name__: f for f in (micro_action_split, span_candidates, topk_spans, local_peaks, peak_blocks, token_span_overlap, quote_spans)}

_G = """g AS (SELECT DISTINCT result_id, a.action_index AS i, round(a.entropy_robust_z, 6) AS z FROM (SELECT result_id, unnest(actions) AS a FROM results WHERE response IS NOT NULL)
 WHERE a.entropy_robust_z IS NOT NULL AND NOT isnan(a.entropy_robust_z)),
n AS (SELECT *, row_number() OVER (PARTITION BY result_id ORDER BY z DESC, i) AS rk, coalesce(lag(z) OVER w, '-inf'::DOUBLE) AS l, coalesce(lead(z) OVER w, '-inf'::DOUBLE) AS r,
 row_number() OVER w - 1 AS pos FROM g WINDOW w AS (PARTITION BY result_id ORDER BY i))"""
ORACLE = {
    "topk_spans": f"WITH {_G} SELECT result_id, CAST(rk - 1 AS INTEGER) AS rank, i AS action_index, z FROM n WHERE rk <= 5",
    "local_peaks": f"WITH {_G} SELECT result_id, i AS action_index, z FROM n WHERE z >= 0.5 AND z >= l AND z > r",
    "peak_blocks": f"""
WITH RECURSIVE {_G},
m AS (SELECT *, coalesce(lag(rk) OVER w <= 12, false) AS lt, coalesce(lead(rk) OVER w <= 12, false) AS rt, lag(i) OVER w AS li, lead(i) OVER w AS ri, lag(z) OVER w AS lz, lead(z) OVER w AS rz FROM n WINDOW w AS (PARTITION BY result_id ORDER BY i)),
p AS (SELECT result_id, i AS anchor, row_number() OVER (PARTITION BY result_id ORDER BY rk) AS o,
 list_concat(list_concat(CASE WHEN lt THEN [li] ELSE [] END, [i]), CASE WHEN rt THEN [ri] ELSE [] END) AS ids, greatest(z, CASE WHEN lt THEN lz ELSE z END, CASE WHEN rt THEN rz ELSE z END) AS mz
 FROM m WHERE rk <= 12 AND z >= 0.5 AND z >= l AND z > r),
f AS (SELECT result_id, CAST(0 AS BIGINT) AS o, CAST([] AS INTEGER[]) AS used, CAST(0 AS BIGINT) AS k, CAST(NULL AS BOOLEAN) AS took FROM (SELECT DISTINCT result_id FROM p)
 UNION ALL SELECT p.result_id, p.o, CASE WHEN NOT list_has_any(f.used, p.ids) AND f.k < 6 THEN list_concat(f.used, p.ids) ELSE f.used END, f.k + CASE WHEN NOT list_has_any(f.used, p.ids) AND f.k < 6 THEN 1 ELSE 0 END, NOT list_has_any(f.used, p.ids) AND f.k < 6
 FROM f JOIN p ON p.result_id = f.result_id AND p.o = f.o + 1)
SELECT f.result_id, CAST(f.k - 1 AS INTEGER) AS block_index, p.anchor, array_to_string(p.ids, ',') AS action_ids, round(p.mz, 6) AS max_z FROM f JOIN p ON p.result_id = f.result_id AND p.o = f.o WHERE f.took""",
    "token_span_overlap": """
WITH t AS (SELECT DISTINCT ON (result_id, t.token_index) result_id, t.token_index AS token_id, t.char_start AS a, t.char_end AS b FROM (SELECT result_id, unnest(tokens) AS t FROM results WHERE response IS NOT NULL)),
s AS (SELECT DISTINCT ON (result_id, b.block_index) result_id, b.block_index AS span_id, b.char_start AS a, b.char_end AS b FROM (SELECT result_id, unnest(candidate_blocks) AS b FROM results WHERE response IS NOT NULL))
SELECT t.result_id, span_id, token_id FROM t JOIN s ON t.result_id = s.result_id AND t.b > s.a AND t.a < s.b AND t.b > t.a AND s.b > s.a""",
    "quote_spans": """
WITH q AS (SELECT result_id, tokens, CAST(strpos(response, gold_answer) - 1 AS INTEGER) AS p0, length(gold_answer) AS n FROM results WHERE response IS NOT NULL AND tokens IS NOT NULL AND coalesce(gold_answer, '') <> '' AND strpos(response, gold_answer) > 0),
h AS (SELECT result_id, p0, list_filter(list_transform(tokens, lambda t, i: CASE WHEN t.char_end > p0 AND t.char_start < p0 + n AND t.char_end > t.char_start THEN i - 1 END), lambda x: x IS NOT NULL) AS h FROM q)
SELECT result_id, p0 AS char_start, CAST(coalesce(list_min(h), -1) AS INTEGER) AS token_start, CAST(coalesce(list_max(h) + 1, -1) AS INTEGER) AS token_end FROM h""",
}
