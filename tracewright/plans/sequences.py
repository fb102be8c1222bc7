"""Queries on masks, positions, padding and returns."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewright.functions import arrays
from tracewright.operators.batches import splits, with_ordinal
from tracewright.session import table

EOS = (81589, 76997)


def _ids(spark, folder):
    return table(spark, folder, "results").where("generated_token_ids is not null").select("result_id", F.col("generated_token_ids").alias("ids"))


def _joined(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def eos_mask(spark, folder):
    return _ids(spark, folder).select("result_id", _joined(arrays.eos_mask(F.col("ids"), EOS)).alias("mask"))


def position_ids(spark, folder):
    d = _ids(spark, folder).select("result_id", F.transform("ids", lambda x: (x % 5 != 0).cast("int")).alias("m"))
    return d.select("result_id", _joined(arrays.position_ids(F.col("m"))).alias("positions"))


def response_positions(spark, folder):
    return _ids(spark, folder).select("result_id", _joined(arrays.response_positions((F.col("result_id") % 7).cast("int"), F.size("ids"))).alias("positions"))


def cu_seqlens(spark, folder):
    """Cumulative lengths of the responses in batches of 256 rows: where each begins and ends in its flat batch."""
    d = table(spark, folder, "results").select("result_id", F.coalesce(F.size("tokens"), F.lit(0)).alias("n"))
    d = splits(with_ordinal(d, [F.col("result_id")]), "ordinal", 256, "batch")
    w = Window.partitionBy("batch").orderBy("result_id").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("end", F.sum("n").over(w))
    return d.select("batch", "result_id", (F.col("end") - F.col("n")).alias("start"), "end")


def prefix_offsets(spark, folder):
    """Character offsets of tokens from their texts' lengths."""
    d = table(spark, folder, "results").where("tokens is not null").select("result_id", F.transform("tokens", lambda t: F.length(t["text"])).alias("n"))
    return d.select("result_id", _joined(arrays.prefix_offsets(F.col("n"))).alias("starts"))


def _series(spark, folder):
    ok = F.filter("tokens", lambda t: (t["entropy"] >= 0) & (t["entropy"] < float("inf")))
    d = table(spark, folder, "results").where("tokens is not null").select("result_id", ok.alias("t"))
    return d.select("result_id", F.transform("t", lambda x: x["entropy"]).alias("r"), F.transform("t", lambda x: (x["token_id"] % 10) / 10.0).alias("v"), F.transform("t", lambda x: x["token_id"]).alias("ids"))


def gae_returns(spark, folder):
    d = _series(spark, folder).select("result_id", "v", arrays.gae(F.col("r"), F.col("v"), 0.98, 0.9).alias("a"))
    d = d.select("result_id", F.posexplode_outer(F.arrays_zip(F.col("a").alias("a"), F.col("v").alias("v"))).alias("pos", "x")).where("pos is not null")
    return d.select("result_id", "pos", F.round("x.a", 6).alias("advantage"), F.round(F.col("x.a") + F.col("x.v"), 6).alias("ret"))


def discounted_returns(spark, folder):
    d = _series(spark, folder).select("result_id", arrays.discounted_returns(F.col("r"), arrays.eos_mask(F.col("ids"), EOS), 0.95).alias("g"))
    d = d.select("result_id", F.posexplode_outer("g").alias("pos", "g")).where("pos is not null")
    return d.select("result_id", "pos", F.round("g", 6).alias("ret"))


def suffix_returns(spark, folder):
    """Sum of what follows, minus a baseline; lines of an order stand in for tokens (lines of one number are one)."""
    d = table(spark, folder, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("r"), F.max((F.col("l_linestatus") == "F").cast("int")).alias("m"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber").rowsBetween(0, Window.unboundedFollowing)
    return d.select("l_orderkey", "l_linenumber", F.round(F.sum(F.col("r") * F.col("m")).over(w) - 10.0 * F.col("m"), 6).alias("ret"))


def pad_and_cut(spark, folder):
    z = F.lit(0)
    d = _ids(spark, folder)
    return d.select(
        "result_id", _joined(arrays.pad_right(F.col("ids"), 150, z)).alias("right"), F.size(arrays.pad_left(F.col("ids"), 150, z)).alias("left_size"),
        _joined(arrays.fit_length(F.col("ids"), 100, z, "left")).alias("keep_tail"), _joined(arrays.fit_length(F.col("ids"), 100, z, "right")).alias("keep_head"),
        F.size(arrays.with_eos(F.col("ids"), EOS[0])).alias("with_eos"),
    )


def unpad_prompt(spark, folder):
    d = _ids(spark, folder).select("result_id", arrays.pad_left(F.col("ids"), 200, F.lit(-200)).alias("p"))
    d = d.select("result_id", "p", F.transform("p", lambda x: (x >= 0).cast("int")).alias("m"))
    return d.select("result_id", _joined(arrays.unpad(F.col("p"), F.col("m"))).alias("ids"), F.size(arrays.non_negative(F.col("p"))).alias("n"))


def image_positions(spark, folder):
    """Three-row positions of a text run, a grid of 1 x (size % 3 + 1) x 2 and a text run."""
    seg = lambda n, t, h, w: F.struct(n.alias("n"), t.alias("t"), h.alias("h"), w.alias("w"))
    z = F.lit(0)
    d = table(spark, folder, "part").select("p_partkey", F.array(seg(F.lit(2), z, z, z), seg(z, F.lit(1), F.col("p_size") % 3 + 1, F.lit(2)), seg(F.lit(1), z, z, z)).alias("s"))
    d = d.select("p_partkey", arrays.grid_positions(F.col("s")).alias("p"))
    return d.select("p_partkey", *(_joined(F.col(f"p.{a}")).alias(a) for a in "thw"))


def last_token_reward(spark, folder):
    d = table(spark, folder, "results").select("result_id", arrays.last_valid_reward(F.lit(1.5), F.coalesce(F.size("tokens"), F.lit(0))).alias("r"))
    return d.select("result_id", F.size("r").alias("n"), F.coalesce(F.try_element_at("r", F.lit(-1)), F.lit(0.0)).alias("last"), F.aggregate("r", F.lit(0.0), lambda s, x: s + x).alias("total"))


QUERIES = {f.__name__: f for f in (eos_mask, position_ids, response_positions, cu_seqlens, prefix_offsets, gae_returns, discounted_returns, suffix_returns, pad_and_cut, unpad_prompt, image_positions, last_token_reward)}

_IDS = "SELECT result_id, generated_token_ids AS ids FROM results WHERE generated_token_ids IS NOT NULL"
_J = "array_to_string({x}, ',')"
_S = "SELECT result_id, list_filter(tokens, lambda t: t.entropy IS NOT NULL AND t.entropy >= 0 AND NOT isinf(t.entropy) AND NOT isnan(t.entropy)) AS t FROM results WHERE tokens IS NOT NULL"
_L = f"l AS (SELECT result_id, unnest(range(len(t))) AS pos, unnest(t) AS x FROM ({_S})), s AS (SELECT result_id, pos, x.entropy AS r, (x.token_id % 10) / 10.0::DOUBLE AS v, x.token_id AS id FROM l)"
ORACLE = {
    "eos_mask": f"""WITH p AS (SELECT result_id, ids, list_min(list_filter(list_transform(ids, lambda x, i: CASE WHEN x IN {EOS} THEN i END), lambda i: i IS NOT NULL)) AS stop FROM ({_IDS}))
SELECT result_id, {_J.format(x="list_transform(ids, lambda x, i: CASE WHEN stop IS NULL OR i <= stop THEN 1 ELSE 0 END)")} AS mask FROM p""",
    "position_ids": f"""WITH m AS (SELECT result_id, unnest(range(len(ids))) AS pos, CAST(unnest(ids) % 5 <> 0 AS INTEGER) AS m FROM ({_IDS})),
c AS (SELECT result_id, pos, greatest(sum(m) OVER (PARTITION BY result_id ORDER BY pos) - 1, 0) AS p FROM m)
SELECT i.result_id, coalesce(p, '') AS positions FROM ({_IDS}) i LEFT JOIN (SELECT result_id, string_agg(CAST(CAST(p AS BIGINT) AS VARCHAR), ',' ORDER BY pos) AS p FROM c GROUP BY result_id) c ON i.result_id = c.result_id""",
    "response_positions": f"SELECT result_id, {_J.format(x='range(CAST(result_id % 7 + 1 AS BIGINT), CAST(result_id % 7 + 1 + len(ids) AS BIGINT))')} AS positions FROM ({_IDS})",
    "cu_seqlens": """WITH d AS (SELECT CAST((row_number() OVER (ORDER BY result_id) - 1) // 256 AS INTEGER) AS batch, result_id, coalesce(len(tokens), 0) AS n FROM results),
c AS (SELECT *, CAST(sum(n) OVER (PARTITION BY batch ORDER BY result_id) AS BIGINT) AS e FROM d)
SELECT batch, result_id, e - n AS start, e AS end FROM c""",
    "prefix_offsets": """WITH t AS (SELECT result_id, unnest(range(len(tokens))) AS pos, length(unnest(tokens).text) AS n FROM results WHERE tokens IS NOT NULL), c AS (SELECT result_id, pos, sum(n) OVER (PARTITION BY result_id ORDER BY pos) - n AS a FROM t)
SELECT r.result_id, coalesce(s, '') AS starts FROM results r LEFT JOIN (SELECT result_id, string_agg(CAST(CAST(a AS BIGINT) AS VARCHAR), ',' ORDER BY pos) AS s FROM c GROUP BY result_id) c ON r.result_id = c.result_id WHERE r.tokens IS NOT NULL""",
    "gae_returns": f"""WITH {_L}, d AS (SELECT result_id, pos, v, r + 0.98::DOUBLE * coalesce(lead(v) OVER (PARTITION BY result_id ORDER BY pos), 0) - v AS d FROM s),
g AS (SELECT a.result_id, a.pos, any_value(a.v) AS v, sum(pow(0.882::DOUBLE, b.pos - a.pos) * b.d) AS a FROM d a JOIN d b ON a.result_id = b.result_id AND b.pos >= a.pos GROUP BY a.result_id, a.pos)
SELECT result_id, CAST(pos AS INTEGER) AS pos, round(a, 6) AS advantage, round(a + v, 6) AS ret FROM g""",
    "discounted_returns": f"""WITH {_L}, m AS (SELECT *, coalesce(sum(CAST(id IN {EOS} AS INTEGER)) OVER (PARTITION BY result_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS m FROM s),
g AS (SELECT a.result_id, a.pos, sum(pow(0.95::DOUBLE, b.pos - a.pos) * b.r * CASE WHEN b.pos = a.pos OR b.m THEN 1 ELSE 0 END) AS g FROM m a JOIN m b ON a.result_id = b.result_id AND b.pos >= a.pos GROUP BY a.result_id, a.pos)
SELECT result_id, CAST(pos AS INTEGER) AS pos, round(g, 6) AS ret FROM g""",
    "suffix_returns": """WITH d AS (SELECT l_orderkey, l_linenumber, sum(l_quantity) AS r, max(CAST(l_linestatus = 'F' AS INTEGER)) AS m FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, round(sum(r * m) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - 10.0::DOUBLE * m, 6) AS ret FROM d""",
    "pad_and_cut": f"""SELECT result_id, {_J.format(x="list_resize(ids, 150, 0)")} AS right, CAST(greatest(len(ids), 150) AS INTEGER) AS left_size,
 {_J.format(x="CASE WHEN len(ids) > 100 THEN ids[-100:] ELSE list_concat(list_resize(CAST([] AS INTEGER[]), 100 - len(ids), 0), ids) END")} AS keep_tail,
 {_J.format(x="CASE WHEN len(ids) > 100 THEN ids[:100] ELSE list_concat(list_resize(CAST([] AS INTEGER[]), 100 - len(ids), 0), ids) END")} AS keep_head,
 CAST(len(ids) + CASE WHEN coalesce(ids[-1] = {EOS[0]}, false) THEN 0 ELSE 1 END AS INTEGER) AS with_eos FROM ({_IDS})""",
    "unpad_prompt": f"SELECT result_id, {_J.format(x='ids')} AS ids, CAST(greatest(len(ids), 200) AS INTEGER) AS n FROM ({_IDS})",
    "image_positions": """SELECT p_partkey, CASE h WHEN 1 THEN '0,1,2,2,4' WHEN 2 THEN '0,1,2,2,2,2,4' ELSE '0,1,2,2,2,2,2,2,5' END AS t,
 CASE h WHEN 1 THEN '0,1,2,2,4' WHEN 2 THEN '0,1,2,2,3,3,4' ELSE '0,1,2,2,3,3,4,4,5' END AS h, CASE h WHEN 1 THEN '0,1,2,3,4' WHEN 2 THEN '0,1,2,3,2,3,4' ELSE '0,1,2,3,2,3,2,3,5' END AS w
FROM (SELECT p_partkey, p_size % 3 + 1 AS h FROM part)""",
    "last_token_reward": "SELECT result_id, CAST(n AS INTEGER) AS n, CASE WHEN n > 0 THEN 1.5::DOUBLE ELSE 0::DOUBLE END AS last, CASE WHEN n > 0 THEN 1.5::DOUBLE ELSE 0::DOUBLE END AS total FROM (SELECT result_id, coalesce(len(tokens), 0) AS n FROM results)",
}
