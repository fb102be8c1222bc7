"""Queries on batches of rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.operators import batches
from tracewright.session import table


VOCABULARY = 90_000


def _c(spark, folder):
    d = table(spark, folder, "customer")
    return d.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")


def _numbered(spark, folder):
    return batches.with_ordinal(_c(spark, folder), [F.col("c_custkey")])


def row_ordinals(spark, folder):
    d = batches.with_ordinal(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey")])
    return d.select("o_orderkey", F.col("ordinal").cast("bigint").alias("ordinal"))


def shuffle_by_digest(spark, folder):
    d = batches.with_ordinal(_c(spark, folder).withColumn("d", batches.digest(F.lit("u1"), F.col("c_mktsegment"), F.col("c_custkey"), F.col("c_name"))), [F.col("d"), F.col("c_custkey")])
    return d.select("c_custkey", F.col("d").alias("digest"), F.col("ordinal").cast("bigint").alias("ordinal"))


def restore_order(spark, folder):
    """Scores given in shuffled order, brought back to the rows they belong to."""
    d = shuffle_by_digest(spark, folder)
    scores = d.select(F.col("ordinal").alias("answer_index"), (F.col("ordinal") % 7).alias("score"))
    return d.join(scores, d["ordinal"] == scores["answer_index"]).select("c_custkey", "score")


def ordered_distinct(spark, folder):
    d = table(spark, folder, "documents").select("text", "doc_id", "source").where("text is not null")
    return batches.ordered_distinct(d, ["text"], "doc_id").select("doc_id", "source")


def repeat_interleave(spark, folder):
    d = batches.repeat(_numbered(spark, folder), 3, "ordinal")
    return d.select("c_custkey", "copy", F.col("position").cast("bigint").alias("position"))


def repeat_tile(spark, folder):
    d = batches.repeat(_numbered(spark, folder), 3, "ordinal", F.lit(_c(spark, folder).count()))
    return d.select("c_custkey", "copy", F.col("position").cast("bigint").alias("position"))


def rollout_rows(spark, folder):
    d = table(spark, folder, "samples").select("sample_id", F.nullif(F.col("answer"), F.lit("")).alias("answer")).dropDuplicates(["sample_id"])
    return batches.rollout(d.select("sample_id", F.when(F.length("sample_id") % 2 == 0, F.col("sample_id")).alias("target")), 4, "target").select("sample_id", "copy", "is_onpolicy")


def pad_to_divisor(spark, folder):
    n = _c(spark, folder).count()
    d = batches.pad_to_divisor(_numbered(spark, folder), "ordinal", n, 64)
    return d.select("c_custkey", F.col("ordinal").cast("bigint").alias("ordinal"), "is_pad")


def chunk_rows(spark, folder):
    """All rows, padded to a number that 10 chunks share equally."""
    n = _c(spark, folder).count()
    d = batches.pad_to_divisor(_numbered(spark, folder), "ordinal", n, 10)
    d = batches.splits(batches.chunks(d, "ordinal", n + -n % 10, 10), "ordinal", 64)
    return d.select("c_custkey", "is_pad", "chunk", "split")


def sampler_batches(spark, folder):
    n = _c(spark, folder).count()
    d = batches.with_ordinal(_c(spark, folder), [batches.digest(F.lit("epoch-1"), F.col("c_custkey")), F.col("c_custkey")])
    return batches.full_batches(d, "ordinal", n, 128).groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("keys"))


def batch_union(spark, folder):
    a = _c(spark, folder).select("c_custkey", "c_name", "c_acctbal")
    b = _c(spark, folder).select("c_custkey", "c_name", "c_mktsegment")
    return batches.union_columns(a, b, "c_custkey", ["c_name"])


def train_val_split(spark, folder):
    d = table(spark, folder, "documents").select("doc_id")
    return batches.train_val(d, F.col("doc_id"), 100, d.count())


def first_groups(spark, folder):
    d = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_shipdate").cast("date").alias("day"))
    d = d.withColumn("seen", F.concat_ws("-", F.col("day").cast("string"), F.lpad(F.col("l_orderkey").cast("string"), 12, "0")))
    return batches.first_groups(d, "l_orderkey", "seen", 25).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def fold_rows(spark, folder):
    d = batches.fold(_numbered(spark, folder), "ordinal", 16, "c_custkey")
    return d.select("row", F.array_join(F.transform("values", lambda x: x.cast("string")), ",").alias("keys"))


def quarantine_rows(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", "text", "lang", "n_chars")
    _, bad = batches.quarantine(d, {"text": F.length(F.trim("text")) > 0, "lang": F.lower("lang").isin("en", "es", "de", "fr", "zh"), "length": F.col("n_chars") <= 20_000})
    return bad.select("doc_id", "reason")


def validate_batch(spark, folder):
    r = table(spark, folder, "results")
    v = F.transform("tokens", lambda t: t["entropy"])
    d = r.select("result_id", F.transform("tokens", lambda t: t["token_id"]).alias("ids"), F.transform("tokens", lambda t: (t["char_end"] > t["char_start"]).cast("int")).alias("mask"), v.alias("values"))
    return batches.violations(d, "result_id", ids="ids", mask="mask", values="values", vocabulary=VOCABULARY)


def select_pop_rename(spark, folder):
    popped, _ = batches.pop_columns(_c(spark, folder), ["c_custkey", "c_name"])
    return batches.rename_columns(popped, ["c_name"], ["name"])


QUERIES = {f.__name__: f for f in (row_ordinals, shuffle_by_digest, restore_order, ordered_distinct, repeat_interleave, repeat_tile, rollout_rows, pad_to_divisor, chunk_rows, sampler_batches, batch_union, train_val_split, first_groups, fold_rows, quarantine_rows, validate_batch, select_pop_rename)}

_D = "sha256('u1' || chr(31) || c_mktsegment || chr(31) || c_custkey || chr(31) || c_name)"
_O = "o AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS o, count(*) OVER () AS n FROM customer)"
ORACLE = {
    "row_ordinals": "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS ordinal FROM orders",
    "shuffle_by_digest": f"SELECT c_custkey, {_D} AS digest, row_number() OVER (ORDER BY {_D}, c_custkey) - 1 AS ordinal FROM customer",
    "restore_order": f"SELECT c_custkey, (row_number() OVER (ORDER BY {_D}, c_custkey) - 1) % 7 AS score FROM customer",
    "ordered_distinct": "SELECT min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM (SELECT doc_id, text, source FROM documents WHERE source IS NOT NULL AND text IS NOT NULL) d WHERE NOT EXISTS (SELECT 1 FROM documents e WHERE e.text = d.text AND e.doc_id < d.doc_id AND e.source IS NULL) GROUP BY text UNION ALL SELECT d.doc_id, NULL FROM documents d WHERE d.source IS NULL AND d.text IS NOT NULL AND NOT EXISTS (SELECT 1 FROM documents e WHERE e.text = d.text AND e.doc_id < d.doc_id)",
    "repeat_interleave": f"WITH {_O} SELECT c_custkey, CAST(k AS INTEGER) AS copy, o * 3 + k AS position FROM o, range(3) t(k)",
    "repeat_tile": f"WITH {_O} SELECT c_custkey, CAST(k AS INTEGER) AS copy, k * n + o AS position FROM o, range(3) t(k)",
    "rollout_rows": "WITH s AS (SELECT DISTINCT sample_id FROM samples) SELECT sample_id, CAST(k AS INTEGER) AS copy, k < 4 AS is_onpolicy FROM s, range(5) t(k) WHERE k < 4 OR length(sample_id) % 2 = 0",
    "pad_to_divisor": f"WITH {_O} SELECT c_custkey, o AS ordinal, false AS is_pad FROM o UNION ALL SELECT c_custkey, n + o, true FROM o WHERE o < (64 - n % 64) % 64",
    "chunk_rows": f"WITH {_O}, p AS (SELECT c_custkey, o, n, false AS is_pad FROM o UNION ALL SELECT c_custkey, n + o, n, true FROM o WHERE o < (10 - n % 10) % 10) SELECT c_custkey, is_pad, CAST(o // ((n + (10 - n % 10) % 10) // 10) AS INTEGER) AS chunk, CAST(o // 64 AS INTEGER) AS split FROM p",
    "sampler_batches": "WITH o AS (SELECT c_custkey, row_number() OVER (ORDER BY sha256('epoch-1' || chr(31) || c_custkey), c_custkey) - 1 AS o, count(*) OVER () AS n FROM customer) SELECT CAST(o // 128 AS INTEGER) AS batch, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys FROM o WHERE o < n // 128 * 128 GROUP BY 1",
    "batch_union": "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer",
    "train_val_split": "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY sha256(CAST(doc_id AS VARCHAR))) <= least(100, count(*) OVER () - 1) THEN 'val' ELSE 'train' END AS split FROM documents",
    "first_groups": "WITH f AS (SELECT l_orderkey, min(CAST(l_shipdate AS DATE)) AS d FROM lineitem GROUP BY 1 ORDER BY 2, 1 LIMIT 25) SELECT l.l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem l JOIN f ON l.l_orderkey = f.l_orderkey",
    "fold_rows": f"WITH {_O} SELECT o // 16 AS row, string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY o) AS keys FROM o GROUP BY 1",
    "quarantine_rows": "SELECT doc_id, reason FROM (SELECT doc_id, CASE WHEN NOT coalesce(length(trim(text)) > 0, false) THEN 'text' WHEN NOT coalesce(lower(lang) IN ('en', 'es', 'de', 'fr', 'zh'), false) THEN 'lang' WHEN NOT coalesce(n_chars <= 20000, false) THEN 'length' END AS reason FROM documents) WHERE reason IS NOT NULL",
    "validate_batch": f"""WITH d AS (SELECT result_id, tokens AS t FROM results)
SELECT result_id, 'missing' AS rule FROM d WHERE t IS NULL
UNION ALL SELECT result_id, 'empty' FROM d WHERE t IS NOT NULL AND coalesce(list_sum(list_transform(t, lambda x: CAST(x.char_end > x.char_start AS INTEGER))), 0) <= 0
UNION ALL SELECT result_id, 'finite' FROM d WHERE len(list_filter(t, lambda x: x.entropy IS NULL OR isnan(x.entropy) OR isinf(x.entropy))) > 0
UNION ALL SELECT result_id, 'range' FROM d WHERE len(list_filter(t, lambda x: x.token_id < 0 OR x.token_id >= {VOCABULARY})) > 0""",
    "select_pop_rename": "SELECT c_custkey, c_name AS name FROM customer",
}
