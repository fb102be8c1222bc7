"""Queries on prepared records, prompt items, score paths and batches as wholes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import arrays
from tracewright.functions import text as tx
from tracewright.operators import advantages, batches, items
from tracewright.plans import shapes
from tracewright.plans import texts as text_plans
from tracewright.registry import token_rewards
from tracewright.session import table, work_folder
from tracewright.sources import files

_INTRO = ["Work through the task.", ""]
_TOKEN = r"<\|[a-z_]+\|>|<image>|\S+"
_PAD_ID, _EOS, _LONGEST, _SHORT = 7, 2, 46, 8


def _encode(c):
    """Stands in for a tokenizer: words and marks by their first character and length."""
    one = lambda x: F.when(x == items.PAD, F.lit(_PAD_ID)).when(x == items.MARK, F.lit(items.PLACEHOLDER)).otherwise(F.ascii(x) * 100 + F.length(x))
    return F.transform(F.regexp_extract_all(c, F.lit(_TOKEN), F.lit(0)), one)


def _joined(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def corpus_convert(spark, folder):
    """All twelve fields of a prepared record; the long ones by md5."""
    d = table(spark, folder, "results").where("error is null and response is not null")
    names = {"question": "question", "reference_answer": "gold_answer", "final_answer": "gold_answer", "response": "response", "original_document": "prompt", "discipline": "source", "difficulty": F.when(F.col("result_id") % 2 == 0, F.lit(" hard ")), "type": F.lit("probe")}
    r = items.records(d, ["result_id"], names, _INTRO, {"question": 120, "original_document": 200})
    return r.select("result_id", *((F.md5(f) if f in ("solution", "response", "original_document") else F.col(f)).alias(f) for f in items.RECORD))


def prompt_forms(spark, folder):
    d = table(spark, folder, "samples").select("sample_id", "question", F.explode(F.array(*(F.struct(F.lit(n).alias("form"), tx.prompt_form(F.col("question"), n).alias("prompt")) for n in tx.FORMS))).alias("f"))
    return d.select("sample_id", "f.form", F.md5("f.prompt").alias("prompt"))


def boxed_math_score(spark, folder):
    return table(spark, folder, "results").where("response is not null").select("result_id", tx.boxed_math_score(F.col("response"), F.col("gold_answer")).alias("score"))


def rubric_render(spark, folder):
    return table(spark, folder, "rubrics").select("sample_id", tx.pretty_rubric(F.col("rubrics")).alias("rubric"))


def _pictures(spark, folder):
    d = table(spark, folder, "part")
    extra = F.when(F.col("p_partkey") % 9 == 0, F.lit(" " + items.PAD)).otherwise(F.lit(""))
    prompt = F.concat(F.lit("see <image> and "), "p_name", extra, F.lit(" <image>"))
    return d.select("p_partkey", "p_type", prompt.alias("prompt"), F.when(F.col("p_partkey") % 3 == 0, F.array("p_name", "p_brand")).alias("images"), F.when(F.col("p_partkey") % 3 == 1, F.col("p_brand")).alias("image"), F.array(F.lit(2), F.col("p_size") % 3).alias("pads"))


def chat_items(spark, folder):
    flat = lambda m: F.array_join(F.transform(m, lambda x: F.concat(x["role"], F.lit(": "), x["content"])), "\n")
    d = items.chat_items(_pictures(spark, folder), "prompt", _encode, _LONGEST, pad=0, image_pad=_PAD_ID, template=flat, truncation="left", images="images", image="image", pads="pads", target="p_type", eos=_EOS)
    return d.select("p_partkey", "error", *(_joined(F.col(c)).alias(c) for c in ("input_ids", "mask", "position_ids", "raw_prompt_ids", "target_ids")))


def placeholder_items(spark, folder):
    d = items.placeholder_items(_pictures(spark, folder).withColumn("answer", F.col("p_type")), "prompt", _encode, _SHORT, image_pad=_PAD_ID, answer="answer", target="p_type", eos=_EOS, images="images", image="image")
    return d.select("p_partkey", "error", *(_joined(F.col(c)).alias(c) for c in ("input_ids", "raw_prompt_ids", "target_ids")), "answer", "raw_prompt", F.array_join("image_paths", ",").alias("image_paths"), "needs_dummy")


def response_info(spark, folder):
    r = table(spark, folder, "results")
    d = r.select(
        "result_id", F.transform("tokens", lambda t: t["token_id"]).alias("ids"), F.transform("tokens", lambda t: (t["token_index"] < 100).cast("int")).alias("mask"),
        F.when(F.col("result_id") % 4 != 0, F.transform("tokens", lambda t: -(t["token_id"] % 7) / 7.0)).alias("logp"), F.when(F.col("result_id") % 3 != 0, F.col("sample_id")).alias("uid"),
        F.when(F.col("result_id") % 5 != 0, F.col("result_id") % 2 == 0).alias("flag"), "prompt", "gold_answer", F.array(F.lit("a.png"), F.lit(""), F.lit(None), F.col("run_id")).alias("paths"),
    )
    i = items.response_info(d, "result_id", "ids", "mask", _joined, log_probs="logp", uid="uid", on_policy="flag", prompt="prompt", image_paths="paths", answer="gold_answer")
    total = F.aggregate("uncertainties", F.lit(0.0), lambda s, x: s + x)
    return i.select("batch_index", "uid", "is_onpolicy", F.length("raw_prompt").alias("prompt_length"), F.array_join("image_paths", ",").alias("image_paths"), "ground_truth", F.md5("response_text").alias("response_text"), F.size("response_ids").alias("n_ids"), F.round(total, 6).alias("uncertainty"), "response_length")


def score_paths(spark, folder):
    """Scores at the last tokens by the rule alone, in groups, and in groups with off-policy rows scored."""
    d = table(spark, folder, "results").where("response is not null").select("result_id", "response", "gold_answer", F.size("tokens").alias("n"))
    g = d.withColumns({"uid": F.col("result_id") % 9, "is_onpolicy": F.col("result_id") % 3 != 0})
    judge = lambda x: x.withColumn("judged", F.when(F.col("result_id") % 4 != 0, F.col("result_id") % 5 / 5.0))
    out = None
    for case, one in (("rule", token_rewards(d, "boxed", "response", "gold_answer", "n")), ("group", token_rewards(g, "boxed", "response", "gold_answer", "n", judge)), ("offpolicy", token_rewards(g, "boxed", "response", "gold_answer", "n", judge, score_offpolicy=True))):
        one = one.select("result_id", F.lit(case).alias("case"), "path", F.round("score", 6).alias("score"), F.size("rewards").alias("n"), F.round(F.coalesce(F.try_element_at("rewards", F.lit(-1)), F.lit(0.0)), 6).alias("last"))
        out = one if out is None else out.unionByName(one)
    return out


def criterion_override(spark, folder):
    r = table(spark, folder, "results").where("tokens is not null and size(tokens) > 0")
    given = r.select("result_id", F.transform("tokens", lambda t: (t["token_id"] % 5 - 2).cast("double")).alias(advantages.CRITERION))
    d = advantages.advantages(shapes._responses(spark, folder).join(given, "result_id"), "grpo")
    return d.select("result_id", F.get("advantages", F.lit(0)).alias("first"), F.aggregate("advantages", F.lit(0.0), lambda s, x: s + x).alias("total"))


def config_values(spark, folder):
    """The first given value of a cascade, and numbers where there are any."""
    d = table(spark, folder, "documents")
    return d.select("doc_id", tx.filled(F.col("discipline"), F.col("source"), F.lit("general")).alias("value"), tx.number_or_null(F.when(F.col("doc_id") % 3 == 0, F.lit(" ")).when(F.col("doc_id") % 3 == 1, F.col("n_chars").cast("string")).otherwise(F.col("lang"))).alias("number"))


def batch_concat(spark, folder):
    c = table(spark, folder, "customer").select("c_custkey", "c_acctbal")
    d, _ = batches.concat([(c.where("c_acctbal >= 0"), {"step": 1}), (c.where("not coalesce(c_acctbal >= 0, false)"), {"step": 2})])
    return d


def batch_bytes(spark, folder):
    return batches.byte_size(table(spark, folder, "documents").select("doc_id", "text", "lang", "n_chars", "crawled_at"))


def batch_round_trip(spark, folder):
    path = work_folder(spark, "batch")
    files.save_batch(table(spark, folder, "customer").select("c_custkey", "c_name"), {"step": 3, "tags": ["a"]}, path)
    d, info = files.load_batch(spark, path)
    return d.withColumn("step", F.lit(info["step"]))


def valid_tokens(spark, folder):
    """Places of the valid tokens of each response, and the greatest length of its batch of 256 rows."""
    d = table(spark, folder, "results").where("tokens is not null").select("result_id", F.transform("tokens", lambda t: (t["char_end"] > t["char_start"]).cast("int")).alias("m"))
    d = batches.splits(batches.with_ordinal(d, [F.col("result_id")]), "ordinal", 256, "batch").withColumn("i", arrays.valid_indices(F.col("m")))
    longest = d.groupBy("batch").agg(F.max(F.size("i")).alias("longest"))
    return d.join(longest, "batch").select("result_id", "batch", _joined(F.col("i")).alias("indices"), "longest")


QUERIES = {f.__name__: f for f in (corpus_convert, prompt_forms, boxed_math_score, rubric_render, chat_items, placeholder_items, response_info, score_paths, criterion_override, config_values, batch_concat, batch_bytes, batch_round_trip, valid_tokens)}

_strip, _clean, _lit = text_plans._strip, text_plans._clean, text_plans._lit


def _cut(c: str, n: int) -> str:
    return f"CASE WHEN length({_clean(c)}) > {n} THEN regexp_replace(left({_clean(c)}, {n}), '[\\s\\p{{Z}}]+$', '') || chr(10) || '...[truncated]' ELSE {_clean(c)} END"


def _part(label: str, c: str) -> str:
    return f"CASE WHEN {_clean(c)} <> '' THEN '[{label}]' || chr(10) || {_clean(c)} || chr(10) END"


def _ids(c: str) -> str:
    return f"list_transform(regexp_extract_all({c}, {_lit(_TOKEN)}), lambda x: CASE WHEN x = {_lit(items.PAD)} THEN {_PAD_ID} WHEN x = '<image>' THEN -200 ELSE unicode(x) * 100 + length(x) END)"


def _form(f: str) -> str:
    before, _, after = tx.FORMS[f].partition("{}")
    return f"SELECT sample_id, '{f}' AS form, md5({_lit(before)} || {_clean('question')} || {_lit(after)}) AS prompt FROM samples"


_PAD3 = items.START + items.PAD + items.END
_PIC = f"""d AS (SELECT p_partkey, p_type, p_name, p_brand, 'see <image> and ' || p_name || CASE WHEN p_partkey % 9 = 0 THEN ' {items.PAD}' ELSE '' END || ' <image>' AS c, p_size % 3 AS k, CASE p_partkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS n FROM part)"""
_TARGET = "CASE WHEN len(g) > 0 AND g[-1] = 2 THEN g ELSE list_append(g, 2) END"
_BOXED = f"(SELECT result_id, score FROM ({text_plans.ORACLE['boxed_score']}))"
ORACLE = {
    "corpus_convert": f"""WITH r AS (SELECT result_id, question, gold_answer, response, prompt, source, CASE WHEN result_id % 2 = 0 THEN 'hard' ELSE '' END AS difficulty FROM results WHERE error IS NULL AND response IS NOT NULL),
s AS ({text_plans.ORACLE["solution_normalize"]}), x AS (SELECT result_id, {text_plans._EXTRACT} AS e FROM (SELECT result_id, {_clean("response")} AS response FROM r))
SELECT r.result_id, {_strip(f"concat_ws(chr(10), {', '.join(map(_lit, _INTRO))}, {_part('Discipline', 'r.source')}, {_part('Difficulty', 'r.difficulty')}, {_part('Question Type', _lit('probe'))}, {_part('Source Document', _cut('r.prompt', 200))}, '[Question]' || chr(10) || {_clean(_cut('r.question', 120))})")} AS problem,
 md5(s.solution) AS solution, coalesce(nullif({_clean("r.gold_answer")}, ''), x.e) AS answer, {_clean("r.question")} AS question, {_clean("r.gold_answer")} AS reference_answer, {_clean("r.gold_answer")} AS final_answer,
 md5({_clean("r.response")}) AS response, md5({_clean("r.prompt")}) AS original_document, '' AS design_logic, {_clean("r.source")} AS discipline, r.difficulty, 'probe' AS type
FROM r JOIN s ON r.result_id = s.result_id JOIN x ON r.result_id = x.result_id""",
    "prompt_forms": " UNION ALL ".join(map(_form, tx.FORMS)),
    "boxed_math_score": f"SELECT result_id, CAST(CASE WHEN b IS NULL THEN 0.0 WHEN {text_plans._same(text_plans._norm('b'), text_plans._norm('gold_answer'))} THEN 1.0 ELSE 0.1 END AS DOUBLE) AS score FROM (SELECT result_id, gold_answer, {text_plans._BOX} AS b FROM {text_plans._R})",
    "rubric_render": """SELECT sample_id, CASE WHEN len(rubrics) > 0 THEN '[' || chr(10) || array_to_string(list_transform(rubrics, lambda r: '  {' || chr(10) || '    "criterion_id": ' || coalesce(CAST(to_json(r.criterion_id) AS VARCHAR), 'null') || ',' || chr(10) || '    "category": ' || coalesce(CAST(to_json(r.category) AS VARCHAR), 'null') || ',' || chr(10)
 || '    "criterion": ' || coalesce(CAST(to_json(r.criterion) AS VARCHAR), 'null') || ',' || chr(10) || '    "points": ' || coalesce(CAST(r.points AS VARCHAR), 'null') || chr(10) || '  }'), ',' || chr(10)) || chr(10) || ']' WHEN rubrics IS NOT NULL THEN '[]' END AS rubric FROM rubrics""",
    "chat_items": f"""WITH {_PIC}, t AS (SELECT *, {_lit("system: " + items.SYSTEM)} || chr(10) || 'user: ' || c || {_lit(items.SUFFIX)} AS p FROM d),
f AS (SELECT *, string_split(p, '<image>') AS s FROM t),
g AS (SELECT *, CASE WHEN n = 0 THEN p ELSE s[1] || '{items.START}{items.PAD}{items.PAD}{items.END}' || s[2] || '{items.START}' || repeat('{items.PAD}', k) || '{items.END}' || s[3] END AS full_, CASE WHEN n = 0 THEN p ELSE replace(p, '<image>', '{_PAD3}') END AS raw FROM f),
h AS (SELECT *, {_ids("full_")} AS ids, {_ids("raw")} AS raw_ids, {_ids("p_type")} AS g FROM g),
e AS (SELECT *, CASE WHEN n = 1 THEN 'images' WHEN n = 2 AND len(ids) > {_LONGEST} THEN 'length' WHEN n = 2 AND len(list_filter(ids, lambda i: i = {_PAD_ID})) <> 2 + k THEN 'pads' END AS error, greatest({_LONGEST} - len(ids), 0) AS gap FROM h)
SELECT p_partkey, error, CASE WHEN error IS NULL THEN array_to_string(list_concat(list_resize(CAST([] AS BIGINT[]), gap, 0), ids[-{_LONGEST}:]), ',') END AS input_ids,
 CASE WHEN error IS NULL THEN array_to_string(list_concat(list_resize(CAST([] AS INTEGER[]), gap, 0), list_resize(CAST([] AS INTEGER[]), {_LONGEST} - gap, 1)), ',') END AS mask,
 CASE WHEN error IS NULL THEN array_to_string(list_concat(list_resize(CAST([] AS BIGINT[]), gap, 0), range({_LONGEST} - gap)), ',') END AS position_ids,
 CASE WHEN error IS NULL THEN array_to_string(raw_ids, ',') END AS raw_prompt_ids, CASE WHEN error IS NULL THEN array_to_string({_TARGET}, ',') END AS target_ids FROM e""",
    "placeholder_items": f"""WITH {_PIC}, h AS (SELECT *, {_ids("c")} AS ids, {_ids("p_type")} AS g FROM d), e AS (SELECT *, CASE WHEN len(ids) > {_SHORT} THEN 'length' END AS error FROM h)
SELECT p_partkey, error, CASE WHEN error IS NULL THEN array_to_string(ids, ',') END AS input_ids, CASE WHEN error IS NULL THEN array_to_string(list_transform(ids, lambda i: CASE WHEN i = -200 THEN {_PAD_ID} ELSE i END), ',') END AS raw_prompt_ids,
 CASE WHEN error IS NULL THEN array_to_string({_TARGET}, ',') END AS target_ids, p_type AS answer, c AS raw_prompt, CASE n WHEN 2 THEN p_name || ',' || p_brand WHEN 1 THEN p_brand ELSE '' END AS image_paths, n = 0 AS needs_dummy FROM e""",
    "response_info": """WITH d AS (SELECT *, coalesce(CAST(list_sum(list_transform(tokens, lambda t: CAST(t.token_index < 100 AS INTEGER))) AS INTEGER), 0) AS n FROM results),
i AS (SELECT *, list_transform(tokens[:n], lambda t: t.token_id) AS ids FROM d)
SELECT result_id AS batch_index, CASE WHEN result_id % 3 <> 0 THEN sample_id ELSE 'sample-' || result_id END AS uid, CASE WHEN result_id % 5 <> 0 THEN result_id % 2 = 0 ELSE true END AS is_onpolicy, CAST(length(coalesce(prompt, '')) AS INTEGER) AS prompt_length,
 'a.png,' || run_id AS image_paths, coalesce(gold_answer, '') AS ground_truth, md5(coalesce(array_to_string(ids, ','), '')) AS response_text, CAST(len(ids) AS INTEGER) AS n_ids,
 round(CASE WHEN result_id % 4 <> 0 THEN coalesce(list_sum(list_transform(ids, lambda x: (x % 7) / 7.0::DOUBLE)), 0) ELSE 0 END, 6) AS uncertainty, n AS response_length FROM i""",
    "score_paths": f"""WITH d AS (SELECT r.result_id, b.score AS s, CAST(coalesce(len(tokens), 0) AS INTEGER) AS n FROM results r JOIN {_BOXED} b ON r.result_id = b.result_id WHERE response IS NOT NULL),
g AS (SELECT *, CASE WHEN result_id % 4 <> 0 THEN CAST(result_id % 5 AS DOUBLE) / 5 ELSE s END AS j, result_id % 3 <> 0 AS o FROM d),
u AS (SELECT result_id, 'rule' AS "case", 'rule' AS path, s AS score, n FROM d UNION ALL SELECT result_id, 'group', 'group', CASE WHEN o THEN j ELSE 0 END, n FROM g UNION ALL SELECT result_id, 'offpolicy', 'group', CASE WHEN o THEN j ELSE s END, n FROM g)
SELECT result_id, "case", path, round(score, 6) AS score, n, CASE WHEN n > 0 THEN round(score, 6) ELSE 0 END AS last FROM u""",
    "criterion_override": "SELECT result_id, CAST(CASE WHEN tokens[1].token_index < 100 THEN tokens[1].token_id % 5 - 2 ELSE 0 END AS DOUBLE) AS first, CAST(list_sum(list_transform(tokens, lambda t: CASE WHEN t.token_index < 100 THEN t.token_id % 5 - 2 ELSE 0 END)) AS DOUBLE) AS total FROM results WHERE len(tokens) > 0",
    "config_values": f"SELECT doc_id, coalesce(nullif({_clean('discipline')}, ''), nullif({_clean('source')}, ''), 'general') AS value, CASE WHEN doc_id % 3 = 1 THEN CAST(n_chars AS DOUBLE) END AS number FROM documents",
    "batch_concat": "SELECT c_custkey, c_acctbal, CASE WHEN c_acctbal >= 0 THEN 0 ELSE 1 END AS part FROM customer",
    "batch_bytes": """SELECT 'doc_id' AS "column", 8 * count(doc_id) AS bytes FROM documents UNION ALL SELECT 'text', CAST(coalesce(sum(strlen(text)), 0) AS BIGINT) FROM documents UNION ALL SELECT 'lang', CAST(coalesce(sum(strlen(lang)), 0) AS BIGINT) FROM documents
UNION ALL SELECT 'n_chars', 8 * count(n_chars) FROM documents UNION ALL SELECT 'crawled_at', 8 * count(crawled_at) FROM documents""",
    "batch_round_trip": "SELECT c_custkey, c_name, 3 AS step FROM customer",
    "valid_tokens": """WITH d AS (SELECT result_id, CAST((row_number() OVER (ORDER BY result_id) - 1) // 256 AS INTEGER) AS batch, list_filter(list_transform(tokens, lambda t, i: CASE WHEN t.char_end > t.char_start THEN i - 1 END), lambda x: x IS NOT NULL) AS i FROM results WHERE tokens IS NOT NULL)
SELECT result_id, batch, array_to_string(i, ',') AS indices, CAST(max(len(i)) OVER (PARTITION BY batch) AS INTEGER) AS longest FROM d""",
}
