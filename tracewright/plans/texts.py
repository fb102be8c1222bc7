"""Queries on tags, answers, scores and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import text as tx
from tracewright.session import table


def _r(spark, folder):
    return table(spark, folder, "results").where("response is not null")


def format_gate(spark, folder):
    t = F.col("response")
    return _r(spark, folder).select("result_id", tx.is_strict(t).alias("strict"), tx.is_strict(t, False, False).alias("strict_case"))


def tag_contents(spark, folder):
    d = _r(spark, folder).select("result_id", F.posexplode(tx.tag_contents(F.col("response"), "answer")).alias("pos", "content"))
    return d


def label_extract(spark, folder):
    return _r(spark, folder).select("result_id", tx.final_label(F.col("response")).alias("label"))


def yes_no_score(spark, folder):
    return _r(spark, folder).select("result_id", F.round(tx.yes_no_score(F.col("response"), F.col("gold_answer")), 6).alias("score"))


def boxed_score(spark, folder):
    return _r(spark, folder).select("result_id", F.coalesce(tx.boxed_score(F.col("response"), F.col("gold_answer")), F.lit(0.1)).alias("score"))


def answer_normalize(spark, folder):
    return _r(spark, folder).select("result_id", tx.normalize_answer(tx.last_answer(F.col("response"))).alias("answer"), tx.normalize_answer(F.col("gold_answer")).alias("gold"))


def combined_score(spark, folder):
    d = _r(spark, folder).select("result_id", tx.combined_score(F.col("response"), F.col("gold_answer"), F.size("tokens"), 320, 64, 0.5).alias("s"))
    return d.select("result_id", F.round("s.overall", 6).alias("overall"), "s.accuracy", F.round("s.overlong", 6).alias("overlong"), "s.accuracy_normalized")


def math_score(spark, folder):
    return _r(spark, folder).select("result_id", tx.math_score(F.col("response"), F.col("gold_answer")).alias("s")).select("result_id", F.round("s.overall", 6).alias("overall"), "s.format", "s.accuracy")


def think_answer_score(spark, folder):
    return _r(spark, folder).select("result_id", tx.think_answer_score(F.col("response"), F.col("gold_answer")).alias("s")).select("result_id", F.round("s.overall", 6).alias("overall"), "s.format", "s.accuracy")


def answer_extract(spark, folder):
    return _r(spark, folder).select("result_id", tx.extract_answer(F.col("response")).alias("answer"))


def solution_normalize(spark, folder):
    return _r(spark, folder).select("result_id", tx.normalize_solution(F.col("response"), F.col("gold_answer")).alias("solution"))


_INTRO = ["Solve the task below.", "Return one response.", ""]


def prompt_sections(spark, folder):
    d = table(spark, folder, "samples")
    p = tx.sections(_INTRO, [("Discipline", F.col("discipline")), ("Source", F.col("source"))], ("Question", tx.truncate(F.col("question"), 120)))
    return d.select("sample_id", p.alias("prompt"))


def template_render(spark, folder):
    d = table(spark, folder, "samples")
    return d.select("sample_id", tx.render("{question}\n\nSource: {source} ({sample_id})", {k: F.col(k) for k in ("question", "source", "sample_id")}).alias("prompt"))


def answer_block(spark, folder):
    return table(spark, folder, "samples").where("choices is not null").select("sample_id", tx.answer_block("Choice", F.col("choices")).alias("block"))


def chat_messages(spark, folder):
    d = table(spark, folder, "samples").select("sample_id", tx.chat(("system", F.lit("Think first.")), ("user", F.col("question"))).alias("m"))
    return d.select("sample_id", F.posexplode("m").alias("pos", "t")).select("sample_id", "pos", "t.role", "t.content")


def metric_keys(spark, folder):
    return table(spark, folder, "rubrics").select("sample_id", F.posexplode("rubrics").alias("pos", "r")).select("sample_id", "pos", tx.metric_key(F.concat_ws("/", "sample_id", "r.criterion")).alias("key"))


def points_cap(spark, folder):
    d = table(spark, folder, "rubrics").select("sample_id", F.posexplode("rubrics").alias("pos", "r"))
    return d.select("sample_id", "pos", tx.cap_points(F.coalesce("r.category", F.lit("Task")), F.col("r.criterion"), F.col("r.points"), 2, 1).alias("points"))


def span_intervention(spark, folder):
    d = _r(spark, folder).select("result_id", "response", F.posexplode("candidate_blocks").alias("pos", "b"))
    cut = {m: tx.intervene(F.col("response"), F.col("b.char_start"), F.col("b.char_end"), m) for m in ("remove", "neutral", "mask")}
    return d.select("result_id", "pos", *(F.md5(c).alias(n) for n, c in cut.items()))


def image_resize(spark, folder):
    d = table(spark, folder, "part").select("p_partkey", tx.image_size(F.col("p_size") * 40, (F.col("p_retailprice") / 10).cast("int"), 50_000, 100_000).alias("s"))
    return d.select("p_partkey", "s.width", "s.height")


def image_expand(spark, folder):
    d = table(spark, folder, "part").select("p_partkey", F.concat(F.lit("see <image> and "), "p_name", F.lit(" <image>")).alias("t"), F.array(F.lit(2), F.col("p_size") % 3).alias("n"))
    return d.select("p_partkey", tx.expand_images(F.col("t"), F.col("n")).alias("prompt"))


def truncate_marker(spark, folder):
    d = table(spark, folder, "documents")
    return d.select("doc_id", F.md5(tx.truncate(F.col("text"), 500)).alias("cut"))


def corpus_filter(spark, folder):
    d = table(spark, folder, "documents")
    keep = tx.is_one_of(F.col("source"), ["Web_Crawl", "textbook"]) & tx.is_one_of(F.col("difficulty"), ["hard", "medium"]) & (tx.clean(F.col("text")) != "")
    return d.where(keep).select("doc_id", tx.clean(F.col("discipline")).alias("discipline"), F.length(tx.clean(F.col("text"))).alias("n"))


QUERIES = {f.__name__: f for f in (format_gate, tag_contents, label_extract, yes_no_score, boxed_score, answer_normalize, combined_score, math_score, think_answer_score, answer_extract, solution_normalize, prompt_sections, template_render, answer_block, chat_messages, metric_keys, points_cap, span_intervention, image_resize, image_expand, truncate_marker, corpus_filter)}


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[\\s\\p{{Z}}\\x{{85}}]+|[\\s\\p{{Z}}\\x{{85}}]+$', '', 'g')"


def _clean(x: str) -> str:
    return f"coalesce({_strip(x)}, '')"


def _lit(x: str) -> str:
    return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _norm(x: str) -> str:
    t = f"list_extract(string_split({x}, '='), -1)"
    for a, b in (*tx.SUBSTITUTIONS, *((r, "") for r in tx.REMOVED)):
        t = f"replace({t}, {_lit(a)}, {_lit(b)})"
    for p, r in ((r"(.*?)(\$)(.*?)(\$)(.*)", r"$\3$"), (r"(\\text\{)(.*?)(\})", r"\2"), (r"(\\textbf\{)(.*?)(\})", r"\2"), (r"(\\overline\{)(.*?)(\})", r"\2"), (r"(\\boxed\{)(.*)(\})", r"\2"), (r"(frac)([^{])(.)", r"frac{\2}{\3}"), (r"(sqrt)([^{])", r"sqrt{\2}")):
        t = f"regexp_replace({t}, {_lit(p)}, {_lit(r)}, 'g')"
    return _strip(f"(SELECT CASE WHEN regexp_full_match(replace(replace(y, '$', ''), ',', ''), '[0-9]+') THEN replace(replace(y, '$', ''), ',', '') ELSE replace(y, '$', '') END FROM (SELECT {t} AS y))")


_R = "results WHERE response IS NOT NULL"
_LAST = "coalesce(list_extract(regexp_extract_all(right(response, 300), '(?i)Answer\\s*:\\s*([^\\n]+)', 1), -1), '[INVALID]')"
_BOX = "list_extract(regexp_extract_all(response, '\\\\boxed\\{([^{}]+)\\}', 1), -1)"
_STRICT = "len(regexp_extract_all({t}, '(?s)<think>(.*?)</think>', 1)) = 1 AND len(regexp_extract_all({t}, '(?s)<answer>(.*?)</answer>', 1)) = 1 AND strpos({t}, '</think>') < strpos({t}, '<answer>') AND regexp_matches(regexp_extract({t}, '(?s)<think>(.*?)</think>', 1), '[\\pL\\pN_]')"
_N = f"n AS (SELECT result_id, response, tokens, {_norm(_LAST)} AS answer, {_norm('gold_answer')} AS gold FROM {_R})"


def _same(a: str, b: str) -> str:
    num = lambda x: f"TRY_CAST(CASE WHEN regexp_full_match(replace({x}, ',', ''), '[+-]?[0-9]{{1,12}}([.][0-9]{{0,6}})?') THEN replace({x}, ',', '') END AS DOUBLE)"
    return f"coalesce(lower({a}) = lower({b}) OR {num(a)} = {num(b)}, false)"


_EXTRACT = f"""coalesce(nullif({_strip("regexp_extract_all(response, '(?is)<answer>(.*?)</answer>', 1)[1]")}, ''), {_strip(_BOX)},
 list_extract(list_filter(list_transform(string_split(CASE WHEN regexp_matches(response, '(?i)</think>') THEN substr(response, strpos(lower(response), '</think>') + 8) END, chr(10)), lambda x: {_strip("x")}), lambda x: x <> ''), -1),
 list_extract(list_filter(list_transform(string_split(response, chr(10)), lambda x: {_strip("x")}), lambda x: x <> ''), -1), '')"""
ORACLE = {
    "format_gate": f"""SELECT result_id, {_STRICT.format(t="lower(response)")} AND regexp_matches(regexp_extract(lower(response), '(?s)<answer>(.*?)</answer>', 1), '[\\pL\\pN_]') AS strict,
 {_STRICT.format(t="response")} AS strict_case FROM {_R}""",
    "tag_contents": f"SELECT result_id, CAST(pos AS INTEGER) AS pos, content FROM (SELECT result_id, unnest(range(len(x))) AS pos, unnest(x) AS content FROM (SELECT result_id, regexp_extract_all(response, '(?s)<answer>(.*?)</answer>', 1) AS x FROM {_R}))",
    "label_extract": f"""SELECT result_id, CASE WHEN t IN ('YES', 'NO') THEN t ELSE regexp_extract(t, '\\b(YES|NO)\\b', 1) END AS label
 FROM (SELECT result_id, upper({_strip("coalesce(list_extract(regexp_extract_all(response, '(?is)<answer>(.*?)</answer>', 1), -1), response)")}) AS t FROM {_R})""",
    "yes_no_score": f"""SELECT result_id, CAST(CASE WHEN ok AND a IN ('YES', 'NO') THEN 0.1 + CASE WHEN coalesce(a = g, false) THEN 0.9 ELSE 0 END ELSE 0 END AS DOUBLE) AS score FROM
 (SELECT result_id, {_STRICT.format(t="response")} AS ok, upper({_strip("regexp_extract(response, '(?s)<answer>(.*?)</answer>', 1)")}) AS a, upper({_strip("gold_answer")}) AS g FROM {_R})""",
    "boxed_score": f"SELECT result_id, CAST(CASE WHEN b IS NULL THEN 0.0 WHEN lower({_strip('b')}) = lower({_strip('g')}) THEN 1.0 ELSE 0.1 END AS DOUBLE) AS score FROM (SELECT result_id, {_BOX} AS b, gold_answer AS g FROM {_R})",
    "answer_normalize": f"WITH {_N} SELECT result_id, answer, gold FROM n",
    "combined_score": f"""WITH {_N}, s AS (SELECT result_id, CASE WHEN answer = gold THEN 1.0 ELSE -1.0 END AS a, CASE WHEN tokens IS NULL THEN NULL WHEN len(tokens) <= 256 THEN 0.0 WHEN len(tokens) <= 320 THEN (256 - len(tokens)) / 64.0 ELSE -1.0 END AS o FROM n)
SELECT result_id, round(CAST(a + coalesce(o, 0) * 0.5 AS DOUBLE), 6) AS overall, CAST(a AS DOUBLE) AS accuracy, round(CAST(coalesce(o, 0) AS DOUBLE), 6) AS overlong, CAST(0.5 * (a + 1) AS DOUBLE) AS accuracy_normalized FROM s""",
    "math_score": f"""WITH t AS (SELECT result_id, gold_answer, regexp_replace(response, '\\s*(<|>|/)\\s*', '\\1', 'g') AS response FROM {_R}),
s AS (SELECT CASE WHEN regexp_full_match(response, '(?s)<think>.*</think>.*\\\\boxed\\{{.*\\}}.*') THEN 1.0 ELSE 0.0 END AS f, CASE WHEN {_same(_norm(_BOX), _norm("gold_answer"))} THEN 1.0 ELSE 0.0 END AS a, result_id FROM t)
SELECT result_id, round(CAST(a * 0.9 + f * 0.1 AS DOUBLE), 6) AS overall, CAST(f AS DOUBLE) AS format, CAST(a AS DOUBLE) AS accuracy FROM s""",
    "think_answer_score": f"""WITH t AS (SELECT result_id, gold_answer, response, CASE WHEN regexp_matches(response, '<answer>(.*?)</answer>') THEN {_strip("regexp_extract(response, '<answer>(.*?)</answer>', 1)")} ELSE {_strip("response")} END AS g FROM {_R}),
s AS (SELECT CASE WHEN regexp_full_match(response, '(?s)<think>.*?</think>\\s*<answer>.*?</answer>') THEN 1.0 ELSE 0.0 END AS f, CASE WHEN {_same(_norm("g"), _norm(_strip("gold_answer")))} THEN 1.0 ELSE 0.0 END AS a, result_id FROM t)
SELECT result_id, round(CAST(a * 0.5 + f * 0.5 AS DOUBLE), 6) AS overall, CAST(f AS DOUBLE) AS format, CAST(a AS DOUBLE) AS accuracy FROM s""",
    "answer_extract": f"SELECT result_id, {_EXTRACT} AS answer FROM {_R}",
    "solution_normalize": f"""WITH t AS (SELECT result_id, {_clean("response")} AS response, {_clean("gold_answer")} AS g FROM {_R}),
u AS (SELECT result_id, coalesce(nullif(g, ''), nullif({_EXTRACT}, ''), 'N/A') AS a, {_strip("regexp_extract_all(response, '(?is)<think>(.*?)</think>', 1)[1]")} AS i,
 CASE WHEN strpos(lower(response), '</think>') > 0 THEN {_strip("left(response, strpos(lower(response), '</think>') - 1)")} END AS b, {_strip("regexp_replace(response, '(?is)<answer>(.*?)</answer>', '', 'g')")} AS w FROM t)
SELECT result_id, '<think>' || chr(10) || coalesce(nullif(coalesce(i, b, w), ''), {_lit(tx.FILLER)}) || chr(10) || '</think><answer>' || a || '</answer>' AS solution FROM u""",
    "prompt_sections": f"""SELECT sample_id, {_strip(f"concat_ws(chr(10), {', '.join(map(_lit, _INTRO))}, CASE WHEN {_clean('discipline')} <> '' THEN '[Discipline]' || chr(10) || {_clean('discipline')} || chr(10) END, CASE WHEN {_clean('source')} <> '' THEN '[Source]' || chr(10) || {_clean('source')} || chr(10) END, '[Question]' || chr(10) || {_clean('q')})")} AS prompt
FROM (SELECT *, CASE WHEN length({_clean("question")}) > 120 THEN regexp_replace(left({_clean("question")}, 120), '[\\s\\p{{Z}}]+$', '') || chr(10) || '...[truncated]' ELSE {_clean("question")} END AS q FROM samples)""",
    "template_render": "SELECT sample_id, coalesce(question, '') || chr(10) || chr(10) || 'Source: ' || coalesce(source, '') || ' (' || coalesce(sample_id, '') || ')' AS prompt FROM samples",
    "answer_block": "SELECT sample_id, array_to_string(list_transform(choices, lambda c, i: 'Choice ' || i || ':' || chr(10) || c), chr(10) || chr(10)) AS block FROM samples WHERE choices IS NOT NULL",
    "chat_messages": "SELECT sample_id, 0 AS pos, 'system' AS role, 'Think first.' AS content FROM samples UNION ALL SELECT sample_id, 1, 'user', question FROM samples",
    "metric_keys": "SELECT sample_id, CAST(pos AS INTEGER) AS pos, regexp_replace(concat_ws('/', sample_id, r.criterion), '[^a-zA-Z0-9_.-]+', '_', 'g') AS key FROM (SELECT sample_id, unnest(range(len(rubrics))) AS pos, unnest(rubrics) AS r FROM rubrics)",
    "points_cap": f"""SELECT sample_id, CAST(pos AS INTEGER) AS pos, CASE WHEN regexp_matches(t, {_lit("|".join(tx.FINAL_ANSWER))}) THEN least(points, 2) WHEN regexp_matches(t, {_lit("|".join(tx.FORMAT))}) THEN least(points, 1) ELSE points END AS points
FROM (SELECT sample_id, pos, r.points AS points, lower(concat_ws(' ', coalesce(r.category, 'Task'), r.criterion)) AS t FROM (SELECT sample_id, unnest(range(len(rubrics))) AS pos, unnest(rubrics) AS r FROM rubrics))""",
    "span_intervention": """WITH b AS (SELECT result_id, response, unnest(range(len(candidate_blocks))) AS pos, unnest(candidate_blocks) AS b FROM results WHERE response IS NOT NULL),
c AS (SELECT *, coalesce(b.char_start >= 0 AND b.char_end > b.char_start AND b.char_end <= length(response), false) AS ok FROM b)
SELECT result_id, CAST(pos AS INTEGER) AS pos, """
    + ", ".join(f"md5(CASE WHEN ok THEN left(response, b.char_start) || {_lit(v)} || substr(response, b.char_end + 1) ELSE response END) AS {k}" for k, v in tx.REPLACEMENTS.items())
    + " FROM c",
    "image_resize": """WITH p AS (SELECT p_partkey, p_size * 40 AS w, CAST(trunc(p_retailprice / 10) AS INTEGER) AS h FROM part),
k AS (SELECT *, CASE WHEN w * h > 100000 THEN sqrt(100000.0::DOUBLE / (w * h)) WHEN w * h < 50000 THEN sqrt(50000.0::DOUBLE / (w * h)) ELSE 1.0::DOUBLE END AS k FROM p)
SELECT p_partkey, CAST(trunc(w * k) AS INTEGER) AS width, CAST(trunc(h * k) AS INTEGER) AS height FROM k""",
    "image_expand": "SELECT p_partkey, 'see <|vision_start|><|image_pad|><|image_pad|><|vision_end|> and ' || p_name || ' <|vision_start|>' || repeat('<|image_pad|>', p_size % 3) || '<|vision_end|>' AS prompt FROM part",
    "truncate_marker": f"SELECT doc_id, md5(CASE WHEN length(t) > 500 THEN regexp_replace(left(t, 500), '[\\s\\p{{Z}}\\x{{85}}]+$', '') || chr(10) || '...[truncated]' ELSE t END) AS cut FROM (SELECT doc_id, {_clean('text')} AS t FROM documents)",
    "corpus_filter": f"SELECT doc_id, {_clean('discipline')} AS discipline, CAST(length({_clean('text')}) AS INTEGER) AS n FROM documents WHERE lower({_clean('source')}) IN ('web_crawl', 'textbook') AND lower({_clean('difficulty')}) IN ('hard', 'medium') AND {_clean('text')} <> ''",
}
