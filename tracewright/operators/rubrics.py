"""Rubrics and judgements as models write them: extraction of JSON, checks with a named error, scores.

Checks are columns, so a bad record becomes a row with its error and never ends the query. Versions are told by
the end of the version text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions import arrays, stats
from tracewright.functions.text import cap_points, clean, strip

RUBRIC_VERSION, VERDICT_VERSION, ATTRIBUTION_VERSION = ".rubric.v1", ".batch_verifier.v2", ".shadow_attribution.v1"
VERDICT_SCHEMA = "struct<schema_version string, answers array<struct<answer_index string, judgement array<string>, final_score double>>>"
ATTRIBUTION_SCHEMA = "struct<schema_version string, answers array<struct<answer_index string, attributions array<struct<criterion_id string, attribution_type string, quote string>>>>>"
# Kinds of attribution.
ATTRIBUTION_TYPES = ("supporting_span", "explicit_error", "missing", "global")


def json_object(text: Column) -> Column:
    """The JSON object in a text: the text without a code fence if it parses, else what stands between the first
    and the last brace if that parses; null for anything that is no object."""
    t = strip(text)
    t = F.when(t.startswith("```"), F.regexp_replace(F.regexp_replace(t, r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")).otherwise(t)
    a = F.instr(t, "{")
    b = F.length(t) - F.instr(F.reverse(t), "}") + 1
    inner = F.when((a > 0) & (F.instr(t, "}") > 0) & (b > a), F.substr(t, a, b - a + 1))
    ok = lambda s: F.when(F.try_parse_json(s).isNotNull() & F.startswith(F.ltrim(s), F.lit("{")), s)
    return F.coalesce(ok(t), F.when(F.try_parse_json(t).isNull(), ok(inner)))


def lenient_bool(c: Column) -> Column:
    """true and false, also as text in any case; null for all else."""
    t = F.lower(strip(c))
    return F.when(t == "true", F.lit(True)).when(t == "false", F.lit(False))


def check_rubric(df: DataFrame, rubrics: str = "rubrics", version: str = "schema_version", final_cap: int = 2, format_cap: int = 1) -> DataFrame:
    """df with error (null: valid), criteria (ids c1, c2, ...; category Task if missing; points capped) and total."""
    r = F.col(rubrics)
    bad_text = F.exists(r, lambda x: clean(x["criterion"]) == "")
    bad_points = F.exists(r, lambda x: ~F.coalesce(x["points"].between(1, 5), F.lit(False)))
    error = (
        F.when(~F.coalesce(F.col(version).endswith(RUBRIC_VERSION), F.lit(False)), F.lit("version"))
        .when(F.coalesce(F.size(r), F.lit(0)) <= 0, F.lit("no criterion")).when(bad_text, F.lit("empty criterion")).when(bad_points, F.lit("points"))
    )

    def one(x: Column, i: Column) -> Column:
        cat = F.coalesce(F.nullif(x["category"], F.lit("")), F.lit("Task"))
        return F.struct(
            F.concat(F.lit("c"), (i + 1).cast("string")).alias("criterion_id"), cat.alias("category"), clean(x["criterion"]).alias("criterion"),
            cap_points(cat, clean(x["criterion"]), x["points"], final_cap, format_cap).alias("points"),
        )

    d = df.withColumn("error", error).withColumn("criteria", F.when(F.col("error").isNull(), F.transform(r, one)))
    return d.withColumn("total", F.aggregate("criteria", F.lit(0), lambda s, x: s + x["points"]))


def check_verdict(df: DataFrame, payload: str, criteria: str, expected: Column | None = None) -> DataFrame:
    """df with error (null: valid) and answers (answer_index, judgement array<boolean>, final_score recomputed from the
    points; what the payload says of it is ignored). `expected` is the number of answers asked for, if known."""
    d = df.withColumn("__j", json_object(F.col(payload))).withColumn("__p", F.from_json("__j", VERDICT_SCHEMA))
    a, c = F.col("__p.answers"), F.col(criteria)
    flags = lambda x: F.transform(x["judgement"], lenient_bool)
    order = F.exists(F.transform(a, lambda x, i: F.coalesce(x["answer_index"], (i + 1).cast("string")) != (i + 1).cast("string")), lambda b: b)
    error = (
        F.when(F.col("__j").isNull(), F.lit("json")).when(~F.coalesce(F.col("__p.schema_version").endswith(VERDICT_VERSION), F.lit(False)), F.lit("version"))
        .when(c.isNull(), F.lit("no rubric")).when(F.coalesce(F.size(a), F.lit(0)) <= 0 if expected is None else ~F.coalesce(F.size(a) == expected, F.lit(False)), F.lit("count"))
        .when(F.exists(a, lambda x: x.isNull()), F.lit("answer")).when(order, F.lit("order"))
        .when(F.exists(a, lambda x: ~F.coalesce(F.size(x["judgement"]) == F.size(c), F.lit(False))), F.lit("length"))
        .when(F.exists(a, lambda x: F.exists(flags(x), lambda b: b.isNull())), F.lit("judgement"))
    )

    def one(x: Column, i: Column) -> Column:
        won = F.aggregate(F.zip_with(flags(x), c, lambda b, y: F.when(b, y["points"]).otherwise(F.lit(0))), F.lit(0), lambda s, v: s + v)
        return F.struct((i + 1).alias("answer_index"), flags(x).alias("judgement"), won.cast("double").alias("final_score"))

    d = d.withColumn("error", error).withColumn("answers", F.when(F.col("error").isNull(), F.transform(a, one)))
    return d.drop("__j", "__p")


def normalized_score(score: Column, maximum: Column, valid: Column | None = None) -> Column:
    """score / maximum within 0..1; 0 for an invalid format or a maximum that isn't positive."""
    s = F.when(maximum > 0, F.greatest(F.least(score / maximum, F.lit(1.0)), F.lit(0.0))).otherwise(F.lit(0.0))
    return s if valid is None else F.when(valid, s).otherwise(F.lit(0.0))


def judgement_rows(df: DataFrame, keys: list[str], answers: str = "answers", criteria: str = "criteria") -> DataFrame:
    """(keys, answer_index, criterion_id, points, judged): one row for each answer and criterion of valid verdicts."""
    d = df.where(F.col(answers).isNotNull()).select(*keys, F.col(criteria).alias("__c"), F.explode(answers).alias("__a"))
    d = d.select(*keys, F.col("__a.answer_index").alias("answer_index"), F.explode(F.arrays_zip(F.col("__c").alias("c"), F.col("__a.judgement").alias("j"))).alias("__z"))
    return d.select(*keys, "answer_index", F.col("__z.c.criterion_id").alias("criterion_id"), F.col("__z.c.points").alias("points"), F.col("__z.j").alias("judged"))


def check_attribution(df: DataFrame, payload: str, ids: str, expected: Column) -> DataFrame:
    """df with error (null: valid) and answers: per answer its attributions in the order of the rubric's ids."""
    d = df.withColumn("__j", json_object(F.col(payload))).withColumn("__p", F.from_json("__j", ATTRIBUTION_SCHEMA))
    a, want = F.col("__p.answers"), F.col(ids)
    own = lambda x: F.transform(x["attributions"], lambda t: t["criterion_id"])
    same = lambda x: F.coalesce((F.size(own(x)) == F.size(want)) & (F.size(F.array_except(want, own(x))) == 0) & (F.size(F.array_distinct(own(x))) == F.size(want)), F.lit(False))
    error = (
        F.when(F.col("__j").isNull(), F.lit("json")).when(~F.coalesce(F.col("__p.schema_version").endswith(ATTRIBUTION_VERSION), F.lit(False)), F.lit("version"))
        .when(~F.coalesce(F.size(a) == expected, F.lit(False)), F.lit("count"))
        .when(F.exists(F.transform(a, lambda x, i: F.coalesce(x["answer_index"], (i + 1).cast("string")) != (i + 1).cast("string")), lambda b: b), F.lit("order"))
        .when(F.exists(a, lambda x: F.exists(x["attributions"], lambda t: ~F.coalesce(t["attribution_type"].isin(*ATTRIBUTION_TYPES), F.lit(False)))), F.lit("type"))
        .when(F.exists(a, lambda x: ~same(x)), F.lit("ids"))
    )
    ordered = lambda x: F.transform(F.array_sort(F.transform(x["attributions"], lambda t: F.struct(F.array_position(want, t["criterion_id"]).alias("o"), t.alias("t")))), lambda y: y["t"])
    answers = F.transform(a, lambda x, i: F.struct((i + 1).alias("answer_index"), ordered(x).alias("attributions")))
    return d.withColumn("error", error).withColumn("answers", F.when(F.col("error").isNull(), answers)).drop("__j", "__p")


def attribution_span(text: Column, tokens: Column, quote: Column) -> Column:
    """(char_start, char_end, token_start, token_end) of a quote: its first place and the tokens it overlaps; -1 where
    there is none."""
    at = arrays.quote_span(text, quote)

    def spans(p: Column) -> Column:
        end = p + F.length(quote)
        hit = F.filter(F.transform(tokens, lambda t, i: F.when((t["char_end"] > p) & (t["char_start"] < end), i)), lambda i: i.isNotNull())
        none = F.lit(-1)
        return stats.let(hit, lambda h: F.struct(
            p.alias("char_start"), F.when(p >= 0, end).otherwise(none).alias("char_end"),
            F.when(p >= 0, F.coalesce(F.array_min(h), none)).otherwise(none).alias("token_start"), F.when(p >= 0, F.coalesce(F.array_max(h) + 1, none)).otherwise(none).alias("token_end"),
        ))

    return stats.let(at, spans)
