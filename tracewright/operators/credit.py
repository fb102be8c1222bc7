"""Interventions on blocks, their effects on criteria, and credit of tokens. Long tables throughout: a block or
criterion is a row, and sums are made before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions.text import intervene


def intervention_items(df: DataFrame, keys: list[str], text: str, blocks: str, most: int, mode: str = "mask") -> DataFrame:
    """(keys, block_index, perturbed): the first `most` blocks of each response, each taken out of the text alone."""
    d = df.select(*keys, F.col(text).alias("__t"), F.explode(F.slice(blocks, 1, most)).alias("__b"))
    return d.select(*keys, F.col("__b.block_index").alias("block_index"), intervene(F.col("__t"), F.col("__b.char_start"), F.col("__b.char_end"), mode).alias("perturbed"))


def criterion_effects(original: DataFrame, intervened: DataFrame, keys: list[str], judged: str = "judged", valid: str | None = None) -> DataFrame:
    """(keys, block_index, criterion_id, effect): original minus intervened judgement as 0/1. An original answer of
    invalid format counts as false. Criteria judged on one side only have no row."""
    o = F.col(judged).cast("int")
    if valid:
        o = F.when(F.col(valid), o).otherwise(F.lit(0))
    a = original.select(*keys, "criterion_id", o.alias("__o"))
    b = intervened.select(*keys, "block_index", "criterion_id", F.col(judged).cast("int").alias("__i"))
    return b.join(a, [*keys, "criterion_id"]).select(*keys, "block_index", "criterion_id", (F.col("__o") - F.col("__i")).cast("double").alias("effect"))


def score_effects(original: DataFrame, intervened: DataFrame, keys: list[str], score: str = "score", valid: str | None = None) -> DataFrame:
    """(keys, block_index, score_effect): original minus intervened score. An original of invalid format counts 0; a response
    that was scored on one side only has no row."""
    o = F.col(score).cast("double")
    if valid:
        o = F.when(F.col(valid), o).otherwise(F.lit(0.0))
    a = original.select(*keys, o.alias("__o"))
    b = intervened.select(*keys, "block_index", F.col(score).cast("double").alias("__i"))
    return b.join(a, keys).select(*keys, "block_index", (F.col("__o") - F.col("__i")).alias("score_effect"))


def block_credit(blocks: DataFrame, effects: DataFrame | None, advantages: DataFrame, keys: list[str]) -> DataFrame:
    """blocks with `credit`: the sum over effects that aren't 0 of advantage * |effect| * points; where that is 0,
    combined * (1 + max(0, max_z)).

    blocks: keys, block_index, max_z, combined. effects: keys, block_index, criterion_id, effect. advantages:
    keys, criterion_id, advantage, points; a missing one counts 0 and 1."""
    b = blocks.withColumn("__fallback", F.col("combined") * (1.0 + F.greatest(F.coalesce("max_z", F.lit(0.0)), F.lit(0.0))))
    if effects is None:
        return b.withColumn("credit", F.col("__fallback")).drop("__fallback")
    e = effects.where("effect <> 0").join(advantages, [*keys, "criterion_id"], "left")
    part = F.coalesce("advantage", F.lit(0.0)) * F.abs("effect") * F.coalesce(F.col("points").cast("double"), F.lit(1.0))
    g = e.groupBy(*keys, "block_index").agg(F.sum(part).alias("__c"))
    j = b.join(g, [*keys, "block_index"], "left")
    own = F.coalesce("__c", F.lit(0.0))
    return j.withColumn("credit", F.when(own != 0.0, own).otherwise(F.col("__fallback"))).drop("__c", "__fallback")


def token_credit(blocks: DataFrame, responses: DataFrame, keys: list[str], fallback: bool = True) -> DataFrame:
    """(keys, token, credit) for every token of every response, dense.

    blocks: keys, token_start, token_end (last token), credit. responses: keys, n_tokens, combined. A block
    without place, or that begins behind the response, is left out, its end is clipped; credit / sqrt(tokens)
    goes to each of its tokens and adds up where blocks overlap. A response to which nothing was given gets
    `combined` everywhere, if fallback is on."""
    ok = (F.col("token_start") >= 0) & (F.col("token_end") >= F.col("token_start")) & (F.col("token_start") < F.col("n_tokens")) & (F.col("credit") != 0)
    end = F.least(F.col("token_end"), F.col("n_tokens") - 1)
    b = blocks.join(responses.select(*keys, "n_tokens"), keys).where(ok).withColumn("__e", end)
    b = b.withColumn("__c", F.col("credit") / F.sqrt((F.col("__e") - F.col("token_start") + 1).cast("double")))
    t = b.select(*keys, F.explode(F.sequence(F.col("token_start"), F.col("__e"))).alias("token"), "__c").groupBy(*keys, "token").agg(F.sum("__c").alias("__c"))
    given = b.groupBy(*keys).agg(F.lit(True).alias("__any"))
    all_ = responses.where("n_tokens > 0").join(given, keys, "left")
    dense = all_.select(*keys, "combined", "__any", F.explode(F.sequence(F.lit(0), F.col("n_tokens") - 1)).alias("token"))
    base = F.when(F.col("__any").isNull() & F.lit(fallback), F.col("combined")).otherwise(F.lit(0.0))
    return dense.join(t, [*keys, "token"], "left").select(*keys, "token", F.coalesce("__c", base).alias("credit"))


def credit_metrics(blocks: DataFrame, responses: DataFrame, effects: DataFrame, keys: list[str]) -> DataFrame:
    """One row: n_blocks with credit, share of tokens covered, mean of |effect| over effects that aren't 0."""
    ok = (F.col("token_start") >= 0) & (F.col("token_end") >= F.col("token_start")) & (F.col("token_start") < F.col("n_tokens")) & (F.col("credit") != 0)
    b = blocks.join(responses.select(*keys, "n_tokens"), keys).where(ok)
    n = b.agg(F.count(F.lit(1)).alias("n")).scalar()
    t = b.select(*keys, F.explode(F.sequence(F.col("token_start"), F.least(F.col("token_end"), F.col("n_tokens") - 1))).alias("token")).distinct()
    covered = t.agg(F.count(F.lit(1)).alias("n")).scalar()
    e = effects.where("effect <> 0").agg(F.coalesce(F.avg(F.abs("effect")), F.lit(0.0)).alias("m")).scalar()
    total = F.coalesce(F.sum(F.greatest("n_tokens", F.lit(0))), F.lit(0))
    return responses.agg(total.alias("n_tokens")).select(n.alias("nonzero_blocks"), F.when(F.col("n_tokens") > 0, covered / F.col("n_tokens")).otherwise(F.lit(0.0)).alias("token_coverage"), e.alias("abs_effect_mean"))


def response_metrics(blocks: DataFrame, responses: DataFrame, effects: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, nonzero_blocks, token_coverage, abs_effect_mean, used_effects, used_fallback) for every response. used_effects:
    some effect isn't 0; used_fallback: no block has credit within the response, so `combined` goes to all tokens."""
    ok = (F.col("token_start") >= 0) & (F.col("token_end") >= F.col("token_start")) & (F.col("token_start") < F.col("n_tokens")) & (F.col("credit") != 0)
    b = blocks.join(responses.select(*keys, "n_tokens"), keys).where(ok)
    t = b.select(*keys, F.explode(F.sequence(F.col("token_start"), F.least(F.col("token_end"), F.col("n_tokens") - 1))).alias("token")).distinct()
    e = effects.where("effect <> 0").groupBy(*keys).agg(F.avg(F.abs("effect")).alias("__e"))
    d = responses.join(b.groupBy(*keys).agg(F.count(F.lit(1)).alias("__b")), keys, "left").join(t.groupBy(*keys).agg(F.count(F.lit(1)).alias("__t")), keys, "left").join(e, keys, "left")
    n, zero = F.coalesce("__b", F.lit(0).cast("bigint")), F.lit(0.0)
    covered = F.when(F.col("n_tokens") > 0, F.coalesce("__t", F.lit(0)) / F.col("n_tokens")).otherwise(zero)
    return d.select(*keys, n.alias("nonzero_blocks"), covered.alias("token_coverage"), F.coalesce("__e", zero).alias("abs_effect_mean"), F.col("__e").isNotNull().alias("used_effects"), (n == 0).alias("used_fallback"))


def averaged_metrics(metrics: DataFrame, figures: tuple[str, ...] = ("nonzero_blocks", "token_coverage", "abs_effect_mean", "used_effects", "used_fallback")) -> DataFrame:
    """One row: the means of the responses' figures; flags become shares."""
    return metrics.agg(*(F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0)).alias(c) for c in figures))
