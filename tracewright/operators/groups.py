"""Statistics of groups brought back to the group's rows.

Group figures are aggregated before the shuffle and joined back, not computed in windows: a window would
collect a hot group in one task, while the join's hot partition is split by AQE or, where the figures are few,
turned into a broadcast of them at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-6


def attach(df: DataFrame, keys: list[str], figures: dict[str, Column]) -> DataFrame:
    """df with the figures of each row's group as columns. Rows with null keys form groups of their own kind."""
    g = df.groupBy(*keys).agg(*(c.alias(n) for n, c in figures.items()))
    g = g.select(*(F.col(k).alias(f"__{k}") for k in keys), *figures)
    on = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"__{k}"))
        on = c if on is None else on & c
    return df.join(g, on).drop(*(f"__{k}" for k in keys))


def outcome_advantage(df: DataFrame, uid: str, score: str, on_policy: str, out: str = "advantage") -> DataFrame:
    """Group-relative outcome advantage over on-policy rows: (score - mean) / (sample std + eps). A group of one
    on-policy row has mean 0 and std 1; an off-policy row gets 1."""
    s = F.when(F.col(on_policy), F.col(score))
    d = attach(df, [uid], {"__n": F.count(s), "__m": F.avg(s), "__d": F.stddev_samp(s)})
    one = F.col("__n") <= 1
    mean, std = F.when(one, F.lit(0.0)).otherwise(F.col("__m")), F.when(one, F.lit(1.0)).otherwise(F.col("__d"))
    adv = F.when(F.col(on_policy), (F.col(score) - mean) / (std + EPS)).otherwise(F.lit(1.0))
    return d.withColumn(out, adv).drop("__n", "__m", "__d")


def fallback_advantage(df: DataFrame, uid: str, score: str, out: str = "advantage") -> DataFrame:
    """Z-score within the group by the sample std; 0 where the std is at most eps or the group has one row."""
    d = attach(df, [uid], {"__m": F.avg(score), "__d": F.coalesce(F.stddev_samp(score), F.lit(0.0))})
    return d.withColumn(out, F.when(F.col("__d") > EPS, (F.col(score) - F.col("__m")) / (F.col("__d") + EPS)).otherwise(F.lit(0.0))).drop("__m", "__d")


def criterion_advantages(df: DataFrame, uid: str, resp: str, criterion: str, judged: str, points: str, valid: str | None = None) -> DataFrame:
    """(uid, resp, combined): per criterion the 0/1 judgements (0 where the format is invalid) become z-scores in
    the group if they differ; these are averaged by points over the criteria that differ, and divided by their
    own sample std in the group if that is above eps."""
    j = F.when(F.col(judged), F.lit(1.0)).otherwise(F.lit(0.0))
    if valid:
        j = F.when(F.col(valid), j).otherwise(F.lit(0.0))
    d = attach(df.withColumn("__j", j), [uid, criterion], {"__m": F.avg("__j"), "__s": F.coalesce(F.stddev_samp("__j"), F.lit(0.0))})
    live = F.col("__s") > EPS
    w = F.when(live, F.col(points).cast("double")).otherwise(F.lit(0.0))
    z = F.when(live, (F.col("__j") - F.col("__m")) / (F.col("__s") + EPS)).otherwise(F.lit(0.0))
    r = d.groupBy(uid, resp).agg(F.sum(w * z).alias("__wz"), F.sum(w).alias("__w"))
    r = r.withColumn("__c", F.when(F.col("__w") > 0, F.col("__wz") / F.col("__w")).otherwise(F.lit(0.0)))
    r = attach(r, [uid], {"__d": F.coalesce(F.stddev_samp("__c"), F.lit(0.0))})
    return r.select(uid, resp, F.when(F.col("__d") > EPS, F.col("__c") / (F.col("__d") + EPS)).otherwise(F.col("__c")).alias("combined"))


def criterion_metrics(df: DataFrame, criterion: str, judged: str, advantage: str | None = None) -> DataFrame:
    """(criterion, n, pass_ratio, pass_std): share of true judgements and their population std; with `advantage`, adv_std,
    the population std of the criterion's advantages."""
    j = F.col(judged).cast("double")
    more = [] if advantage is None else [F.coalesce(F.stddev_pop(advantage), F.lit(0.0)).alias("adv_std")]
    return df.groupBy(criterion).agg(F.count(F.lit(1)).alias("n"), F.avg(j).alias("pass_ratio"), F.stddev_pop(j).alias("pass_std"), *more)


def criterion_z(df: DataFrame, uid: str, criterion: str, judged: str, out: str = "advantage") -> DataFrame:
    """df with each judgement's z-score within its group and criterion (sample std); 0 where all judge alike."""
    d = attach(df.withColumn("__j", F.when(F.col(judged), F.lit(1.0)).otherwise(F.lit(0.0))), [uid, criterion], {"__m": F.avg("__j"), "__s": F.coalesce(F.stddev_samp("__j"), F.lit(0.0))})
    z = F.when(F.col("__s") > EPS, (F.col("__j") - F.col("__m")) / (F.col("__s") + EPS)).otherwise(F.lit(0.0))
    return d.withColumn(out, z).drop("__j", "__m", "__s")


def score_by_source(df: DataFrame, source: str, score: str) -> DataFrame:
    """Mean score per source (null: 'unknown') and, with source 'all', over everything. A source that is named 'all' has its
    own row beside it."""
    d = df.select(F.coalesce(F.col(source), F.lit("unknown")).alias("s"), F.col(score).alias("v"))
    g = d.rollup("s").agg(F.avg("v").alias("mean_score"), F.count("v").alias("n"), F.grouping("s").alias("__g"))
    return g.select(F.when(F.col("__g") == 1, F.lit("all")).otherwise(F.col("s")).alias("source"), "mean_score", "n")


def masked_mean(value: Column, mask: Column) -> Column:
    """Aggregate: sum(v * m) / (sum(m) + 1e-8)."""
    return F.sum(value * mask) / (F.sum(mask) + 1e-8)


def masked_stats(df: DataFrame, value: str, mask: str) -> DataFrame:
    """One row (mean, variance, total): the masked mean and the masked mean of squared deviations from it times
    total / (total - 1). Fewer than two masked-in values end the query."""
    v, m = F.col(value), F.col(mask)
    mean = df.agg(masked_mean(v, m)).scalar()
    out = df.agg(F.sum(m).alias("total"), masked_mean(v, m).alias("mean"), masked_mean((v - mean) * (v - mean), m).alias("var"))
    bad = F.raise_error("masked variance needs at least two values").cast("double")
    return out.select("mean", F.when(F.col("total") > 1, F.col("var") * F.col("total") / (F.col("total") - 1)).otherwise(bad).alias("variance"), "total")


def masked_whiten(df: DataFrame, value: str, mask: str, out: str = "whitened", shift: bool = True) -> DataFrame:
    """(v - mean) / sqrt(variance + 1e-8) by the masked figures of all rows; the mean is added again unless `shift`."""
    s = masked_stats(df, value, mask)
    mean, var = s.select("mean").scalar(), s.select("variance").scalar()
    w = (F.col(value) - mean) / F.sqrt(var + 1e-8)
    return df.withColumn(out, w if shift else w + mean)


def whiten_arrays(df: DataFrame, value: str, mask: str, out: str | None = None) -> DataFrame:
    """df with array column `value` (or `out`) whitened by the masked mean and variance over all rows' elements, times
    the mask. Each row gives three sums, which are added up before the shuffle; null arrays count for nothing and
    stay null. Fewer than two masked-in values end the query."""
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    v, m = F.col(value), F.col(mask)
    one = df.agg(F.sum(add(F.zip_with(v, m, lambda x, k: x * k))).alias("s"), F.sum(add(F.transform(m, lambda k: k.cast("double")))).alias("n"))
    d = df.withColumns({"__m": one.select((F.col("s") / (F.col("n") + 1e-8)).alias("m")).scalar(), "__n": one.select("n").scalar()})
    square = d.agg(F.sum(add(F.zip_with(v, m, lambda x, k: (x - F.col("__m")) * (x - F.col("__m")) * k))).alias("q"), F.max("__n").alias("n"))
    bad = F.raise_error("masked variance needs at least two values").cast("double")
    var = square.select(F.when(F.col("n") > 1, F.col("q") / (F.col("n") + 1e-8) * F.col("n") / (F.col("n") - 1)).otherwise(bad).alias("v")).scalar()
    d = d.withColumn("__d", F.sqrt(var + 1e-8))
    return d.withColumn(out or value, F.zip_with(v, m, lambda x, k: (x - F.col("__m")) / F.col("__d") * k)).drop("__m", "__n", "__d")


def group_scores(judged: DataFrame, scores: DataFrame, uid: str, resp: str) -> DataFrame:
    """(uid, resp, advantage, used_rule): criterion advantages for groups that have judgements, z-scores of the rule's
    score for the others.

    judged: uid, resp, criterion_id, judged, points. scores: uid, resp, score, for every response."""
    good = criterion_advantages(judged, uid, resp, "criterion_id", "judged", "points").withColumnRenamed("combined", "__good")
    d = fallback_advantage(scores, uid, "score", "__rule").join(good, [uid, resp], "left")
    has = F.col("__good").isNotNull()
    return d.select(uid, resp, F.coalesce("__good", "__rule").alias("advantage"), (~has).alias("used_rule"))


def score_pipeline(scores: DataFrame, judged: DataFrame, normalized: DataFrame, taught: DataFrame, uid: str, resp: str, fallback: bool = True) -> DataFrame:
    """(uid, resp, score, advantage, error) for every response: the whole scoring of groups, in which a group that fails falls
    back and never ends the query.

    A group fails with error 'teacher' if `taught` (uid) doesn't hold it, since no teacher's answer was left, else with
    'verdict' if it has no judgements. Its responses get the rule's score (`scores`: uid, resp, score), or 0 without
    fallback, and z-scores of these; others their normalized score (uid, resp, score) and criterion advantage (from
    `judged`, see group_scores). A response that the verdict of a good group leaves out counts 0."""
    t = taught.select(uid).distinct().withColumn("__t", F.lit(True))
    v = judged.select(uid).distinct().withColumn("__v", F.lit(True))
    d = scores.join(t, uid, "left").join(v, uid, "left")
    d = d.withColumn("error", F.when(F.col("__t").isNull(), F.lit("teacher")).when(F.col("__v").isNull(), F.lit("verdict")))
    d = d.withColumn("__r", F.coalesce("score", F.lit(0.0)) if fallback else F.lit(0.0))
    d = fallback_advantage(d, uid, "__r", "__a")
    n = normalized.select(uid, resp, F.col("score").alias("__n"))
    c = criterion_advantages(judged, uid, resp, "criterion_id", "judged", "points").withColumnRenamed("combined", "__c")
    d = d.join(n, [uid, resp], "left").join(c, [uid, resp], "left")
    bad, zero = F.col("error").isNotNull(), F.lit(0.0)
    return d.select(uid, resp, F.when(bad, F.col("__r")).otherwise(F.coalesce("__n", zero)).alias("score"), F.when(bad, F.col("__a")).otherwise(F.coalesce("__c", zero)).alias("advantage"), "error")
