"""Problem 7: mixing sources to target weights.

Method: Pareto order sampling. Every document has an expected number of uses of its own: `rate` x weight, at most
max_repeats, where the weight is the document's size to the power `power` (in STEPS steps an octave) and the
source's rate makes the expected tokens meet the target. The whole part of it are certain copies. The rest is the
document's inclusion probability q, and documents are ranked by random odds over inclusion odds,
(u / (1 - u)) / (q / (1 - q)) with u a hash of the document, and taken in that order until the sample has its
fixed size, the tokens that the certain copies leave open. As those tokens are the sum of q x size, a document
is taken with probability near q. u depends on seed and document only.

Weights come in steps so that a source's rate can be found from a table of (source, step) rows: with the steps
in falling order, the rate at which the first k of them reach max_repeats is one division. The order is never
sorted whole: ranks are cut into `buckets` by value, the buckets' token sums (sources x buckets rows at most)
give the bucket in which each source is filled, and only that bucket is sorted, so a source with a third of all
rows is one part in `buckets` of a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.session import settle

BUCKETS = 4096
STEPS = 16
POWER = 0.5


def source_key(c: Column) -> Column:
    """A source as it is compared: trimmed and in lower case; blank is null."""
    t = F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    return F.when(t != "", t)


def _targets(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """One row for each target, with source_tokens, n_documents, total_tokens and target_tokens. Small: as many
    rows as the targets."""
    own = docs.groupBy("__s").agg(F.sum("n_tokens").alias("own"), F.count(F.lit(1)).alias("n_docs"))
    t = targets.select(
        F.col("source").alias("source"), source_key(F.col("source")).alias("__k"), F.coalesce(F.col("target_share"), F.lit(0.0)).cast("double").alias("target_share"),
        F.greatest(F.coalesce(F.col("max_repeats"), F.lit(0)), F.lit(0)).alias("max_repeats"),
    )
    j = t.join(own, t["__k"] == own["__s"], "left").select(
        "source", "__k", "target_share", "max_repeats", F.coalesce("own", F.lit(0).cast("bigint")).alias("source_tokens"), F.coalesce("n_docs", F.lit(0).cast("bigint")).alias("n_documents")
    )
    j = j.withColumn("total_tokens", j.agg(F.coalesce(F.sum("source_tokens"), F.lit(0).cast("bigint"))).scalar())
    return j.withColumn("target_tokens", F.col("target_share") * F.col("total_tokens"))


def _rates(docs: DataFrame, need: DataFrame) -> DataFrame:
    """(__s, __w, source, target_tokens, __mean): the expected uses of a document of weight __w of each source. A
    row for each source and step of weight: a few hundred for each target."""
    steps = docs.where("n_tokens > 0").groupBy("__s", "__w").agg(F.sum("n_tokens").alias("__n"))
    t = need.select(F.col("__k").alias("__s"), "source", "target_tokens", F.col("max_repeats").cast("double").alias("__most"))
    above = Window.partitionBy("__s").orderBy(F.desc("__w")).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.partitionBy("__s").orderBy(F.desc("__w")).rowsBetween(0, Window.unboundedFollowing)
    s = steps.join(F.broadcast(t), "__s")  # a row for each target
    s = s.withColumn("__full", F.coalesce(F.sum("__n").over(above), F.lit(0))).withColumn("__left", F.sum(F.col("__n") * F.col("__w")).over(rest))
    # The rate if all heavier steps, and only they, are used max_repeats times; the first such rate that keeps this step below is the one.
    s = s.withColumn("__c", F.greatest(F.col("target_tokens") - F.col("__most") * F.col("__full"), F.lit(0.0)) / F.col("__left"))
    fits = F.when(F.col("__c") * F.col("__w") <= F.col("__most"), F.struct(-F.col("__w"), F.col("__c").alias("c")))
    s = s.withColumn("__rate", F.min(fits).over(Window.partitionBy("__s"))["c"])
    mean = F.when(F.col("__rate").isNull(), F.col("__most")).otherwise(F.least(F.col("__rate") * F.col("__w"), F.col("__most")))
    return s.select("__s", "__w", "source", "target_tokens", mean.alias("__mean"))


def mix(
    docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", source: str = "source", size: str = "n_tokens",
    buckets: int = BUCKETS, seed: int = 29, power: float = POWER,
) -> tuple[DataFrame, DataFrame]:
    """(uses, shares).

    uses: (id, source, n_tokens, mean_uses, uses) for every document of a listed source; mean_uses is the expected
    number of uses, and uses is its whole part or one more. shares: one row for each target with target_share,
    max_repeats, n_documents, source_tokens, target_tokens, used_tokens, actual_share (of all used tokens; null if
    none are used), n_used, is_short. is_short: all of the source is used max_repeats times and that stays below
    the target; no other source is given what is missing.

    `power` sets how much more often large documents are used than small ones of their source: not at all at 0,
    in proportion to size at 1. Sources are compared trimmed and in lower case; documents without a listed
    source have no row. Null, zero or negative sizes count as 0 tokens, and such documents aren't used. Documents
    with equal id and size have the same random number and go together as far as the tokens allow. Targets must
    not list a source twice. `docs` is read several times and should be written or cached.
    """
    d = docs.select(F.col(id_col).alias("__id"), source_key(F.col(source)).alias("__s"), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("bigint").alias("n_tokens"))
    keys = F.broadcast(targets.select(source_key(F.col("source")).alias("__k")).distinct())  # the targets: a list made by hand, no table that grows
    d = d.join(keys, d["__s"] == F.col("__k"), "left_semi")
    weight = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(F.col("n_tokens"), F.lit(1)).cast("double")) * STEPS) * (power / STEPS))
    d = d.withColumn("__w", F.when(F.col("n_tokens") > 0, weight).otherwise(F.lit(0.0)))
    # Small tables that several steps read: written once, which also keeps the plans small.
    need = settle(_targets(d, targets))
    rates = settle(_rates(d, need))
    # What the certain copies leave open of each target, in tokens.
    whole = F.floor(F.col("__mean") + 1e-9).cast("int")
    j = d.join(F.broadcast(rates), ["__s", "__w"], "left").join(F.broadcast(need.select(F.col("__k").alias("__s"), F.col("source").alias("__name"))), "__s")
    j = j.withColumn("__mean", F.coalesce("__mean", F.lit(0.0))).withColumn("__whole", whole).withColumn("__q", F.greatest(F.col("__mean") - F.col("__whole"), F.lit(0.0)))
    u = (F.pmod(F.xxhash64("__id", F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    odds = (u / (F.lit(1.0) - u)) / (F.col("__q") / (F.lit(1.0) - F.col("__q")))
    j = j.withColumn("__o", F.when(F.col("__q") > 1e-9, odds))
    j = j.withColumn("__b", F.when(F.col("__o").isNotNull(), F.least(F.floor(F.col("__o") / (F.col("__o") + 1.0) * buckets), F.lit(buckets - 1)).cast("int")))
    w = Window.partitionBy("__s").orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    open_ = F.sum(F.col("__whole") * F.col("n_tokens"))
    sums = j.groupBy("__s", "__b").agg(F.sum("n_tokens").alias("__t"), open_.alias("__certain"), F.first("target_tokens", ignorenulls=True).alias("__want"))
    every = Window.partitionBy("__s")
    sums = sums.withColumn("__r", F.max("__want").over(every) - F.sum("__certain").over(every)).where(F.col("__b").isNotNull())
    sums = sums.withColumn("__to", F.sum("__t").over(w)).withColumn("__from", F.col("__to") - F.col("__t"))
    # The bucket in which the source is filled; if all of them aren't enough, one behind the last.
    edge = sums.groupBy("__s").agg(
        F.coalesce(F.min(F.when(F.col("__to") > F.col("__r"), F.col("__b"))), F.lit(buckets)).alias("__eb"), F.first("__r").alias("__r"),
        F.min(F.when(F.col("__to") > F.col("__r"), F.col("__from"))).alias("__ef"),
    )
    j = j.join(F.broadcast(settle(edge)), "__s", "left")  # at most a row for each target
    out = ["__id", "__name", "n_tokens", "__mean"]
    inside = F.coalesce(F.col("__b") == F.col("__eb"), F.lit(False))
    below = F.coalesce(F.col("__b") < F.col("__eb"), F.lit(False))
    plain = j.where(~inside).select(*out, (F.col("__whole") + below.cast("int")).alias("uses"))
    order = Window.partitionBy("__s").orderBy("__o", "__id", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = j.where(inside).withColumn("__c", F.col("__ef") + F.sum("n_tokens").over(order))
    # The last document that would pass the target is taken if that comes nearer to it.
    taken = F.col("__c") - F.col("n_tokens") / 2 <= F.col("__r")
    uses = plain.unionByName(ranked.select(*out, (F.col("__whole") + taken.cast("int")).alias("uses")))
    uses = uses.select(F.col("__id").alias(id_col), F.col("__name").alias("source"), "n_tokens", F.col("__mean").alias("mean_uses"), "uses")
    used = uses.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("used_tokens"), F.sum((F.col("uses") > 0).cast("bigint")).alias("n_used"))
    shares = need.join(used, "source", "left").withColumn("used_tokens", F.coalesce("used_tokens", F.lit(0).cast("bigint")))
    shares = shares.withColumn("__all", shares.agg(F.sum("used_tokens")).scalar())
    short = (F.col("used_tokens") < F.col("target_tokens")) & (F.col("used_tokens") >= F.col("max_repeats") * F.col("source_tokens"))
    shares = shares.select(
        "source", "target_share", "max_repeats", "n_documents", "source_tokens", "target_tokens", "used_tokens",
        F.when(F.col("__all") > 0, F.col("used_tokens") / F.col("__all")).alias("actual_share"), F.coalesce("n_used", F.lit(0).cast("bigint")).alias("n_used"), short.alias("is_short"),
    )
    return uses, shares
