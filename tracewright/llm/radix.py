"""Problem 3: percentiles of very large numeric columns by radix selection.

Values are mapped to integers of the same order, the integers' leading bits are counted per group in one
pass (a digit table), and a percentile is found by walking down that table one digit at a time, each time
into the digit that holds the target rank. Digit tables of days, partitions or sources add up, so any
longer period comes from the days' tables without the values.

Error bound: with `bits` leading bits (1 sign, 11 exponent, bits - 12 mantissa) a result lies in the same
interval [lo, hi] as the exact percentile (nearest rank), and hi - lo is at most 2**(12 - bits) of |lo|. The
reported middle of the interval is off by at most half of that; 0 and other lone values come out exact where
lo = hi. `exact_percentiles` follows the remaining bits too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.session import settle

BITS = 20
DIGIT = 8
PROBS = (0.5, 0.9, 0.99)
#: As many followed digits (a row for each group and target) are broadcast at most.
SMALL_ROWS = 50_000
MANTISSA = 52


def with_order_key(df: DataFrame, x: Column, out: str = "__k") -> DataFrame:
    """df with a long of the same order as the finite double x: for x >= 0 its IEEE bits, for x < 0 the negated bits
    of -x; -0.0 and 0.0 give 0. Rows where x is null, NaN or infinite go.

    Built-in arithmetic only; division by a power of two is exact. Each stage is a projection of its own, which
    Catalyst keeps apart because the next one uses it more than once, so a value costs one log2 and one pow."""
    keep = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    d = df.where(keep).withColumns({"__x": x, "__v": F.abs(x)})
    d = d.withColumn("__e", F.least(F.greatest(F.floor(F.log2("__v")).cast("int"), F.lit(-1022)), F.lit(1023)))
    d = d.withColumn("__lo", F.pow(F.lit(2.0), F.col("__e")))
    low, high = F.col("__v") < F.col("__lo"), F.col("__v") / F.col("__lo") >= 2.0
    d = d.withColumn("__e", F.when(low, F.col("__e") - 1).when(high, F.col("__e") + 1).otherwise(F.col("__e")))
    d = d.withColumn("__m", F.col("__v") / F.when(low, F.col("__lo") / 2.0).when(high, F.col("__lo") * 2.0).otherwise(F.col("__lo")))
    normal = (F.col("__e").cast("bigint") + 1023) * F.lit(1 << MANTISSA) + ((F.col("__m") - 1.0) * float(1 << MANTISSA)).cast("bigint")
    tiny = (F.col("__v") * float(2**537) * float(2**537)).cast("bigint")
    bits = F.when(F.col("__v") == 0.0, F.lit(0).cast("bigint")).when(F.col("__v") < 2.2250738585072014e-308, tiny).otherwise(normal)
    return d.withColumn("__b", bits).withColumn(out, F.when(F.col("__x") < 0.0, -F.col("__b")).otherwise(F.col("__b"))).drop("__x", "__v", "__e", "__lo", "__m", "__b")


def key_value(k: Column) -> Column:
    """The double whose order key is k."""
    b = F.abs(k)
    e = F.shiftright(b, MANTISSA).cast("int")
    m = b.bitwiseAND((1 << MANTISSA) - 1)
    frac = F.lit(1.0) + m.cast("double") / float(1 << MANTISSA)
    half = ((e - 1023) / 2).cast("int")
    normal = frac * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), (e - 1023) - half)
    tiny = m.cast("double") / F.pow(F.lit(2.0), F.lit(537)) / F.pow(F.lit(2.0), F.lit(537))
    v = F.when(e == 0, tiny).otherwise(normal)
    return F.when(k < 0, -v).otherwise(v)


def digit_table(values: DataFrame, keys: list[str], value: str, bits: int = BITS) -> DataFrame:
    """(keys, digit, n, lo, hi): how many values of each group share their leading `bits` bits, with the least
    and greatest of them. Null, NaN and infinite values don't count. Groups are counted before the shuffle,
    so a group that holds a third of all rows sends no more than its digits from each task."""
    rows = with_order_key(values.select(*keys, value), F.col(value).cast("double")).select(*keys, "__k")
    digit = F.shiftright(F.col("__k"), 64 - bits)
    return rows.groupBy(*keys, digit.alias("digit")).agg(F.count(F.lit(1)).alias("n"), F.min("__k").alias("lo"), F.max("__k").alias("hi"))


def combine(tables: DataFrame, keys: list[str]) -> DataFrame:
    """Digit tables of parts, appended to each other, as the table of the whole by `keys`."""
    return tables.groupBy(*keys, "digit").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _ranks(table: DataFrame, keys: list[str], probs: tuple[float, ...]) -> DataFrame:
    """(keys, p, total, rank) for each group: the nearest rank, from 1."""
    n = table.groupBy(*keys).agg(F.sum("n").alias("total"))
    p = F.explode(F.array(*(F.lit(float(x)) for x in probs)))
    rank = F.greatest(F.ceil(F.col("p") * F.col("total") - 1e-9).cast("bigint"), F.lit(1).cast("bigint"))
    return n.withColumn("p", p).withColumn("rank", rank)


def _follow(table: DataFrame, keys: list[str], probs: tuple[float, ...], bits: int) -> DataFrame:
    """(keys, p, total, rank, prefix): for each target the digit that holds it and the rank within. One digit
    of DIGIT bits a step; a window sees at most 2**DIGIT counts of a group and target (the first step the
    sign's and exponent's digits)."""
    at = _ranks(table, keys, probs).withColumn("prefix", F.lit(None).cast("bigint"))
    same = lambda a, b: [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    left, first = bits, True
    steps = [12] if bits > 12 else [bits]
    while sum(steps) < bits:
        steps.append(min(DIGIT, bits - sum(steps)))
    for step in steps:
        left -= step
        d = table.withColumn("__d", F.shiftright("digit", left) if left else F.col("digit"))
        d = d.groupBy(*keys, "__d").agg(F.sum("n").alias("__n"))
        on = same("a", "b")
        if not first:
            on.append(F.shiftright(F.col("b.__d"), step) == F.col("a.prefix"))
        j = at.alias("a").join(d.alias("b"), on=_all(on)).select("a.*", "b.__d", "b.__n")
        w = Window.partitionBy(*keys, "p").orderBy("__d").rowsBetween(Window.unboundedPreceding, 0)
        j = j.withColumn("__c", F.sum("__n").over(w)).where((F.col("__c") >= F.col("rank")) & (F.col("__c") - F.col("__n") < F.col("rank")))
        at = j.select(*keys, "p", "total", (F.col("rank") - (F.col("__c") - F.col("__n"))).alias("rank"), F.col("__d").alias("prefix"))
        first = False
    return at


def _all(cs: list[Column]) -> Column:
    out = F.lit(True)
    for c in cs:
        out = out & c
    return out


def percentiles(table: DataFrame, keys: list[str], probs: tuple[float, ...] = PROBS, bits: int = BITS) -> DataFrame:
    """(keys, p, n_values, value, lo, hi, error_bound) from a digit table. `value` is the middle of [lo, hi], the
    interval of values that were seen in the digit of the nearest rank; |value - exact| <= error_bound, and
    error_bound <= 2**(11 - bits) * |lo| for bits > 12 unless lo and hi differ in sign or exponent, which one digit
    excludes. Groups without values give no row."""
    at = _follow(table, keys, probs, bits)
    on = _all([*(F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys), F.col("a.prefix") == F.col("b.digit")])
    j = at.alias("a").join(table.alias("b"), on=on).select(*(f"a.{k}" for k in keys), "a.p", "a.total", "b.lo", "b.hi")
    lo, hi = key_value(F.col("lo")), key_value(F.col("hi"))
    return j.select(*keys, "p", F.col("total").alias("n_values"), (lo + (hi - lo) / 2).alias("value"), lo.alias("lo"), hi.alias("hi"), ((hi - lo) / 2).alias("error_bound"))


def exact_percentiles(values: DataFrame, keys: list[str], value: str, probs: tuple[float, ...] = PROBS, steps: tuple[int, ...] = (20, 16, 14, 14)) -> DataFrame:
    """(keys, p, n_values, value): the exact nearest-rank percentiles. The first step counts leading bits of all
    values; those within the followed digits, usually about a hundredth, are written once, and each later step
    keeps what lies within the digits followed so far and counts the next bits. 64 bits are followed in all."""
    if sum(steps) != 64:
        raise ValueError("steps must add up to 64 bits")
    rows = with_order_key(values.select(*keys, value), F.col(value).cast("double")).select(*keys, "__k")
    at, done = None, 0
    for step in steps:
        left = 64 - done - step
        rest = rows
        if at is not None:
            open_ = at.select(*(F.col(k).alias(f"__g{i}") for i, k in enumerate(keys)), F.col("prefix").alias("__p")).distinct()
            on = _all([*(F.col(k).eqNullSafe(F.col(f"__g{i}")) for i, k in enumerate(keys)), F.shiftright("__k", 64 - done) == F.col("__p")])
            open_ = F.broadcast(open_) if at.count() <= SMALL_ROWS else open_
            rest = rows.join(open_, on, "left_semi")
            if done == steps[0]:
                rest = rows = settle(rest)
        digit = F.shiftright("__k", left) if left else F.col("__k")
        t = rest.groupBy(*keys, digit.alias("digit")).agg(F.count(F.lit(1)).alias("n"))
        if at is None:
            at = _follow(settle(t), keys, probs, step)
        else:
            on = _all([*(F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys), F.shiftright(F.col("b.digit"), step) == F.col("a.prefix")])
            j = at.alias("a").join(t.alias("b"), on).select("a.*", "b.digit", "b.n")
            w = Window.partitionBy(*keys, "p").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
            j = j.withColumn("__c", F.sum("n").over(w)).where((F.col("__c") >= F.col("rank")) & (F.col("__c") - F.col("n") < F.col("rank")))
            at = j.select(*keys, "p", "total", (F.col("rank") - (F.col("__c") - F.col("n"))).alias("rank"), F.col("digit").alias("prefix"))
        at, done = settle(at), done + step  # small: one row for each group and target; read twice by the next step
    return at.select(*keys, "p", F.col("total").alias("n_values"), key_value(F.col("prefix")).alias("value"))
