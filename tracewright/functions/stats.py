"""Statistics of one row's array, without a shuffle. Null elements don't count; a null array gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6


def let(value: Column, use) -> Column:
    """use(value), where value is computed once for a row. An expression that stands inside a lambda would be
    computed for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def only(a: Column, *fields: str) -> Column:
    """An array of structs with these fields only. Unlike a lambda over the whole structs, it lets the scan leave out
    the other fields' columns. A null element becomes a struct of nulls."""
    return F.arrays_zip(*(a[f].alias(f) for f in fields))


def values(a: Column) -> Column:
    """The elements that are numbers: null and NaN are left out."""
    return F.filter(a, lambda x: x.isNotNull() & ~F.isnan(x))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean_or_zero(a: Column) -> Column:
    return F.when(F.size(a) > 0, total(a) / F.size(a)).when(a.isNotNull(), F.lit(0.0))


def top_r_mean(a: Column) -> Column:
    """Mean of the r largest, r = max(1, ceil(sqrt(n))); 0 for an empty array."""

    def top(v: Column) -> Column:
        r = F.ceil(F.sqrt(F.size(v).cast("double"))).cast("int")
        return mean_or_zero(F.slice(v, F.lit(1), F.greatest(r, F.lit(1))))

    return let(F.sort_array(values(a), asc=False), top)


def _middle(s: Column) -> Column:
    """Median of a sorted array without nulls; 0 if it is empty."""
    n = F.size(s)
    lo, hi = F.get(s, F.floor((n - 1) / 2).cast("int")), F.get(s, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (lo + hi) / 2).when(s.isNotNull(), F.lit(0.0))


def median(a: Column) -> Column:
    """Exact; the middle of the two middle values if their number is even; 0 for an empty array."""
    return let(F.array_sort(values(a)), _middle)


def _deviations(v: Column, m: Column) -> Column:
    return F.transform(v, lambda x: F.abs(x - m))


def mad(a: Column) -> Column:
    """Median of the absolute deviations from the median, not scaled."""
    return let(F.array_sort(values(a)), lambda s: let(_middle(s), lambda m: let(F.array_sort(_deviations(s, m)), _middle)))


def std_pop(a: Column) -> Column:
    """Population standard deviation; 0 for fewer than two values."""
    squares = lambda v, m: F.transform(v, lambda x: (x - m) * (x - m))
    return let(values(a), lambda v: let(mean_or_zero(v), lambda m: F.sqrt(mean_or_zero(squares(v, m)))))


def robust_scale(a: Column, min_denom: float = 0.05, eps: float = EPS) -> Column:
    """The divisor of the robust z: the MAD, or the standard deviation where the MAD is below `min_denom`; at
    least `min_denom` and `eps`."""
    spread = lambda d: F.when(d < min_denom, std_pop(a)).otherwise(F.lit(0.0))
    return F.when(a.isNotNull(), let(mad(a), lambda d: F.greatest(d, spread(d), F.lit(min_denom), F.lit(eps))))


def robust_z(a: Column, min_denom: float = 0.05) -> Column:
    """(x - median) / robust_scale for every element; null stays null."""
    return let(F.struct(median(a).alias("m"), robust_scale(a, min_denom).alias("s")), lambda f: F.transform(a, lambda x: (x - f["m"]) / f["s"]))


def log_sum_exp(a: Column) -> Column:
    return let(F.array_max(a), lambda m: m + F.log(total(F.transform(a, lambda x: F.exp(x - m)))))


def entropy_of_logits(a: Column) -> Column:
    """Entropy of softmax(a) in nats. Elements that are null, NaN or infinite don't count."""
    finite = F.filter(values(a), lambda x: F.abs(x) != float("inf"))
    weigh = lambda v, z: F.transform(v, lambda x: F.exp(x - z) * x)
    return let(finite, lambda v: let(log_sum_exp(v), lambda z: z - total(weigh(v, z))))


def label_log_prob(a: Column, label: Column) -> Column:
    """Log-probability of element `label` (from 0) under softmax(a); null if there is no such element."""
    return F.get(a, label) - log_sum_exp(a)


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.least(x, F.lit(hi)), F.lit(lo))
