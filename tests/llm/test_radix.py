import math
import struct

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewright.llm import radix

FLOATS = st.floats(allow_nan=False, allow_infinity=False)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(FLOATS, min_size=1, max_size=40))
def test_keys_keep_order_and_return(spark, xs):
    xs += [0.0, -0.0, 1.0, 2.0, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, 0.1, 4.0, 1024.0]
    rows = radix.with_order_key(spark.createDataFrame([(x,) for x in xs], "x double"), F.col("x"), "k").select("*", radix.key_value(F.col("k")).alias("v")).collect()
    assert len(rows) == len(xs)
    for r in rows:
        bits = struct.unpack("<q", struct.pack("<d", abs(r["x"])))[0]
        assert r["k"] == (-bits if r["x"] < 0 else bits)
        assert r["v"] == r["x"]


def nearest(v, p):
    v = sorted(v)
    return v[max(1, math.ceil(p * len(v) - 1e-9)) - 1]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(1, 3), st.one_of(st.just(0.0), st.floats(-100, 1000))), min_size=1, max_size=60))
def test_days_combine_within_the_bound(spark, rows):
    d = spark.createDataFrame(rows, "s string, day int, x double")
    table = radix.digit_table(d, ["s", "day"], "x")
    for keys, of in ((["s"], lambda r: (r[0],)), (["s", "day"], lambda r: (r[0], r[1]))):
        got = radix.percentiles(radix.combine(table, keys), keys).collect()
        assert len(got) == 3 * len({of(r) for r in rows})
        for g in got:
            own = [r[2] for r in rows if of(r) == tuple(g[k] for k in keys)]
            exact = nearest(own, g["p"])
            assert g["lo"] <= exact <= g["hi"] and g["n_values"] == len(own)
            assert abs(g["value"] - exact) <= g["error_bound"] + 1e-300
            assert g["error_bound"] <= 2.0 ** (11 - radix.BITS) * max(abs(g["lo"]), abs(g["hi"])) + 1e-300


def test_exact_and_values_that_are_none(spark):
    xs = [0.0] * 50 + [i / 7 for i in range(200)] + [float("nan"), float("inf"), None]
    d = spark.createDataFrame([("a", x) for x in xs] + [("b", None)], "s string, x double")
    got = {r["p"]: r["value"] for r in radix.exact_percentiles(d, ["s"], "x", (0.01, 0.5, 0.99)).collect()}
    own = [x for x in xs if x is not None and math.isfinite(x)]
    assert got == {p: nearest(own, p) for p in got} and len(got) == 3
    assert radix.percentiles(radix.digit_table(d.limit(0), ["s"], "x"), ["s"]).count() == 0
    with pytest.raises(ValueError):
        radix.exact_percentiles(d, ["s"], "x", steps=(20,))
