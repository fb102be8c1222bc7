"""Shapes and sequences of one row's arrays: padding, masks, positions, returns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewright.functions.stats import let


#: Elements that are folded into one piece of a scan's result.
CHUNK = 256


def scan(a: Column, zero: Column, kind: str, step) -> Column:
    """The values (of SQL type `kind`) that a fold gives on its way: step(state, element) is (new state, value). Null for
    null. Results are gathered in chunks, since adding an element copies what it is added to: n * CHUNK / 2 copies of
    elements and (n / CHUNK)^2 / 2 of references, about a second for 100,000 elements."""
    empty, none = F.expr(f"cast(array() as array<{kind}>)"), F.expr(f"cast(array() as array<array<{kind}>>)")

    def one(s: Column, x: Column) -> Column:
        state, value = step(s["acc"], x)
        return F.struct(state.alias("acc"), F.concat(s["out"], F.array(value)).alias("out"))

    def chunk(s: Column, c: Column) -> Column:
        part = F.aggregate(c, F.struct(s["acc"].alias("acc"), empty.alias("out")), one)
        return let(part, lambda r: F.struct(r["acc"].alias("acc"), F.concat(s["out"], F.array(r["out"])).alias("out")))

    def run(v: Column) -> Column:
        # Elements by index: slice() would convert the whole array for each chunk.
        last = F.size(v) - 1
        part = lambda i: F.transform(F.sequence(i * CHUNK, F.least(i * CHUNK + CHUNK - 1, last)), lambda j: F.get(v, j))
        cuts = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(last, F.lit(0)) / CHUNK).cast("int")), part)
        whole = F.flatten(F.aggregate(cuts, F.struct(zero.alias("acc"), none.alias("out")), chunk, lambda s: s["out"]))
        return F.when(F.size(v) > 0, whole).when(v.isNotNull(), empty)

    return let(a, run)


def pad_right(a: Column, n: Column | int, fill: Column) -> Column:
    """Exactly n elements: cut, or filled on the right."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.slice(F.concat(a, F.array_repeat(fill, F.greatest(n - F.size(a), F.lit(0)))), F.lit(1), n)


def pad_left(a: Column, n: Column | int, fill: Column) -> Column:
    """At least n elements: filled on the left, never cut."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.concat(F.array_repeat(fill, F.greatest(n - F.size(a), F.lit(0))), a)


def fit_length(a: Column, n: int, fill: Column, how: str) -> Column:
    """n elements: shorter arrays are filled on the left; longer ones lose their left or right part, or (how =
    'error') end the query."""
    short = pad_left(a, n, fill)
    if how == "left":
        long = F.slice(a, F.greatest(F.size(a) - n + 1, F.lit(1)), F.lit(n))
    elif how == "right":
        long = F.slice(a, F.lit(1), F.lit(n))
    elif how == "error":
        long = F.raise_error(F.concat(F.lit("array longer than "), F.lit(str(n)))).cast("array<int>")
    else:
        raise ValueError(f"how must be left, right or error, not {how}")
    return F.when(F.size(a) > n, long).otherwise(short)


def unpad(ids: Column, mask: Column) -> Column:
    """The last sum(mask) ids, i.e. without padding on the left."""
    n = F.aggregate(mask, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))
    return F.when(n <= 0, F.slice(ids, F.lit(1), F.lit(0))).otherwise(F.slice(ids, F.greatest(F.size(ids) - n + 1, F.lit(1)), n))


def with_eos(ids: Column, eos: int) -> Column:
    return F.when(F.coalesce(F.try_element_at(ids, F.lit(-1)) == eos, F.lit(False)), ids).otherwise(F.concat(ids, F.array(F.lit(eos).cast("int"))))


def non_negative(ids: Column, instead: int = 0) -> Column:
    """Placeholder ids (negative) replaced."""
    return F.transform(ids, lambda x: F.when(x < 0, F.lit(instead)).otherwise(x))


def eos_mask(ids: Column, eos: tuple[int, ...]) -> Column:
    """1 up to and with the first element in `eos`, then 0."""
    stop = F.array_position(F.transform(ids, lambda x: x.isin(list(eos))), F.lit(True))
    return let(stop, lambda p: F.transform(ids, lambda x, i: F.when((p == 0) | (i < p), F.lit(1)).otherwise(F.lit(0))))


def position_ids(mask: Column) -> Column:
    """max(running sum of the mask - 1, 0)."""

    def step(n: Column, m: Column) -> tuple[Column, Column]:
        n = n + F.coalesce(m.cast("int"), F.lit(0))
        return n, F.greatest(n - 1, F.lit(0))

    return scan(mask, F.lit(0), "int", step)


def prefix_offsets(lengths: Column) -> Column:
    """Where each of the pieces of these lengths begins; null lengths count as 0."""
    return scan(lengths, F.lit(0), "int", lambda at, n: (at + F.coalesce(n, F.lit(0)), at))


def discounted_returns(rewards: Column, mask: Column, gamma: float) -> Column:
    """G = r + gamma * G from the end; what is carried on is set to 0 where the mask is 0, after the return of
    that place is noted."""

    def step(acc: Column, x: Column) -> tuple[Column, Column]:
        g = x["r"] + acc * gamma
        return g * x["m"], g

    return F.reverse(scan(F.reverse(F.arrays_zip(rewards.alias("r"), mask.alias("m"))), F.lit(0.0), "double", step))


def gae(rewards: Column, state_values: Column, gamma: float, lam: float) -> Column:
    """Generalised advantages before whitening: delta = r + gamma * next value - value, folded from the end."""
    after = F.concat(F.slice(state_values, F.lit(2), F.greatest(F.size(state_values) - 1, F.lit(0))), F.array(F.lit(0.0)))
    nxt = F.slice(after, F.lit(1), F.size(state_values))
    z = F.transform(F.arrays_zip(rewards.alias("r"), state_values.alias("v"), nxt.alias("n")), lambda x: x["r"] + x["n"] * gamma - x["v"])

    def step(acc: Column, d: Column) -> tuple[Column, Column]:
        g = d + acc * (gamma * lam)
        return g, g

    return F.reverse(scan(F.reverse(z), F.lit(0.0), "double", step))


def valid_indices(mask: Column) -> Column:
    """Places of the valid tokens in a row, from 0."""
    return F.filter(F.transform(mask, lambda m, i: F.when(m.cast("int") == 1, i)), lambda i: i.isNotNull())


def last_valid_reward(score: Column, n: Column) -> Column:
    """n zeros, the score in the last place; an empty array for n <= 0."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda t: F.when(t == n - 1, score).otherwise(F.lit(0.0)))).otherwise(F.expr("cast(array() as array<double>)"))


def response_positions(last_prompt: Column, n: Column) -> Column:
    return F.when(n > 0, F.sequence(last_prompt + 1, last_prompt + n)).otherwise(F.expr("cast(array() as array<int>)"))


def char_overlap(tokens: Column, start: Column, end: Column) -> Column:
    """Ordinals of the tokens that overlap [start, end) and aren't empty."""
    hit = F.transform(tokens, lambda t, i: F.when((t["char_end"] > start) & (t["char_start"] < end) & (t["char_end"] > t["char_start"]), i))
    return F.filter(hit, lambda i: i.isNotNull())


def quote_span(text: Column, quote: Column) -> Column:
    """Where the quote first stands in the text, from 0; -1 if nowhere, if it is empty or null."""
    return F.when(F.coalesce(quote, F.lit("")) == "", F.lit(-1)).otherwise(F.coalesce(F.instr(text, quote), F.lit(0)) - 1)


def grid_positions(segments: Column) -> Column:
    """struct<t, h, w: array<int>>: three-row positions of a sequence of text runs (n > 0 tokens) and image grids
    (t, h, w after merging). Text advances all rows together; a grid counts its own axes from where it begins; what
    follows begins behind the greatest position."""
    empty = F.expr("cast(array() as array<int>)")
    seed = F.struct(F.lit(0).alias("at"), empty.alias("t"), empty.alias("h"), empty.alias("w"))

    def step(s: Column, g: Column) -> Column:
        text = F.coalesce(g["n"], F.lit(0)) > 0
        area, width = F.greatest(g["h"] * g["w"], F.lit(1)), F.greatest(g["w"], F.lit(1))
        n = F.when(text, g["n"]).otherwise(g["t"] * g["h"] * g["w"])
        idx = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(empty)

        def row(of) -> Column:
            return F.transform(idx, lambda i: s["at"] + F.when(text, i).otherwise(of(i)).cast("int"))

        after = s["at"] + F.when(text, g["n"]).otherwise(F.greatest(g["t"], g["h"], g["w"]))
        return F.struct(
            after.alias("at"), F.concat(s["t"], row(lambda i: F.floor(i / area))).alias("t"),
            F.concat(s["h"], row(lambda i: F.floor(i % area / width))).alias("h"), F.concat(s["w"], row(lambda i: i % width)).alias("w"),
        )

    return F.aggregate(segments, seed, step, lambda s: F.struct(s["t"].alias("t"), s["h"].alias("h"), s["w"].alias("w")))
