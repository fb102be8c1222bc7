"""Batches of rows: ordinals, repetition, padding, chunks, samples, joins by key and checks.

An ordinal over a whole table is made without collecting it in one task: rows are spread by ranges of the order
keys, sorted in their partition and numbered there, and each partition starts where the counts of those before
it end. Equal keys stay together, so orders should be unique; ties are numbered in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.session import settle


def with_ordinal(df: DataFrame, order: list[Column], out: str = "ordinal") -> DataFrame:
    """df with 0, 1, 2, ... by `order`. The sorted rows are written once (they are read twice, and the range
    partitioning of a second run could differ)."""
    s = settle(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id()))
    # The id holds the partition in its upper bits and counts rows in the lower 33.
    n = s.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = n.select("__p", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__s"))  # a row for each partition
    local = F.col("__i").bitwiseAND((1 << 33) - 1)
    return s.join(F.broadcast(starts), "__p").withColumn(out, F.col("__s") + local).drop("__p", "__i", "__s")


def digest(*parts: Column) -> Column:
    """sha256 of the parts joined by U+001F: the order key of the deterministic shuffle."""
    return F.sha2(F.concat_ws("\x1f", *(p.cast("string") for p in parts)), 256)


def repeat(df: DataFrame, n: int, ordinal: str, total: Column | None = None, out: str = "position") -> DataFrame:
    """Each row n times. `out` is the place of the copy: side by side (aabb), or, given the total number of rows,
    the whole batch again and again (abab)."""
    d = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    place = F.col(ordinal) * n + F.col("copy") if total is None else F.col("copy") * total + F.col(ordinal)
    return d.withColumn(out, place)


def pad_to_divisor(df: DataFrame, ordinal: str, total: int, divisor: int) -> DataFrame:
    """Rows from the start again, as often as needed, until the number is a multiple of `divisor`. Their ordinal goes
    on; `is_pad` marks them. An empty batch stays empty."""
    pad = -total % divisor
    d = df.withColumn("is_pad", F.lit(False))
    if not total or not pad:
        return d
    again = df.where(F.col(ordinal) < pad) if pad <= total else df
    k = F.explode(F.sequence(F.lit(0), F.floor((pad - 1 - F.col(ordinal)) / total).cast("int")))
    more = again.where(F.col(ordinal) < pad).withColumn("__k", k).withColumn(ordinal, F.lit(total) + F.col("__k") * total + F.col(ordinal)).drop("__k")
    return d.unionByName(more.withColumn("is_pad", F.lit(True)))


def unpad(df: DataFrame, ordinal: str, total: int) -> DataFrame:
    return df.where(F.col(ordinal) < total).drop("is_pad")


def chunks(df: DataFrame, ordinal: str, total: int, k: int, out: str = "chunk") -> DataFrame:
    """k equal chunks; a total that k doesn't divide is an error."""
    if total % k:
        raise ValueError(f"{total} rows can't be cut into {k} equal chunks")
    return df.withColumn(out, F.floor(F.col(ordinal) / (total // k)).cast("int"))


def splits(df: DataFrame, ordinal: str, size: int, out: str = "split") -> DataFrame:
    """Runs of `size` rows; the last may be shorter."""
    return df.withColumn(out, F.floor(F.col(ordinal) / size).cast("int"))


def full_batches(df: DataFrame, ordinal: str, total: int, size: int) -> DataFrame:
    """Runs of `size` rows without the last incomplete one."""
    return splits(df.where(F.col(ordinal) < total // size * size), ordinal, size, "batch")


def union_columns(a: DataFrame, b: DataFrame, key: str, shared: list[str]) -> DataFrame:
    """Columns of two batches side by side by row key. A shared column must be equal in both (null equals null), else
    the query ends; a key missing on either side has no row."""
    j = a.alias("a").join(b.alias("b"), key)
    bad = F.lit(False)
    for c in shared:
        bad = bad | ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    check = lambda c: F.when(bad, F.raise_error(F.concat(F.lit("batches differ at "), F.col(key).cast("string")))).otherwise(F.col(f"a.{c}"))
    own = [F.col(f"a.{c}") for c in a.columns if c != key and c not in shared]
    return j.select(key, *(check(c).alias(c) for c in shared), *own, *(F.col(f"b.{c}") for c in b.columns if c != key and c not in shared))


def union_info(a: dict, b: dict) -> dict:
    """Metadata of two batches; a key with two different values is an error."""
    for k in a.keys() & b.keys():
        if a[k] != b[k]:
            raise ValueError(f"metadata differ at {k}")
    return a | b


def concat(batches: list[tuple[DataFrame, dict]]) -> tuple[DataFrame, dict]:
    """The rows of several batches one after the other (`part` tells which) and the first one's metadata. Batches must have the
    same columns; no batch is an error."""
    if not batches:
        raise ValueError("nothing to concatenate")
    first, info = batches[0]
    for d, _ in batches[1:]:
        if set(d.columns) != set(first.columns):
            raise ValueError(f"batches differ in columns: {sorted(set(d.columns) ^ set(first.columns))}")
    out = None
    for i, (d, _) in enumerate(batches):
        p = d.withColumn("part", F.lit(i))
        out = p if out is None else out.unionByName(p)
    return out, dict(info)


def from_columns(spark: SparkSession, numeric: dict[str, list], other: dict[str, list], info: dict | None = None, schema: str | None = None) -> tuple[DataFrame, dict]:
    """A batch of columns of equal length, with its ordinal; a name in both groups or unequal lengths are an error. For small
    batches that a driver has in hand."""
    if both := numeric.keys() & other.keys():
        raise ValueError(f"columns given twice: {sorted(both)}")
    cols = numeric | other
    sizes = {k: len(v) for k, v in cols.items()}
    if len(set(sizes.values())) > 1:
        raise ValueError(f"columns differ in length: {sizes}")
    rows = [(i, *r) for i, r in enumerate(zip(*cols.values(), strict=True))]
    return spark.createDataFrame(rows, f"ordinal int, {schema}" if schema else ["ordinal", *cols]), dict(info or {})


# Bytes of a value by type.
WIDTHS = {"tinyint": 1, "boolean": 1, "smallint": 2, "int": 4, "float": 4, "date": 4, "bigint": 8, "double": 8, "timestamp": 8, "timestamp_ntz": 8}


def byte_size(df: DataFrame) -> DataFrame:
    """(column, bytes): values times width; texts by their UTF-8 bytes, arrays by their elements. Nulls count 0, columns of
    other types aren't listed."""
    sizes = {}
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in WIDTHS:
            sizes[name] = F.when(c.isNotNull(), F.lit(WIDTHS[kind]))
        elif kind in ("string", "binary"):
            sizes[name] = F.octet_length(c)
        elif kind.startswith("array<") and kind[6:-1] in WIDTHS:
            sizes[name] = F.when(c.isNotNull(), F.size(c) * WIDTHS[kind[6:-1]])
    if not sizes:
        raise ValueError("no column of a type with a size")
    one = df.agg(*(F.coalesce(F.sum(v.cast("bigint")), F.lit(0).cast("bigint")).alias(f"b{i}") for i, v in enumerate(sizes.values())))
    return one.select(F.inline(F.array(*(F.struct(F.lit(n).alias("column"), F.col(f"b{i}").alias("bytes")) for i, n in enumerate(sizes)))))


def pop_columns(df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    return df.select(*columns), df.drop(*columns)


def rename_columns(df: DataFrame, old: list[str], new: list[str]) -> DataFrame:
    if len(old) != len(new):
        raise ValueError("as many new names as old ones are needed")
    return df.withColumnsRenamed(dict(zip(old, new, strict=True)))


def head(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows by `order`; n <= 0 takes all."""
    return df.orderBy(*order).limit(n) if n > 0 else df


def train_val(df: DataFrame, key: Column, n_val: int, total: int, out: str = "split") -> DataFrame:
    """'val' for the first min(max(0, n_val), max(0, total - 1)) rows by the key's digest, 'train' for the others. Nothing is
    sorted but the digests of the first part, and rows are compared with its last digest; keys should be unique, as
    equal ones go to the same side."""
    n = min(max(0, n_val), max(0, total - 1))
    if not n:
        return df.withColumn(out, F.lit("train"))
    # The n-th digest: each task sends its n least ones at most, and what comes of it is one value.
    d = df.withColumn("__d", digest(key))
    edge = d.select("__d").orderBy("__d").limit(n).agg(F.max("__d").alias("e"), F.count(F.lit(1)).alias("n"))
    return d.withColumn(out, F.when(F.col("__d") <= edge.select("e").scalar(), F.lit("val")).otherwise(F.lit("train"))).drop("__d")


def ordered_distinct(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each combination of keys: that of the least `order`."""
    rest = [c for c in df.columns if c not in keys and c != order]
    g = df.groupBy(*keys).agg(F.min(F.struct(order, *rest)).alias("__m"))
    return g.select(*keys, F.col(f"__m.{order}").alias(order), *(F.col(f"__m.{c}").alias(c) for c in rest))


def first_groups(df: DataFrame, uid: str, order: str, k: int) -> DataFrame:
    """Rows of the k groups that appear first by `order`."""
    first = df.groupBy(uid).agg(F.min(order).alias("__f")).orderBy("__f", uid).limit(k)
    return df.join(first.select(uid), uid, "left_semi")


def rollout(df: DataFrame, n: int, target: str | None) -> DataFrame:
    """n sampled rows for each prompt, and one off-policy row if `target` names a column that isn't null."""
    on = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("is_onpolicy", F.lit(True))
    if target is None:
        return on
    return on.unionByName(df.where(F.col(target).isNotNull()).withColumn("copy", F.lit(n)).withColumn("is_onpolicy", F.lit(False)))


def fold(df: DataFrame, ordinal: str, width: int, value: str) -> DataFrame:
    """(row, values): `width` consecutive values as an array. Batches are small by their width."""
    g = df.groupBy(F.floor(F.col(ordinal) / width).alias("row")).agg(F.array_sort(F.collect_list(F.struct(ordinal, value))).alias("__v"))
    return g.select("row", F.transform("__v", lambda x: x[value]).alias("values"))


def quarantine(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good, rejected): rows that pass all checks, and the others with `reason`, the name of the first that fails. A
    check that gives null fails."""
    reason = F.coalesce(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()))
    d = df.withColumn("reason", reason)
    return d.where("reason is null").drop("reason"), d.where("reason is not null")


def violations(df: DataFrame, key: str, *, ids: str, mask: str, values: str, vocabulary: int | None = None) -> DataFrame:
    """(key, rule) for every rule a batch row breaks: shapes differ, mask isn't 0/1, no valid token, a value isn't
    finite, an id is negative or, if its size is given, beyond the vocabulary. Null arrays break 'missing'."""
    i, m, v = F.col(ids), F.col(mask), F.col(values)
    rules = {
        "missing": i.isNull() | m.isNull() | v.isNull(),
        "shape": (F.size(i) != F.size(m)) | (F.size(i) != F.size(v)),
        "mask": F.exists(m, lambda x: ~x.isin(0, 1)),
        "empty": F.aggregate(m, F.lit(0), lambda s, x: s + x) <= 0,
        "finite": F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull()),
        "range": F.exists(i, lambda x: x < 0 if vocabulary is None else (x < 0) | (x >= vocabulary)),
    }
    hit = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items())), lambda x: x.isNotNull())
    return df.select(key, F.explode(hit).alias("rule"))


def rows(df: DataFrame, ordinal: str, start: int, stop: int) -> DataFrame:
    """Rows start..stop - 1 of a numbered batch; still a batch."""
    return df.where((F.col(ordinal) >= start) & (F.col(ordinal) < stop))


def reorder(df: DataFrame, ordinal: str, index: DataFrame) -> DataFrame:
    """The batch gathered by index (new_ordinal, ordinal): a row may be taken several times or not at all."""
    return index.select("new_ordinal", F.col(ordinal).alias("__o")).join(df, F.col("__o") == F.col(ordinal)).drop("__o", ordinal).withColumnRenamed("new_ordinal", ordinal)


def minibatches(df: DataFrame, ordinal: str, total: int, size: int, epochs: int) -> DataFrame:
    """df once for each epoch with epoch and batch; a total that `size` doesn't divide is an error."""
    if total % size:
        raise ValueError(f"{total} rows can't be cut into batches of {size}")
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).withColumn("batch", F.floor(F.col(ordinal) / size).cast("int"))


def collate_left(df: DataFrame, ids: str, pad: int, batch: str) -> DataFrame:
    """df with ids padded on the left to the greatest length in their batch, mask and position_ids (0 for padding)."""
    longest = df.groupBy(batch).agg(F.max(F.size(ids)).alias("__m"))
    gap = F.greatest(F.col("__m") - F.size(ids), F.lit(0))
    d = df.join(longest, batch).withColumn("__gap", gap).withColumn("__n", F.size(ids))
    d = d.withColumn("input_ids", F.concat(F.array_repeat(F.lit(pad), F.col("__gap")), F.col(ids)))
    d = d.withColumn("mask", F.concat(F.array_repeat(F.lit(0), F.col("__gap")), F.array_repeat(F.lit(1), F.col("__n"))))
    numbers = F.when(F.col("__n") > 0, F.sequence(F.lit(0), F.greatest(F.col("__n") - 1, F.lit(0)))).otherwise(F.expr("cast(array() as array<int>)"))
    return d.withColumn("position_ids", F.concat(F.array_repeat(F.lit(0), F.col("__gap")), numbers)).drop("__gap", "__n", "__m")


def teacher_rows(df: DataFrame, label: Column, truth: Column) -> DataFrame:
    """The answers (one a row) whose label equals the truth, where that is YES or NO; all others' stay. A group of
    which nothing stays has failed and has no row."""
    t = F.upper(F.trim(truth))
    return df.where(~F.coalesce(t.isin("YES", "NO"), F.lit(False)) | F.coalesce(label == t, F.lit(False)))


def metric_means(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, mean, n) of metrics that were appended one by one."""
    return df.groupBy(key).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def base_url(c: Column, suffixes: tuple[str, ...] = ("/chat/completions", "/completions", "/responses")) -> Column:
    """A service's base address: without slashes at the end and without a known last part."""
    t = F.regexp_replace(F.trim(c), r"/+$", "")
    return F.regexp_replace(F.regexp_replace(t, "(?:" + "|".join(suffixes) + ")$", ""), r"/+$", "")


def image_list(images: Column, image: Column) -> Column:
    """The list of images: `images`, else the single `image` as a list; null for none."""
    c = F.coalesce(F.when(F.size(images) > 0, images), F.when(F.coalesce(image, F.lit("")) != "", F.array(image)))
    return F.when(F.size(c) > 0, c)
