"""Readers and writers of records. Readers take an explicit schema where one is known: inference reads everything."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.functions.text import clean, strip
from tracewright.operators.batches import digest, with_ordinal
from tracewright.operators.run_metrics import report
from tracewright.session import settle

FORMATS = {".parquet": "parquet", ".json": "json", ".jsonl": "jsonl", ".csv": "csv"}


def suffix_of(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return "." + name.rsplit(".", 1)[-1].lower() if "." in name else ""


def read_records(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """JSON arrays (.json), one object a line (.jsonl), CSV with a header and text columns, or parquet. A line that is
    no JSON ends the query. A .json file that holds lines, not an array, is read by lines."""
    kind = FORMATS.get(suffix_of(path))
    if kind is None:
        raise ValueError(f"can't tell the format of {path}; known are {', '.join(FORMATS)}")
    r = spark.read if schema is None else spark.read.schema(schema)
    if kind == "parquet":
        return r.parquet(path)
    if kind == "csv":
        return r.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if kind == "json" and (spark.read.text(path, wholetext=True).limit(1).select(F.ltrim(F.left("value", F.lit(64))).startswith("[")).head() or [False])[0]:
        return r.option("multiLine", True).option("mode", "FAILFAST").json(path)
    return r.option("mode", "FAILFAST").json(path)


def read_split(spark: SparkSession, path: str, schema: T.StructType | str | None = None, default: str = "train") -> DataFrame:
    """'path@split' reads the folder or file of that split, 'path' the default one: path/split.parquet, .jsonl, .json or
    .csv, the first there is. A path with the suffix of a format is that file, whatever the split is named."""
    base, _, split = path.partition("@")
    name = F.lit(split or default)
    if suffix_of(base):
        return read_records(spark, base, schema).withColumn("split", name)
    for end in FORMATS:
        if exists(spark, f"{base}/{split or default}{end}"):
            return read_records(spark, f"{base}/{split or default}{end}", schema).withColumn("split", name)
    raise FileNotFoundError(f"{base} has no split {split or default}")


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def bounded(df: DataFrame, keep: Column, most: int) -> DataFrame:
    """The first rows that pass, at most `most` of them; a bound is required. The filter runs before the cut."""
    if most <= 0:
        raise ValueError("a bounded scan needs a positive bound")
    return df.where(keep).limit(most)


def samples(df: DataFrame, ordinal: str, default_source: str, names: dict[str, str] | None = None, most: int = 0, seed: int | None = None) -> DataFrame:
    """(sample_id, source, question, answer) of raw records. Rows with a blank question go; a missing id is made from
    the place of the row before that, a missing source is the default. With a seed the order is by digest of seed
    and id; `most` > 0 takes that many from its head. `place` tells each row's place in that order, if all are wanted
    (most <= 0): rows of a table have none of their own."""
    n = {"id": "id", "source": "source", "question": "question", "answer": "answer"} | (names or {})
    made = F.concat(F.lit("sample-"), F.lpad(F.col(ordinal).cast("string"), 6, "0"))
    d = df.where(clean(F.col(n["question"])) != "").select(
        F.coalesce(F.nullif(strip(F.col(n["id"]).cast("string")), F.lit("")), made).alias("sample_id"), F.coalesce(F.nullif(strip(F.col(n["source"])), F.lit("")), F.lit(default_source)).alias("source"),
        clean(F.col(n["question"])).alias("question"), clean(F.col(n["answer"])).alias("answer"), F.col(ordinal).alias("__o"),
    )
    if most > 0:
        key = [F.col("__o")] if seed is None else [digest(F.lit(seed), F.col("sample_id")), F.col("__o")]
        d = d.orderBy(*key).limit(most)
    elif seed is not None:
        d = with_ordinal(d.withColumn("__d", digest(F.lit(seed), F.col("sample_id"))), [F.col("__d"), F.col("__o")], "place").drop("__d")
    return d.drop("__o")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """Fixed columns with a header; missing ones and nulls are empty, nested ones JSON. Outer blanks of texts stay."""
    kinds = dict(df.dtypes)
    cols = []
    for f in fields:
        c = F.lit("") if f not in kinds else F.to_json(f) if kinds[f].startswith(("array", "struct", "map")) else F.col(f).cast("string")
        cols.append(F.coalesce(c, F.lit("")).alias(f))
    df.select(*cols).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_outputs(results: DataFrame, folder: str, shown: int = 20) -> dict[str, str]:
    """results as JSON lines, their top actions and blocks as flat JSON and CSV (records with an error only in the
    first), a review of the first `shown` records as Markdown, and the counts. results is written once in between,
    so that what made it runs once; each output reads the columns it needs."""
    results = settle(results)
    ok = results.where("error is null")
    top = ok.select("sample_id", "source", F.posexplode("top_actions").alias("rank", "a")).select("sample_id", "source", (F.col("rank") + 1).alias("rank"), "a.*")
    blocks = ok.select("sample_id", "source", F.explode("candidate_blocks").alias("b")).select("sample_id", "source", "b.*")
    out = {n: f"{folder}/{n}" for n in ("results", "top_actions", "candidate_blocks", "review", "stats")}
    write_jsonl(results, out["results"])
    for n, d in (("top_actions", top), ("candidate_blocks", blocks)):
        write_jsonl(d, out[n])
        write_csv(d, out[n] + "_csv", d.columns)
    report(ok, ["source", "question", "gold_answer", "response"], shown, "sample_id").coalesce(1).write.mode("overwrite").text(out["review"])
    stats = results.agg(F.count(F.lit(1)).alias("records"), F.count("error").alias("errors"), F.sum(F.coalesce(F.size("top_actions"), F.lit(0))).alias("action_rows"), F.sum(F.coalesce(F.size("candidate_blocks"), F.lit(0))).alias("block_rows"))
    write_jsonl(stats, out["stats"])
    return out


def save_batch(df: DataFrame, info: dict, path: str) -> None:
    """A whole batch: its rows as parquet and its metadata, which must be JSON, as one line beside them."""
    df.write.mode("overwrite").parquet(f"{path}/rows")
    df.sparkSession.createDataFrame([(json.dumps(info),)], "info string").coalesce(1).write.mode("overwrite").text(f"{path}/info")


def load_batch(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/rows"), json.loads(spark.read.text(f"{path}/info").first()[0])


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


# Image types by suffix.
MIME = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp"}


def image_urls(spark: SparkSession, folder: str, largest: int) -> DataFrame:
    """(path, url, reason): files as data URLs; a file that is too large or of unknown type has a reason instead."""
    d = spark.read.format("binaryFile").load(folder)
    end = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    mime = F.create_map(*(F.lit(x) for kv in MIME.items() for x in kv))
    kind = F.try_element_at(mime, end)
    reason = F.when(kind.isNull(), F.lit("type")).when(F.col("length") > largest, F.lit("size"))
    return d.select("path", F.when(reason.isNull(), F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.base64("content"))).alias("url"), reason.alias("reason"))


def url_images(urls: DataFrame, url: str) -> DataFrame:
    """(path, url, reason) of images that are given as addresses: http(s) and data addresses stay as they are, others have
    the reason 'not an address' (read those with image_urls)."""
    ok = F.col(url).rlike(r"(?i)^(?:https?://|data:)")
    return urls.select(F.col(url).alias("path"), F.when(ok, F.col(url)).alias("url"), F.when(~F.coalesce(ok, F.lit(False)), F.lit("not an address")).alias("reason"))


def image_summary(urls: DataFrame, shown: int = 5) -> DataFrame:
    """One row: usable, skipped, and the first skipped paths by name with their reasons."""
    bad = F.when(F.col("reason").isNotNull(), F.struct("path", "reason"))
    firsts = urls.where("reason is not null").orderBy("path").limit(shown).agg(F.array_sort(F.collect_list(F.struct("path", "reason"))).alias("s")).scalar()
    return urls.agg(F.count("url").alias("usable"), F.count(bad).alias("skipped")).select("usable", "skipped", firsts.alias("examples"))


def track(metrics: DataFrame, step: int, sinks: dict[str, str]) -> None:
    """Metrics (name, value) of a step to several sinks: table and json append under a path, console prints a line.
    An unknown kind is an error before anything is written."""
    unknown = sorted(set(sinks) - {"table", "json", "console"})
    if unknown:
        raise ValueError("unknown sinks: " + ", ".join(unknown))
    d = metrics.withColumn("step", F.lit(step))
    for kind, path in sinks.items():
        if kind == "table":
            d.write.mode("append").parquet(path)
        elif kind == "json":
            append_json(d, path)
        else:
            print(" - ".join([f"step:{step}", *(f"{r['name']}:{r['value']:.3f}" for r in d.where("value is not null").orderBy("name").collect())]))
