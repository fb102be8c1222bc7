"""Figures of a run: batch metrics, timing, work estimates, lists of checkpoints, report lines."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def batch_metrics(df: DataFrame, figures: dict[str, Column], lengths: str, longest: int | None = None, masks: dict[str, Column] | None = None) -> DataFrame:
    """One row: mean, max and min of each figure (where it has a mask, of the rows that it lets through), of the length, and
    the share of rows at the greatest length: `longest`, or that of the batch."""
    on = {n: F.when(masks[n], c) if masks and n in masks else c for n, c in figures.items()}
    aggs = [f(c).alias(f"{n}_{k}") for n, c in {**on, "length": F.col(lengths)}.items() for k, f in (("mean", F.avg), ("max", F.max), ("min", F.min))]
    most = F.lit(longest) if longest is not None else df.agg(F.max(lengths)).scalar()
    return df.agg(*aggs, F.avg((F.col(lengths) >= most).cast("double")).alias("clip_ratio"))


def explained_variance(df: DataFrame, ret: str, value: str) -> DataFrame:
    """One row: 1 - var(ret - value) / (var(ret) + 1e-5), sample variances."""
    return df.agg((1.0 - F.var_samp(F.col(ret) - F.col(value)) / (F.var_samp(ret) + 1e-5)).alias("explained_variance"))


def timing_per_token(df: DataFrame, seconds: dict[str, str], response: str, overall: str, response_only: tuple[str, ...] = ("gen",)) -> DataFrame:
    """(stage, ms_per_token): sums of seconds by tokens; stages in `response_only` by response tokens."""
    one = df.agg(*(F.sum(c).alias(n) for n, c in seconds.items()), F.sum(response).alias("__r"), F.sum(overall).alias("__o"))
    rows = F.array(*(F.struct(F.lit(n).alias("stage"), (F.col(n) * 1000.0 / F.when(F.lit(n in response_only), F.col("__r")).otherwise(F.col("__o"))).alias("ms_per_token")) for n in seconds))
    return one.select(F.inline(rows))


def sequence_kl(df: DataFrame, seq: str, value: str, mask: str) -> DataFrame:
    """One row (kl): masked mean of each sequence, then the mean over the sequences."""
    m = F.sum(F.col(value) * F.col(mask)) / (F.sum(mask) + 1e-8)
    return df.groupBy(seq).agg(m.alias("__m")).agg(F.avg("__m").alias("kl"))


def flops(df: DataFrame, tokens: str, dense: float, head_dim: int, heads: int, layers: int, seconds: float | None = None) -> DataFrame:
    """One row (tflops): 6 * dense * sum(n) + 12 * sum(n * n) * head_dim * heads * layers, in 1e12; of a second, if the
    seconds are given."""
    n = F.col(tokens).cast("double")
    work = (6.0 * dense * F.sum(n) + 12.0 * F.sum(n * n) * (head_dim * heads * layers)) / 1e12
    return df.agg((work if seconds is None else work / seconds).alias("tflops"))


#: Families of models whose work is known: gated feed-forward layers with grouped attention.
KNOWN_MODELS = frozenset(("llama", "qwen2", "qwen2_vl", "qwen2_5_vl", "qwen3"))


def model_flops(df: DataFrame, tokens: str, model: dict, seconds: float) -> DataFrame:
    """flops of a model by its shape (model_type, hidden_size, vocab_size, layers, heads, kv_heads, intermediate_size); 0 for an
    unknown type."""
    if model.get("model_type") not in KNOWN_MODELS:
        return df.agg(F.lit(0.0).alias("tflops"))
    h, head_dim = model["hidden_size"], model["hidden_size"] // model["heads"]
    attention = h * (2 * model["heads"] + 2 * model["kv_heads"]) * head_dim
    dense = (3 * h * model["intermediate_size"] + attention) * model["layers"] + 2 * model["vocab_size"] * h
    return flops(df, tokens, float(dense), head_dim, model["heads"], model["layers"], seconds)


# Peak TFLOPS by part of a device's name, looked up in this order.
PEAKS = (("H100", 989), ("H800", 989), ("A100", 312), ("A800", 312), ("L40", 181.05), ("L20", 119.5), ("H20", 148), ("910B", 354))


def peak_tflops(name: Column) -> Column:
    out = F.lit(None).cast("double")
    for part, v in reversed(PEAKS):
        out = F.when(name.contains(part), F.lit(float(v))).otherwise(out)
    return out


def with_unit(n: Column) -> Column:
    """1234567 as '1.23M'."""
    return F.when(n > 1e9, F.format_string("%.2fB", n / 1e9)).when(n > 1e6, F.format_string("%.2fM", n / 1e6)).when(n > 1e3, F.format_string("%.2fK", n / 1e3)).otherwise(n.cast("bigint").cast("string"))


def metric_line(names: list[str], step: str = "step") -> Column:
    """'step:3 - a:0.500 - b:1.250'; null figures are left out."""
    return F.concat_ws(" - ", F.concat(F.lit(f"{step}:"), F.col(step).cast("string")), *(F.when(F.col(n).isNotNull(), F.concat(F.lit(f"{n}:"), F.format_string("%.3f", F.col(n).cast("double")))) for n in names))


def checkpoint_steps(paths: DataFrame, path: str) -> DataFrame:
    """paths with `step`, the number after 'global_step_' in a folder's name; others are dropped."""
    s = F.regexp_extract(path, r"global_step_(\d+)$", 1)
    return paths.withColumn("step", F.nullif(s, F.lit("")).cast("bigint")).where("step is not null")


def latest_checkpoint(paths: DataFrame, path: str) -> DataFrame:
    """The path of the greatest step, by number."""
    return checkpoint_steps(paths, path).agg(F.max_by(path, "step").alias(path), F.max("step").alias("step"))


def checkpoints_to_drop(paths: DataFrame, path: str, keep: int, score: str) -> DataFrame:
    """All but the newest `keep` checkpoints and the best one by score (ties: the later step)."""
    d = checkpoint_steps(paths, path)
    best = d.agg(F.max(F.struct(score, "step")).alias("b")).select("b.step").scalar()
    oldest_kept = d.orderBy(F.desc("step")).limit(keep).agg(F.min("step")).scalar()
    return d.where((F.col("step") < oldest_kept) & (F.col("step") != best))


def retention(paths: DataFrame, path: str, score: str, keep: int = 0, keep_shards: int = 0) -> DataFrame:
    """(path, step, drop): what is to be removed of checkpoints: 'all' of those beyond the newest `keep`, then 'shards' of those
    left beyond the newest `keep_shards`. The best one by score is never touched; a bound of 0 is none."""
    d = checkpoint_steps(paths, path)
    drop = F.lit(None).cast("string")
    if keep > 0:
        gone = checkpoints_to_drop(paths, path, keep, score).select("step", F.lit("all").alias("__g"))
        d = d.join(gone, "step", "left")
        drop = F.col("__g")
    d = d.withColumn("drop", drop)
    if keep_shards > 0:
        left = checkpoints_to_drop(d.where("drop is null").select(path, score), path, keep_shards, score).select("step", F.lit("shards").alias("__s"))
        d = d.join(left, "step", "left").withColumn("drop", F.coalesce("drop", "__s"))
    return d.where("drop is not null").select(path, "step", "drop")


def write_tracker(spark: SparkSession, folder: str, step: int) -> None:
    """Notes the last finished step of a run in its folder."""
    spark.createDataFrame([(str(step),)], "step string").coalesce(1).write.mode("overwrite").text(f"{folder}/latest_checkpointed_iteration")


def resume_path(spark: SparkSession, folder: str, paths: DataFrame, path: str) -> str | None:
    """The checkpoint that the tracker names, if it is among the paths; None without a tracker or checkpoint."""
    try:
        noted = spark.read.text(f"{folder}/latest_checkpointed_iteration").first()
    except AnalysisException:
        return None
    found = checkpoint_steps(paths, path).where(F.col("step") == int(noted[0])).agg(F.max(path)).first()[0] if noted else None
    return found


def validation_table(df: DataFrame, step: Column, columns: list[str], order: Column, n: int) -> DataFrame:
    """(step, samples): one row with the first n rows by `order` as an array of structs."""
    top = df.orderBy(order, *columns).limit(n)
    return top.agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("samples")).select(step.alias("step"), "samples")


def validation_row(df: DataFrame, step: Column, columns: list[str], order: Column, n: int) -> DataFrame:
    """One wide row: step, then the columns of the first n rows by `order` as name_1, name_2, ...; null where there are fewer."""
    t = validation_table(df, step, columns, order, n)
    return t.select("step", *(F.get("samples", F.lit(i))[c].alias(f"{c}_{i + 1}") for i in range(n) for c in columns))


def review(df: DataFrame, n: int, order: str, top: str = "top_actions", blocks: str = "candidate_blocks") -> DataFrame:
    """(text): one row, a Markdown review of the first n records without an error: question (cut at 1200 characters), expected
    answer, top actions by rank with their z, and blocks with their greatest z. Null arrays list nothing."""
    z = lambda c: F.coalesce(F.format_string("%.3f", c), F.lit("-"))
    acts = F.transform(top, lambda a, i: F.concat((i + 1).cast("string"), F.lit(". ["), z(a["entropy_robust_z"]), F.lit("] "), F.coalesce(a["text"], F.lit(""))))
    parts = F.transform(blocks, lambda b: F.concat(F.lit("- block "), b["block_index"].cast("string"), F.lit(" ["), z(b["block_max_robust_e"]), F.lit("]: "), F.coalesce(b["text"], F.lit(""))))
    text = F.concat_ws(
        "\n", F.concat(F.lit("## "), F.col(order).cast("string")), F.concat(F.lit("Question: "), F.left(F.coalesce("question", F.lit("")), F.lit(1200))),
        F.concat(F.lit("Expected: "), F.coalesce("gold_answer", F.lit(""))), F.lit("Top actions:"), acts, F.lit("Blocks:"), parts,
    )
    rows = df.where("error is null").orderBy(order).limit(n).select(order, text.alias("part"))
    one = rows.agg(F.array_sort(F.collect_list(F.struct(order, "part"))).alias("r"))
    return one.select(F.array_join(F.transform("r", lambda x: x["part"]), "\n\n").alias("text"))


def report(df: DataFrame, columns: list[str], n: int, order: str) -> DataFrame:
    """(text): one row, a Markdown list of the first n rows, texts cut at 1200 characters."""
    part = F.concat(F.lit("## "), F.col(order).cast("string"), *(F.concat(F.lit(f"\n- {c}: "), F.left(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(1200))) for c in columns))
    rows = df.orderBy(order).limit(n).select(order, part.alias("part")).agg(F.array_sort(F.collect_list(F.struct(order, "part"))).alias("r"))
    return rows.select(F.array_join(F.transform("r", lambda x: x["part"]), "\n\n").alias("text"))
