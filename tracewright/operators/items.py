"""Items of a training batch: prepared records, prompts with images, targets, and what scoring needs of a response.

Tokenizers and image processors are hooks: `encode` turns a text column into an array of ids, and the number of pads of
each image comes with the row. A row that can't be used has its reason in `error` and null arrays; it never ends the
query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions import arrays
from tracewright.functions import text as tx
from tracewright.operators.batches import image_list

Encode = Callable[[Column], Column]

# The instructions of the first family.
SYSTEM = r"Please reason step by step, and put your final answer within \boxed{}."
SUFFIX = r"Please reason step by step, first output your thinking process, and then put your final answer within \boxed{}."
MARK, START, PAD, END = "<image>", "<|vision_start|>", "<|image_pad|>", "<|vision_end|>"
PLACEHOLDER = -200

#: The fields of a prepared record, in order.
RECORD = ("problem", "solution", "answer", "question", "reference_answer", "final_answer", "response", "original_document", "design_logic", "discipline", "difficulty", "type")


def records(df: DataFrame, keys: list[str], names: dict[str, str | Column], intro: list[str], most: dict[str, int] | None = None) -> DataFrame:
    """(keys, RECORD): prepared records of raw rows. `names` gives the columns of question, reference_answer, final_answer,
    response, original_document, design_logic, discipline, difficulty and type; what it leaves out, nulls and blanks
    are empty. Problem: intro, then the sections that aren't blank, then the question, cut to `most` characters by
    field (0: whole); documents and design logic only if `most` names them. The answer falls back to the response's."""
    most = most or {}
    raw = {f: tx.clean(c if isinstance(c := names.get(f, F.lit(None).cast("string")), Column) else F.col(c)) for f in RECORD[3:]}
    parts = [("Discipline", raw["discipline"]), ("Difficulty", raw["difficulty"]), ("Question Type", raw["type"])]
    parts += [(label, tx.truncate(raw[f], most[f])) for label, f in (("Source Document", "original_document"), ("Design Logic", "design_logic")) if f in most]
    problem = tx.sections(intro, parts, ("Question", tx.truncate(raw["question"], most.get("question", 0))))
    made = {
        "problem": problem, "solution": tx.normalize_solution(raw["response"], raw["final_answer"]),
        "answer": F.coalesce(F.nullif(raw["final_answer"], F.lit("")), tx.extract_answer(raw["response"])),
    }
    return df.select(*keys, *((made | raw)[f].alias(f) for f in RECORD))


def _with_pads(df: DataFrame, prompt: Column, images: Column, pads: Column) -> DataFrame:
    """df with __images (null: none), __pads, __marks (number of marks in the prompt) and __n (of images)."""
    d = df.withColumns({"__images": images, "__prompt": prompt})
    d = d.withColumn("__pads", F.when(F.col("__images").isNotNull(), pads)).withColumn("__n", F.coalesce(F.size("__images"), F.lit(0)))
    return d.withColumn("__marks", F.size(F.split("__prompt", MARK)) - 1)


def chat_items(
    df: DataFrame, prompt: str, encode: Encode, longest: int, *, pad: int, image_pad: int, template: Callable[[Column], Column], truncation: str = "error",
    images: str | None = None, image: str | None = None, pads: str | None = None, instruct: bool = True, target: str | None = None, eos: int = 0,
) -> DataFrame:
    """df with messages, error, images, input_ids, mask, position_ids, raw_prompt_ids and, with `target`, target_ids: the
    first family of items.

    `instruct` puts the system line before and the request for a boxed answer behind the prompt. Each mark becomes as
    many pads as its image has. Errors: 'images' (marks and images differ in number), 'length' (an expanded prompt
    with images of more than `longest` ids), 'pads' (its ids hold another number of pads), 'long' (without images,
    where `truncation` is 'error'; 'left' and 'right' cut instead). Shorter prompts are padded on the left to
    `longest`. raw_prompt_ids has one pad for each image. A null prompt counts as empty."""
    content = F.coalesce(F.col(prompt), F.lit(""))
    turns = [("system", F.lit(SYSTEM)), ("user", F.concat(content, F.lit(SUFFIX)))] if instruct else [("user", content)]
    own = image_list(F.col(images) if images else F.lit(None).cast("array<string>"), F.col(image) if image else F.lit(None).cast("string"))
    d = df.withColumn("messages", tx.chat(*turns))
    d = _with_pads(d, template(F.col("messages")), own, F.col(pads) if pads else F.lit(None).cast("array<int>"))
    has = F.col("__images").isNotNull()
    wrong = has & ((F.col("__marks") != F.col("__n")) | ~F.coalesce(F.size("__pads") == F.col("__n"), F.lit(False)))
    full = F.when(has, tx.expand_images(F.col("__prompt"), F.col("__pads"), MARK, START, PAD, END)).otherwise(F.col("__prompt"))
    raw = F.when(has, F.replace("__prompt", F.lit(MARK), F.lit(START + PAD + END))).otherwise(F.col("__prompt"))
    d = d.withColumn("__full", F.when(~wrong, full)).withColumn("__ids", encode(F.col("__full")))
    expected = F.aggregate("__pads", F.lit(0), lambda s, n: s + n)
    there = F.size(F.filter("__ids", lambda i: i == image_pad))
    error = F.when(wrong, F.lit("images")).when(has & (F.size("__ids") > longest), F.lit("length")).when(has & (there != expected), F.lit("pads"))
    if truncation == "error":
        error = error.when(F.size("__ids") > longest, F.lit("long"))
    d = d.withColumn("error", error)
    fitted = arrays.fit_length(F.col("__ids"), longest, F.lit(pad), "right" if truncation == "error" else truncation)
    mask = arrays.fit_length(F.transform("__ids", lambda i: F.lit(1)), longest, F.lit(0), "right")
    ok = F.col("error").isNull()
    d = d.withColumns({"input_ids": F.when(ok, fitted), "mask": F.when(ok, mask), "raw_prompt_ids": F.when(ok, encode(raw)), "images": F.col("__images")})
    d = d.withColumn("position_ids", arrays.position_ids(F.col("mask")))
    if target is not None:
        d = d.withColumn("target_ids", F.when(ok, arrays.with_eos(encode(F.coalesce(F.col(target), F.lit(""))), eos)))
    return d.drop("__images", "__prompt", "__pads", "__n", "__marks", "__full", "__ids")


def placeholder_items(df: DataFrame, prompt: str, encode: Encode, longest: int, *, image_pad: int, answer: str, target: str, eos: int, images: str | None = None, image: str | None = None) -> DataFrame:
    """df with error, input_ids, raw_prompt_ids, target_ids, answer, raw_prompt, image_paths and needs_dummy: the second
    family of items. `encode` gives PLACEHOLDER where an image stands; raw_prompt_ids has `image_pad` there. A prompt
    of more than `longest` ids is an error ('length') and is never cut. needs_dummy: the item has no image, so that an
    empty one must stand in."""
    content = F.coalesce(F.col(prompt), F.lit(""))
    own = image_list(F.col(images) if images else F.lit(None).cast("array<string>"), F.col(image) if image else F.lit(None).cast("string"))
    d = df.withColumn("__ids", encode(content)).withColumn("error", F.when(F.size("__ids") > longest, F.lit("length")))
    ok = F.col("error").isNull()
    raw = F.transform("__ids", lambda i: F.when(i == PLACEHOLDER, F.lit(image_pad)).otherwise(i))
    return d.withColumns({
        "input_ids": F.when(ok, F.col("__ids")), "raw_prompt_ids": F.when(ok, raw), "target_ids": F.when(ok, arrays.with_eos(encode(F.coalesce(F.col(target), F.lit(""))), eos)),
        "answer": F.col(answer), "raw_prompt": content, "image_paths": F.coalesce(own, F.expr("cast(array() as array<string>)")), "needs_dummy": own.isNull(),
    }).drop("__ids")


def response_info(
    df: DataFrame, batch_index: str, ids: str, mask: str, decode: Callable[[Column], Column] | None = None, *, log_probs: str | None = None, uid: str | None = None,
    on_policy: str | None = None, prompt: str | None = None, image_paths: str | None = None, answer: str | None = None,
) -> DataFrame:
    """(batch_index, uid, is_onpolicy, raw_prompt, image_paths, ground_truth, response_text, response_ids, uncertainties,
    response_length): what scoring needs of each response.

    The length is the sum of the mask; ids and uncertainties are cut to it. Uncertainty is the negative log-probability,
    0 for each token where there are none. Defaults: uid 'sample-' and the index, on policy, empty prompt, paths
    and truth. Null and empty paths go."""
    empty = F.expr("cast(array() as array<string>)")
    n = F.coalesce(F.aggregate(mask, F.lit(0), lambda s, m: s + F.coalesce(m.cast("int"), F.lit(0))), F.lit(0))
    d = df.withColumn("__n", n).withColumn("__ids", F.slice(F.col(ids), F.lit(1), F.col("__n")))
    zeros = F.array_repeat(F.lit(0.0), F.col("__n"))
    given = zeros if log_probs is None else F.coalesce(F.transform(F.slice(F.col(log_probs), F.lit(1), F.col("__n")), lambda p: -p.cast("double")), zeros)
    text = F.lit("") if decode is None else F.coalesce(F.when(F.col("__n") > 0, decode(F.col("__ids"))), F.lit(""))
    paths = empty if image_paths is None else F.coalesce(F.filter(image_paths, lambda p: F.coalesce(p, F.lit("")) != ""), empty)
    named = F.concat(F.lit("sample-"), F.col(batch_index).cast("string"))
    return d.select(
        F.col(batch_index).alias("batch_index"), (named if uid is None else F.coalesce(F.col(uid).cast("string"), named)).alias("uid"),
        (F.lit(True) if on_policy is None else F.coalesce(F.col(on_policy), F.lit(True))).alias("is_onpolicy"),
        (F.lit("") if prompt is None else F.coalesce(F.col(prompt).cast("string"), F.lit(""))).alias("raw_prompt"), paths.alias("image_paths"),
        (F.lit("") if answer is None else F.coalesce(F.col(answer).cast("string"), F.lit(""))).alias("ground_truth"), text.alias("response_text"),
        F.col("__ids").alias("response_ids"), given.alias("uncertainties"), F.col("__n").alias("response_length"),
    )
