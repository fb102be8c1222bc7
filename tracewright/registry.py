"""Named scorers and the hooks that models plug into.

A scorer takes the columns of response and truth and gives a score column; all are built from JVM-side functions.
Judges that are models are no part of the engine: a `Verifier` turns a DataFrame with prompts into one with the
texts a model gave, and everything before and after it is ours. Tests and plans use rule-based ones.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions import text as tx
from tracewright.functions.arrays import last_valid_reward

Scorer = Callable[[Column, Column], Column]

SCORERS: dict[str, Scorer] = {
    "boxed": tx.boxed_score,
    "boxed_math": tx.boxed_math_score,
    "math": lambda r, t: tx.math_score(r, t)["overall"],
    "think_answer": lambda r, t: tx.think_answer_score(r, t)["overall"],
    "yes_no": tx.yes_no_score,
    "last_answer": tx.answer_accuracy,
}


def scorer(name: str) -> Scorer:
    if name not in SCORERS:
        raise ValueError(f"unknown scorer {name}; known are {', '.join(sorted(SCORERS))}")
    return SCORERS[name]


def score(df: DataFrame, name: str, response: str, truth: str, out: str = "score", uid: str = "uid", flag: str = "is_onpolicy", score_offpolicy: bool = False) -> DataFrame:
    """The rule's score for every row. Where df has group and policy columns, off-policy rows get 0 unless
    score_offpolicy is set."""
    s = scorer(name)(F.col(response), F.col(truth))
    if uid in df.columns and flag in df.columns and not score_offpolicy:
        s = F.when(F.col(flag), s).otherwise(F.lit(0.0))
    return df.withColumn(out, F.coalesce(s, F.lit(0.0)))


def token_rewards(
    df: DataFrame, name: str, response: str, truth: str, length: str, judge: Callable[[DataFrame], DataFrame] | None = None, *, uid: str = "uid", flag: str = "is_onpolicy",
    score_offpolicy: bool = False, out: str = "rewards",
) -> DataFrame:
    """df with score, path and `out`, the score at the response's last token (an empty array for length 0).

    With group and policy columns in df the path is 'group': on-policy rows get what `judge` gives (it adds column
    `judged`, null where a group failed, which falls back to the rule), off-policy rows the rule's score if
    score_offpolicy is set, else 0. Without these columns the path is 'rule'."""
    grouped = uid in df.columns and flag in df.columns
    rule = F.coalesce(scorer(name)(F.col(response), F.col(truth)), F.lit(0.0))
    d = judge(df) if grouped and judge is not None else df.withColumn("judged", F.lit(None).cast("double"))
    s = rule
    if grouped:
        s = F.when(F.coalesce(F.col(flag), F.lit(True)), F.coalesce("judged", rule)).otherwise(rule if score_offpolicy else F.lit(0.0))
    d = d.withColumn("score", s).withColumn("path", F.lit("group" if grouped else "rule")).drop("judged")
    return d.withColumn(out, last_valid_reward(F.col("score"), F.coalesce(F.col(length), F.lit(0))))


class Teacher(Protocol):
    """Adds column `teacher_answers`, an array of texts, to a table with column `prompt`."""

    def __call__(self, df: DataFrame) -> DataFrame: ...


class RubricWriter(Protocol):
    """Adds column `payload`, a rubric as JSON text, to a table with columns `prompt` and `teacher_answers`."""

    def __call__(self, df: DataFrame) -> DataFrame: ...


class Attributor(Protocol):
    """Adds column `payload`, attributions as JSON text, to a table with column `prompt`."""

    def __call__(self, df: DataFrame) -> DataFrame: ...


class Verifier(Protocol):
    """Adds column `payload`, a judgement as JSON text, to a table with column `prompt`."""

    def __call__(self, df: DataFrame) -> DataFrame: ...


def rule_verifier(rule: Callable[[], Column], version: str = "x.batch_verifier.v2") -> Verifier:
    """A verifier without a model: `rule` gives an array of 0/1 columns' booleans for each row."""

    def run(df: DataFrame) -> DataFrame:
        answer = F.array(F.struct(F.lit(1).alias("answer_index"), rule().alias("judgement")))
        return df.withColumn("payload", F.to_json(F.struct(F.lit(version).alias("schema_version"), answer.alias("answers"))))

    return run
