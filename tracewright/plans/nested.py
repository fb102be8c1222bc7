"""Queries of problem 2: nested records as flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators import nested
from tracewright.session import table


def _part(path: str):
    return lambda spark, folder: nested.flat_table(table(spark, folder, "results"), "result_id", path).withColumnRenamed("record_id", "result_id")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    d = nested.dangling(table(spark, folder, "results"), "result_id")
    return d.select(F.col("record_id").cast("bigint").alias("result_id"), "link_kind", F.col("child_pos").cast("int").alias("child_pos"), F.col("target_value").cast("int").alias("target_idx"))


def p2_links(spark: SparkSession, folder: str) -> DataFrame:
    """Links of actions to tokens with both ends' labels; null target_label: leads nowhere."""
    d = nested.links(table(spark, folder, "results"), "result_id", nested.TRACE_LINKS[0])
    return d.withColumnRenamed("record_id", "result_id")


QUERIES = {
    "p2_found": p2_found,
    "p2_tokens": _part("tokens"),
    "p2_actions": _part("actions"),
    "p2_action_tokens": _part("actions.token_indices"),
    "p2_top_actions": _part("top_actions"),
    "p2_blocks": _part("candidate_blocks"),
    "p2_block_actions": _part("candidate_blocks.action_ids"),
    "p2_links": p2_links,
}


def _sql(path: str, ordinal: int, fields: str) -> str:
    return f"""
SELECT result_id, result_id || '.{ordinal}.' || pos AS label, CAST(result_id AS VARCHAR) AS parent_label, CAST(pos AS INTEGER) AS pos, {fields}
FROM (SELECT result_id, unnest(range(len({path}))) AS pos, unnest({path}) AS v FROM results)"""


def _inner(path: str, ordinal: int, inner: str, at: int) -> str:
    return f"""
SELECT result_id, result_id || '.{ordinal}.' || p || '.{at}.' || q AS label, result_id || '.{ordinal}.' || p AS parent_label, CAST(q AS INTEGER) AS pos, x AS value
FROM (SELECT result_id, p, unnest(range(len(v.{inner}))) AS q, unnest(v.{inner}) AS x
      FROM (SELECT result_id, unnest(range(len({path}))) AS p, unnest({path}) AS v FROM results))"""


_ACTION = "v.action_index, v.text, v.char_start, v.char_end, v.token_start, v.token_end, v.token_count, v.entropy_topr_mean, v.entropy_robust_z"
ORACLE = {
    "p2_found": """
WITH a AS (SELECT result_id, tokens, actions, unnest(range(len(actions))) AS p, unnest(actions) AS v FROM results),
t AS (SELECT result_id, actions, unnest(range(len(top_actions))) AS p, unnest(top_actions) AS v FROM results),
b AS (SELECT result_id, actions, unnest(range(len(candidate_blocks))) AS p, unnest(candidate_blocks) AS v FROM results),
l AS (
 SELECT result_id, 'action_token' AS link_kind, p, unnest(list_distinct(v.token_indices)) AS x, list_transform(tokens, lambda k: k.token_index) AS ks FROM a WHERE tokens IS NOT NULL
 UNION ALL SELECT result_id, 'top_action', p, v.action_index, list_transform(actions, lambda k: k.action_index) FROM t WHERE actions IS NOT NULL
 UNION ALL SELECT result_id, 'block_action', p, unnest(list_distinct(v.action_ids)), list_transform(actions, lambda k: k.action_index) FROM b WHERE actions IS NOT NULL)
SELECT result_id, link_kind, CAST(p AS INTEGER) AS child_pos, x AS target_idx FROM l WHERE x IS NOT NULL AND NOT list_contains(ks, x)""",
    "p2_tokens": _sql("tokens", 12, "v.token_index, v.token_id, v.text, v.entropy, v.char_start, v.char_end"),
    "p2_actions": _sql("actions", 13, _ACTION),
    "p2_top_actions": _sql("top_actions", 14, _ACTION),
    "p2_blocks": _sql("candidate_blocks", 15, "v.block_index, v.anchor_action_id, v.action_start, v.action_end, v.text, v.char_start, v.char_end, v.token_start, v.token_end, v.token_count, v.anchor_robust_e, v.block_mean_robust_e, v.block_max_robust_e"),
    "p2_action_tokens": _inner("actions", 13, "token_indices", 4),
    "p2_block_actions": _inner("candidate_blocks", 15, "action_ids", 2),
    "p2_links": """
SELECT result_id, 'action_token' AS link_kind, result_id || '.13.' || p AS label, CAST(p AS INTEGER) AS child_pos, x AS target_value,
 CASE WHEN list_contains(ks, x) THEN result_id || '.12.' || (list_position(ks, x) - 1) END AS target_label
FROM (SELECT result_id, p, unnest(list_distinct(v.token_indices)) AS x, list_transform(tokens, lambda k: k.token_index) AS ks
      FROM (SELECT result_id, tokens, unnest(range(len(actions))) AS p, unnest(actions) AS v FROM results WHERE tokens IS NOT NULL))
WHERE x IS NOT NULL""",
}
