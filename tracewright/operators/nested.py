"""Deeply nested records as related flat tables, by Dewey labels.

Every node of a record's tree gets a label: the record's id, then for each level the ordinal of the field in
its parent's schema and the position in the array, e.g. `17.9.3.4.0` is element 0 of field 4 of element 3 of
field 9 of record 17. A parent's label is its child's with the last two parts cut off, so no join or lookup
is needed to make the links, and the nodes of one schema path form one table. Labelling is a projection and
an explode for each level: no shuffle at any size, and a record never leaves its task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parent_of(label: Column) -> Column:
    """The parent's label: the last two parts cut off. Null at a record's own label, if that has no dot."""
    tail = F.substring_index(label, ".", -2)
    return F.nullif(F.left(label, F.length(label) - F.length(tail) - 1), F.lit(""))


def _paths(schema: T.StructType, prefix: tuple[str, ...] = ()) -> list[tuple[str, ...]]:
    out = []
    for f in schema.fields:
        t = f.dataType
        if isinstance(t, T.ArrayType):
            out.append((*prefix, f.name))
            if isinstance(t.elementType, T.StructType):
                out += _paths(t.elementType, (*prefix, f.name))
        elif isinstance(t, T.StructType):
            out += [p for p in _paths(t, (*prefix, f.name)) if len(p) > len(prefix) + 1]
    return out


def schema_paths(df: DataFrame) -> list[str]:
    """Every array in the schema, nested ones too, as a dotted path. Each becomes a table."""
    return [".".join(p) for p in _paths(df.schema)]


def _step(t: T.StructType, value: Column | None, name: str) -> tuple[int, T.DataType, Column]:
    names = [f.name for f in t.fields]
    if name not in names:
        raise ValueError(f"no field {name} in {names}")
    i = names.index(name)
    return i, t.fields[i].dataType, (F.col(f"`{name}`") if value is None else value[name])


def flat_table(df: DataFrame, id_col: str, path: str, carry: dict[str, Column] | None = None) -> DataFrame:
    """The nodes at one schema path: (record_id, label, parent_label, pos, fields). Scalars of the element and
    of structs in it become columns (nested ones joined by '_'); an array of scalars gives one column `value`;
    arrays inside stay out, they are tables of their own. A null or empty array gives no rows, a null element
    a row of nulls, as it has a label. A field that would clash with the first four gets '_' in front.
    `carry` adds columns computed from the record's own columns. A record with a null id is labelled '~'."""
    parts = path.split(".")
    rid = F.col(f"`{id_col}`")
    label = F.coalesce(rid.cast("string"), F.lit("~"))
    extra = carry or {}
    cur = df.select(rid.alias("record_id"), label.alias("label"), *(c.alias(n) for n, c in extra.items()), *(F.col(f"`{p}`").alias(f"__{p}") for p in [parts[0]]))
    kind: T.DataType = df.schema
    value: Column | None = None
    at = F.lit("")
    for n, name in enumerate(parts):
        if not isinstance(kind, T.StructType):
            raise ValueError(f"{path}: {name} lies in no struct")
        i, kind, _ = _step(kind, value, name)
        value = F.col(f"__{name}") if n == 0 else value[name]
        at = F.concat(at, F.lit(f".{i}"))
        if isinstance(kind, T.ArrayType):
            kind = kind.elementType
            cur = cur.select("record_id", *extra, F.col("label"), at.alias("__at"), F.posexplode(value).alias("pos", "__v"))
            cur = cur.withColumn("label", F.concat("label", "__at", F.lit("."), F.col("pos")))
            value, at = F.col("__v"), F.lit("")
        elif n == len(parts) - 1:
            raise ValueError(f"{path} is no array")
    taken = {"record_id", "label", "parent_label", "pos", *extra}

    def scalars(t: T.DataType, v: Column, name: str) -> list[Column]:
        if isinstance(t, T.ArrayType | T.MapType):
            return []
        if isinstance(t, T.StructType):
            return [c for f in t.fields for c in scalars(f.dataType, v[f.name], f"{name}_{f.name}" if name else f.name)]
        name = name or "value"
        return [v.alias(f"_{name}" if name in taken else name)]

    return cur.select("record_id", "label", parent_of(F.col("label")).alias("parent_label"), "pos", *extra, *scalars(kind, value, ""))


def flatten(df: DataFrame, id_col: str) -> dict[str, DataFrame]:
    """All tables of a nested schema: '' for the records themselves with their scalars, else by schema path."""
    flat = [F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, T.ArrayType | T.StructType | T.MapType)]
    root = df.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("~")).alias("label"), F.lit(None).cast("string").alias("parent_label"), *flat)
    return {"": root} | {p: flat_table(df, id_col, p) for p in schema_paths(df)}


@dataclass(frozen=True)
class Link:
    """A reference inside a record: from a field of the nodes at `source` (path of an array; the field is the
    element itself where `field` is empty) to the node at array `target` whose `key` it equals."""

    kind: str
    source: str
    field: str
    target: str
    key: str


def _find(keys: Column, wanted: Column) -> Column:
    """Position of the first target with that key, -1 if there is none, null if the target array or the key is
    null. The position that equals the key is tried first: where arrays are in order the rest isn't read."""
    there = F.get(keys, wanted) == wanted
    elsewhere = F.coalesce(F.array_position(keys, wanted), F.lit(0).cast("bigint")).cast("int") - 1
    return F.when(keys.isNull() | wanted.isNull(), F.lit(None).cast("int")).when(there, wanted.cast("int")).otherwise(elsewhere)


def links(df: DataFrame, id_col: str, link: Link) -> DataFrame:
    """The references of one kind: (record_id, link_kind, label of the source node, child_pos, target_value,
    target_label). target_label is null where no target has that key, and such a link leads nowhere; links of
    records whose target array is null, and null references, are left out, since nothing can be said of them.
    child_pos is the array position of the node that holds the reference. Equal references of one node come
    out once. Labels on both ends are those of `flat_table`."""
    parts = link.source.split(".")
    names = [f.name for f in df.schema.fields]
    ti, si = names.index(link.target), names.index(parts[0])
    t = F.col(f"`{link.target}`")[link.key]  # the keys only: the scan leaves the targets' other fields out
    rid = F.col(f"`{id_col}`")
    label = F.coalesce(rid.cast("string"), F.lit("~"))
    nodes = df.where(t.isNotNull()).select(rid.alias("record_id"), label.alias("__r"), t.alias("__t"), F.posexplode(F.col(f"`{parts[0]}`")[parts[1] if len(parts) == 2 else link.field]).alias("child_pos", "__v"))
    node = F.concat("__r", F.lit(f".{si}."), F.col("child_pos"))
    if len(parts) == 2:
        # One struct for each reference: the search runs before the explode, next to the record's targets.
        found = F.transform(F.array_distinct(F.col("__v")), lambda x: F.struct(x.alias("value"), _find(F.col("__t"), x).alias("at")))
        nodes = nodes.select("record_id", "__r", "child_pos", node.alias("label"), F.explode_outer(found).alias("__f"))  # outer: see README, Arrays
    elif len(parts) == 1:
        v = F.col("__v")
        nodes = nodes.select("record_id", "__r", "child_pos", node.alias("label"), F.struct(v.alias("value"), _find(F.col("__t"), v).alias("at")).alias("__f"))
    else:
        raise ValueError("a link's source lies in an array of the record or in one inside it")
    at = F.col("__f.at")
    return nodes.where(F.col("__f.value").isNotNull()).select(
        "record_id", F.lit(link.kind).alias("link_kind"), "label", "child_pos", F.col("__f.value").alias("target_value"),
        F.when(at >= 0, F.concat("__r", F.lit(f".{ti}."), at)).alias("target_label"),
    )


TRACE_LINKS = (
    Link("action_token", "actions.token_indices", "", "tokens", "token_index"),
    Link("top_action", "top_actions", "action_index", "actions", "action_index"),
    Link("block_action", "candidate_blocks.action_ids", "", "actions", "action_index"),
)


def dangling(df: DataFrame, id_col: str, specs: tuple[Link, ...] = TRACE_LINKS) -> DataFrame:
    """All links that lead nowhere: (record_id, link_kind, label, child_pos, target_value)."""
    out = None
    for s in specs:
        part = links(df, id_col, s).where(F.col("target_label").isNull()).drop("target_label")
        out = part if out is None else out.unionByName(part)
    return out
