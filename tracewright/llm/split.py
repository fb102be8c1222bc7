"""Problem 1: splitting oversized texts at natural boundaries.

Method: byte-range processing. A text is cut into ranges of `range_bytes` bytes, each read with a halo of `halo`
bytes on both sides, so that a boundary mark across a range's edge is seen by the range in which it ends and a
character across it belongs to the range in which it begins. Workers return the characters and boundaries of
their range only (numbers, no text). The boundary tables of one text are stitched in order of the ranges by
prefix sums of the ranges' characters and the stretches' lengths, and pieces come out as offsets.

No worker holds more of a text than one range with its halo. A file (`split_files`) is read by byte offset and never
as a whole; a text in a column is sliced once, in time linear in its length, before its ranges are spread. Given
boundaries (actions) of a long text go through the same tables, as one row for each range. Texts of one range
need no shuffle: one worker finds their boundaries and emits their pieces where they are read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.stats import let

LIMIT, OVERLAP, CHARS_PER_TOKEN = 320, 32, 4
RANGE_BYTES, HALO = 65_536, 64

STRETCH = "array<struct<pos:int,k:int,at:int,size:int,chars:array<int>>>"
BOUNDARIES = "range_no int, n_chars int, ends array<int>"
PIECE_SCHEMA = (
    "id bigint, need string, piece_index int, n_pieces int, token_start int, token_end int, n_tokens int,"
    " char_start int, char_end int, overlap_tokens int, hard_cut boolean"
)


def cut_positions(ends: list[int], limit: int, overlap: int) -> list[tuple[int, int, bool]]:
    """Pieces (start, end, hard) of at most `limit` units over stretches that end at the rising positions
    `ends`: each ends at the last stretch end that fits, or hard at the limit if none lies behind the piece
    before, and begins `overlap` units before the end of the piece before. An end within the first `overlap`
    units is none: the next piece would repeat all of that piece and not `overlap` units of it."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")
    total = ends[-1] if ends else 0
    out: list[tuple[int, int, bool]] = []
    start = 0
    while total:
        if total - start <= limit:
            out.append((start, total, False))
            break
        i = bisect_right(ends, start + limit)
        end = ends[i - 1] if i else 0
        hard = end <= start + overlap
        if hard:
            end = start + limit
        out.append((start, end, hard))
        start = end - overlap
    return out


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Smaller batches: a row's lists are many Python objects."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def _oversized(df: DataFrame, id_col: str, text: str, actions: str, tokens: str, limit: int) -> DataFrame:
    """The texts that may be oversized, with the stretches that are given. Sizes count twice-listed actions twice
    here; the stitched table decides."""
    t, index, begin = F.col(text), F.col(tokens)["token_index"], F.col(tokens)["char_start"]
    a = F.arrays_zip(*(F.col(actions)[f].alias(f) for f in ("action_index", "char_start", "token_count", "token_indices")))
    size = lambda x: F.coalesce(x["token_count"], F.when(x["token_indices"].isNotNull(), F.size(x["token_indices"])), F.lit(0))
    by_lines = F.coalesce(F.size(F.col(actions)["action_index"]), F.lit(0)) <= 0
    rough = F.when(by_lines, F.ceil(F.length(t) / F.lit(float(CHARS_PER_TOKEN))).cast("bigint")).otherwise(
        F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + F.coalesce(size(x), F.lit(0)).cast("bigint"))
    )

    def stretch(x: Column, i: Column, place: Column) -> Column:
        """An action, with where each of its tokens begins; the tokens are in order in nearly all rows."""
        chars = F.transform(x["token_indices"], lambda j: F.when(F.get(place["i"], j) == j, F.get(place["b"], j)))
        return F.struct(
            i.cast("int").alias("pos"), x["action_index"].cast("int").alias("k"), F.coalesce(x["char_start"], F.lit(0)).cast("int").alias("at"),
            F.coalesce(size(x), F.lit(0)).cast("int").alias("size"), chars.alias("chars"),
        )

    # let: the fields' arrays are taken out of the tokens once for a row, not once for every token.
    stretches = let(F.struct(index.alias("i"), begin.alias("b")), lambda p: F.transform(F.filter(a, lambda x: x.isNotNull()), lambda x, i: stretch(x, i, p)))
    return df.where(t.isNotNull() & (rough > limit)).select(
        F.col(id_col).cast("bigint").alias("id"), F.length(t).alias("n_chars"), F.octet_length(t).alias("n_bytes"), by_lines.alias("by_lines"),
        F.when(by_lines, t).alias("text"), F.when(~by_lines, stretches).alias("stretches"),
    )


def _range_of(data: bytes, at: int, start: int, stop: int, found: re.Pattern) -> tuple[int, list[int]]:
    """Characters that begin in the bytes [start, stop), and where, counted from the first of them, marks end. `data` are
    the bytes from `at` on, with a halo."""

    def edge(i: int) -> int:
        while i < len(data) and data[i] & 0xC0 == 0x80:
            i += 1
        return i

    a, b = edge(start - at), edge(stop - at)
    left, own = data[edge(0) : a].decode("utf-8", "replace"), data[a:b].decode("utf-8", "replace")
    right = data[b:].decode("utf-8", "ignore")
    ends = [m.end() - len(left) for m in found.finditer(left + own + right)]
    return len(own), list(dict.fromkeys(e for e in ends if 0 < e <= len(own)))


def _boundaries(mark: str):
    """Worker: (keys, BOUNDARIES) of the ranges of texts, from their bytes or read from their files by offset."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, types = re.compile(mark), [pa.int32(), pa.int32(), pa.list_(pa.int32())]
        for b in batches:
            out = []
            for data, path, at, n, start, stop, no in zip(*(b.column(c).to_pylist() for c in ("slice", "path", "at", "n_slice", "start", "stop", "range_no")), strict=True):
                if path is not None:
                    fs, name = open_fs(path)
                    with fs.open_input_file(name) as f:
                        data = f.read_at(n, at)
                out.append((no, *_range_of(data, at, start, stop, found)))
            cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 3, types, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("__key"), *cols], names=["__key", "range_no", "n_chars", "ends"])

    return work


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, as the executors see it."""
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))


def _ranges(n_bytes: Column, range_bytes: int, halo: int, more) -> Column:
    """An array of structs (range_no, at, n_slice, start, stop and what `more` gives for at and n_slice): the ranges of
    `n_bytes` bytes with their halos. The halo holds at least the rest of a character."""
    halo = max(halo, 3)

    def one(i: Column) -> Column:
        start, stop = i * range_bytes, F.least((i + 1) * range_bytes, n_bytes)
        at = F.greatest(start - halo, F.lit(0).cast("bigint"))
        n = F.least(stop + halo, n_bytes) - at
        return F.struct(i.cast("int").alias("range_no"), at.alias("at"), n.alias("n_slice"), start.alias("start"), stop.alias("stop"), *more(at, n))

    return F.transform(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.ceil(n_bytes / F.lit(float(range_bytes))).cast("bigint"), F.lit(1).cast("bigint")) - 1), one)


def _pieces_of(n_chars: int, stretches: list[tuple], by_lines: bool, limit: int, overlap: int) -> list[tuple]:
    """The pieces of one text from its stretches (k, at, size, chars), which are in any order."""
    unit = CHARS_PER_TOKEN if by_lines else 1
    once = {s[1] if by_lines else s[0]: s for s in reversed(stretches)}
    rows = sorted(once.values(), key=lambda s: (s[1], s[0] if s[0] is not None else -1))
    starts = [s[1] for s in rows]
    if by_lines:
        ends = [*starts[1:], n_chars]
        sizes = [-(-(e - s) // unit) for s, e in zip(starts, ends, strict=True)]
        total = -(-n_chars // unit)
    else:
        sizes, ends, total = [s[2] for s in rows], [], 0
        for x in sizes:
            ends.append(total := total + x)
    if total <= limit:
        return []
    need = "hard_cut" if max(sizes) > limit - overlap else "split"
    ends = sorted(set(ends))
    firsts = [0]
    for x in sizes:
        firsts.append(firsts[-1] + x)

    def char(x: int) -> int:
        """Where unit x begins: a token's own place if it is known, else in proportion."""
        if by_lines:
            return x
        if x <= 0:
            return 0
        if x >= total:
            return n_chars
        j = bisect_right(firsts, x) - 1
        k, (_, at, size, chars) = x - firsts[j], rows[j]
        if k == 0:
            return at
        if chars and k < len(chars) and chars[k] is not None:
            return chars[k]
        end = starts[j + 1] if j + 1 < len(starts) else n_chars
        return at + (end - at) * k // size

    pieces = cut_positions(ends, limit * unit, overlap * unit)
    out, before = [], 0
    for i, (a, b, hard) in enumerate(pieces):
        size = -(-(b - a) // unit)
        out.append((need, i, len(pieces), a // unit, a // unit + size, size, char(a), char(b), -(-(before - a) // unit) if i else 0, hard))
        before = b
    return out


PIECE_TYPES = [pa.string(), *[pa.int32()] * 8, pa.bool_()]
PIECE_NAMES = ["need", "piece_index", "n_pieces", "token_start", "token_end", "n_tokens", "char_start", "char_end", "overlap_tokens", "hard_cut"]


def _batch(ids: list, kind: pa.DataType, name: str, rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(PIECE_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(ids, kind), *(pa.array(c, t) for c, t in zip(cols, PIECE_TYPES, strict=True))], names=[name, *PIECE_NAMES])


def _given(stretches: list[dict]) -> list[tuple]:
    return [(s["k"], s["at"], s["size"], s["chars"]) for s in stretches]


def _near(mark: str, limit: int, overlap: int):
    """Worker: the pieces of texts of one range."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = re.compile(mark)
        for b in _slices(batches):
            ids, rows = [], []
            for i, n, lines, text, given in zip(*(b.column(c).to_pylist() for c in ("id", "n_chars", "by_lines", "text", "stretches")), strict=True):
                if lines:
                    starts = dict.fromkeys([0, *(e for m in found.finditer(text) if 0 < (e := m.end()) < n)])
                    pieces = _pieces_of(n, [(None, p, 0, None) for p in starts], True, limit, overlap)
                else:
                    pieces = _pieces_of(n, _given(given or []), False, limit, overlap)
                ids += [i] * len(pieces)
                rows += pieces
            yield _batch(ids, pa.int64(), "id", rows)

    return work


def _stitched(limit: int, overlap: int, key_type: pa.DataType, key_name: str):
    """Worker: the pieces of texts of several ranges from their boundary tables."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, 16):
            ids, rows = [], []
            for i, n, lines, ranges, given in zip(*(b.column(c).to_pylist() for c in ("id", "n_chars", "by_lines", "ranges", "given")), strict=True):
                if lines:
                    ranges.sort(key=lambda r: r["range_no"])
                    copies = sum(r["range_no"] == 0 for r in ranges)  # a row that is given twice brings each range twice
                    starts, at = {0: None}, 0
                    for r in ranges[::copies]:
                        starts |= dict.fromkeys(at + e for e in r["ends"])
                        at += r["n_chars"]
                    starts.pop(at, None)
                    pieces = _pieces_of(at, [(None, p, 0, None) for p in starts], True, limit, overlap) if at else []
                else:
                    flat = [s for r in given for s in r["stretches"]]
                    copies = sum(s["pos"] == 0 for s in flat)
                    pieces = _pieces_of(n, _given(sorted(flat, key=lambda s: s["pos"])), False, limit, overlap)
                ids += [i] * len(pieces) * copies
                rows += pieces * copies
            yield _batch(ids, key_type, key_name, rows)

    return work


def split_oversized(
    df: DataFrame, id_col: str = "result_id", text: str = "response", actions: str = "actions", tokens: str = "tokens",
    limit: int = LIMIT, overlap: int = OVERLAP, mark: str = r"\n", range_bytes: int = RANGE_BYTES, halo: int = HALO,
) -> DataFrame:
    """Pieces of every text of more than `limit` tokens, as offsets (`PIECE_SCHEMA`; `id_col` keeps its name).

    A text's stretches are its actions, each counted once however often its index is listed, ordered by
    char_start and sized by token_count, else by the number of token_indices, else 0. A text without actions
    (null or empty) is sized at four characters a token and its stretches are the parts that `mark` closes;
    matches of `mark` may have up to `halo` bytes. Pieces have at most `limit` tokens, end where a
    stretch begins if one lies between the end of the piece before and the limit, and repeat the last
    `overlap` tokens of the piece before. `need` is hard_cut if a stretch has more than limit - overlap tokens.

    The result doesn't depend on `range_bytes`. Null texts and texts within the limit give no rows; so does an empty
    table. A row that is given twice comes out twice. A null id is kept as null. Other columns are ignored, whatever
    their names.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")
    rows = _oversized(df.select(id_col, text, actions, tokens), id_col, text, actions, tokens, limit)
    near = rows.where(F.col("n_bytes") <= range_bytes).mapInArrow(_near(mark, limit, overlap), PIECE_SCHEMA)
    # Of longer texts the key holds a hash of all that decides, so that rows with the same id aren't mixed up.
    key = F.struct("id", F.xxhash64("text", "stretches").alias("h"), "n_chars", "by_lines").alias("__key")
    far = rows.where(F.col("n_bytes") > range_bytes).select(key, "n_bytes", "text", "stretches")
    n = F.col("n_bytes").cast("bigint")
    cut = let(F.col("text").cast("binary"), lambda b: _ranges(n, range_bytes, halo, lambda at, k: [F.substring(b, (at + 1).cast("int"), k.cast("int")).alias("slice")]))
    sliced = far.where(F.col("__key.by_lines")).select("__key", F.explode_outer(cut).alias("r")).select("__key", "r.*", F.lit(None).cast("string").alias("path"))
    found = sliced.repartition("__key", "range_no").mapInArrow(_boundaries(mark), f"__key struct<id:bigint,h:bigint,n_chars:int,by_lines:boolean>, {BOUNDARIES}")
    lines = found.groupBy("__key").agg(F.collect_list(F.struct("range_no", "n_chars", "ends")).alias("ranges")).withColumn("given", F.lit(None).cast(f"array<struct<stretches:{STRETCH}>>"))
    # Given boundaries: a row for each range that one begins in.
    listed = far.where(~F.col("__key.by_lines")).select("__key", F.explode("stretches").alias("s"))
    by_range = listed.groupBy("__key", F.floor(F.col("s.at") / range_bytes).alias("range_no")).agg(F.collect_list("s").alias("stretches"))
    given = by_range.groupBy("__key").agg(F.collect_list(F.struct("stretches")).alias("given")).withColumn("ranges", F.lit(None).cast(f"array<struct<{BOUNDARIES.replace(' int', ':int').replace(' array', ':array')}>>"))
    tables = lines.unionByName(given).select("__key.*", "ranges", "given")
    out = near.unionByName(tables.mapInArrow(_stitched(limit, overlap, pa.int64(), "id"), PIECE_SCHEMA))
    return out.withColumnRenamed("id", id_col)


def split_files(files: DataFrame, path: str = "path", limit: int = LIMIT, overlap: int = OVERLAP, mark: str = r"\n", range_bytes: int = RANGE_BYTES * 64, halo: int = HALO) -> DataFrame:
    """Pieces (`PIECE_SCHEMA` with the path for the id) of UTF-8 text files of any size, sized and cut as texts without
    actions are. A row of `files` for each file, in any file system that all executors see. Files are read by byte
    offset, a range with its halo at a time. Null paths and files within the limit give no rows; a path that is listed
    twice comes out twice; a missing file is an error."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for p in b.column(0).to_pylist():
                fs, name = open_fs(p)
                info = fs.get_file_info(name)
                if not info.is_file:
                    raise FileNotFoundError(p)
                out.append(info.size)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.int64())], names=["__key", "n"])

    d = files.select(F.col(path).alias("__key")).where("__key is not null").mapInArrow(sizes, "__key string, n bigint")
    d = d.select("__key", F.explode(_ranges(F.col("n"), range_bytes, halo, lambda at, k: [])).alias("r")).select("__key", F.col("__key").alias("path"), "r.*", F.lit(None).cast("binary").alias("slice"))
    found = d.repartition("__key", "range_no").mapInArrow(_boundaries(mark), f"__key string, {BOUNDARIES}")
    tables = found.groupBy("__key").agg(F.collect_list(F.struct("range_no", "n_chars", "ends")).alias("ranges"))
    tables = tables.select(F.col("__key").alias("id"), F.lit(0).alias("n_chars"), F.lit(True).alias("by_lines"), "ranges", F.lit(None).cast(f"array<struct<stretches:{STRETCH}>>").alias("given"))
    out = tables.mapInArrow(_stitched(limit, overlap, pa.string(), "id"), PIECE_SCHEMA.replace("id bigint", "id string"))
    return out.withColumnRenamed("id", path)


def with_texts(df: DataFrame, pieces: DataFrame, id_col: str = "result_id", text: str = "response") -> DataFrame:
    """The pieces with their text. Ids must be unique in df."""
    cut = F.expr("substring(__t, char_start + 1, char_end - char_start)")
    return pieces.join(df.select(id_col, F.col(text).alias("__t")), id_col).withColumn("text", cut).drop("__t")
