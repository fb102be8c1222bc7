"""Problem 6: filling sequences of fixed capacity with texts.

Method: first-fit decreasing in randomised groups. Items get a group by a hash of their id, so groups are of
about `group_items` items at every table size and a hot source or a run of copies spreads over all of them.
Within a group items go in order of falling size into the first sequence with room; a tournament tree over
the sequences' free room finds it in O(log n). Groups are independent, so nothing but (id, size) is shuffled
and the room lost to grouping is at most about one sequence a group.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
GROUP_ITEMS = 8192


class RoomTree:
    """Tournament tree of free room: the first of `n` bins with at least `size` free, in O(log n)."""

    def __init__(self, n: int, capacity: int) -> None:
        self.leaves = 1
        while self.leaves < max(1, n):
            self.leaves *= 2
        self.best = [capacity] * (2 * self.leaves)

    def first_fit(self, size: int) -> int:
        """Puts an item into the first bin with room for it and returns the bin."""
        best, i = self.best, 1
        if best[1] < size:
            raise ValueError("no bin has room")
        while i < self.leaves:
            i *= 2
            if best[i] < size:
                i += 1
        place = i - self.leaves
        best[i] -= size
        i //= 2
        while i:
            a, b = best[2 * i], best[2 * i + 1]
            m = a if a > b else b
            if best[i] == m:
                break
            best[i] = m
            i //= 2
        return place


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset in the bin) for each size, in the order given. Ties keep the order given. Sizes must be
    within 1..capacity."""
    tree = RoomTree(len(sizes), capacity)
    used = [0] * len(sizes)
    out: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        b = tree.first_fit(sizes[i])
        out[i] = (b, used[b])
        used[b] += sizes[i]
    return out


PACKED = "__group bigint, item_id bigint, piece_index int, token_start bigint, token_end bigint, n_tokens int, bin int, bin_offset int"


def _worker(capacity: int):
    def work(t: pa.Table) -> pa.Table:
        t = t.sort_by([("n_tokens", "descending"), ("item_id", "ascending"), ("piece_index", "ascending")])
        places = first_fit_decreasing(t.column("n_tokens").to_pylist(), capacity)
        t = t.append_column("bin", pa.array([b for b, _ in places], pa.int32()))
        t = t.append_column("bin_offset", pa.array([o for _, o in places], pa.int32()))
        return t.select(["__group", "item_id", "piece_index", "token_start", "token_end", "n_tokens", "bin", "bin_offset"])

    return work


def pack(items: DataFrame, id_col: str, size_col: str, n_items: int, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS, seed: int = 17) -> DataFrame:
    """(id, n_pieces, piece_index, token_start, token_end, n_tokens, sequence_id, sequence_offset) for every item.

    An item over the capacity is cut into full pieces, a sequence each, and a rest, which is packed like an
    item; every other item stays whole. Items of null or no size get one row with null sequence and offset.
    `n_items`, about the number of rows, sets the number of groups. Equal rows are separate items. The order
    within equal sizes is by id and piece, so the result doesn't depend on the partitioning unless ids repeat.
    """
    n = F.coalesce(F.col(size_col).cast("bigint"), F.lit(0).cast("bigint"))
    d = items.select(F.col(id_col).cast("bigint").alias("item_id"), F.greatest(n, F.lit(0).cast("bigint")).alias("__n"))
    pieces = F.greatest(F.ceil(F.col("__n") / F.lit(float(capacity))).cast("int"), F.lit(1))
    d = d.withColumn("n_pieces", pieces).withColumn("piece_index", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)))
    start = F.col("piece_index").cast("bigint") * capacity
    d = d.withColumn("token_start", start).withColumn("token_end", F.least(start + capacity, F.col("__n")))
    d = d.withColumn("n_tokens", (F.col("token_end") - F.col("token_start")).cast("int"))
    groups = max(1, -(-n_items // group_items))
    g = F.pmod(F.xxhash64("item_id", "__n", "piece_index", F.lit(seed)), F.lit(groups)).cast("bigint")
    small = d.where((F.col("n_tokens") > 0) & (F.col("n_tokens") < capacity)).select("item_id", "piece_index", "token_start", "token_end", "n_tokens", g.alias("__group"))
    packed = small.groupBy("__group").applyInArrow(_worker(capacity), PACKED)
    seq = F.concat_ws("-", F.lit("g"), F.col("__group"), F.col("bin"))
    last = F.ceil(F.col("token_end") / F.lit(float(capacity))).cast("int")
    a = packed.select(F.col("item_id").alias(id_col), last.alias("n_pieces"), "piece_index", "token_start", "token_end", "n_tokens", seq.alias("sequence_id"), F.col("bin_offset").alias("sequence_offset"))
    full = d.where((F.col("n_tokens") == capacity) | (F.col("n_tokens") == 0))
    own = F.when(F.col("n_tokens") > 0, F.concat_ws("-", F.lit("f"), F.col("item_id"), F.col("piece_index")))
    zero = F.when(F.col("n_tokens") > 0, F.lit(0))
    b = full.select(F.col("item_id").alias(id_col), "n_pieces", "piece_index", "token_start", "token_end", "n_tokens", own.alias("sequence_id"), zero.alias("sequence_offset"))
    return a.unionByName(b)
