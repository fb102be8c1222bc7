from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tracewright.llm import split

SCHEMA = (
    "result_id bigint, response string, actions array<struct<action_index:int,text:string,char_start:int,char_end:int,token_indices:array<int>,token_start:int,token_end:int,token_count:int>>,"
    " tokens array<struct<token_index:int,char_start:int,char_end:int>>"
)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=30), st.integers(4, 50), st.integers(0, 3))
def test_cut_positions(sizes, limit, overlap):
    ends, t = [], 0
    for s in sizes:
        ends.append(t := t + s)
    got = split.cut_positions(ends, limit, overlap)
    assert all(b - a <= limit for a, b, _ in got)
    if not sizes:
        assert got == []
        return
    assert got[0][0] == 0 and got[-1][1] == t
    for (a, b, hard), (c, _, _) in zip(got, got[1:], strict=False):
        assert c == b - overlap > a
        between = [e for e in ends if a + overlap < e <= a + limit]
        assert hard == (not between)  # cut at a boundary whenever there is one
        assert b == (max(between) if between else a + limit)


def line_rows(spark, texts, **how):
    d = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], SCHEMA)
    return split.split_oversized(d, **how)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aé界𝄞\n", min_size=30, max_size=150), min_size=1, max_size=3))
def test_ranges_give_what_one_range_gives(spark, texts):
    a = line_rows(spark, texts, limit=6, overlap=1).collect()
    b = line_rows(spark, texts, limit=6, overlap=1, range_bytes=7, halo=2).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_lines(spark):
    text = "x" * 999 + "\n" + "y" * 999 + "\n" + "z" * 10
    got = sorted((r["char_start"], r["char_end"], r["need"], r["hard_cut"]) for r in line_rows(spark, [text, "short", None, ""]).collect())
    assert got == [(0, 1000, "split", False), (872, 2010, "split", False)]
    long = sorted((r["char_start"], r["char_end"], r["need"], r["hard_cut"]) for r in line_rows(spark, ["x" * 2000]).collect())
    assert long == [(0, 1280, "hard_cut", True), (1152, 2000, "hard_cut", False)]


def test_actions_unordered_repeated_and_without_counts(spark):
    def a(i, n, indices=None, at=None):
        return (i, "", at if at is not None else 10 * i, 10 * i + 9, indices, None, None, n)

    tokens = [(i, 2 * i, 2 * i + 2) for i in range(500)]
    acts = [a(2, 150), a(0, 150), a(1, None, list(range(150, 300)), 300), a(0, 150), a(1, None, list(range(150, 300)), 300)]
    d = spark.createDataFrame([(1, "x" * 900, acts, tokens), (2, "x" * 900, [a(0, 320)], None), (3, "x" * 9000, [], None), (1, "x" * 900, acts, tokens)], SCHEMA)
    got = split.split_oversized(d).collect()
    one = sorted((r["piece_index"], r["n_tokens"], r["need"]) for r in got if r["result_id"] == 1)
    assert one == [(0, 300, "split")] * 2 + [(1, 182, "split")] * 2
    assert not [r for r in got if r["result_id"] == 2] and len([r for r in got if r["result_id"] == 3]) > 5


def test_empty_table_and_texts(spark):
    d = spark.createDataFrame([(i, "word " * 400, None, None) for i in range(2)], SCHEMA)
    p = split.split_oversized(d)
    assert split.split_oversized(d.limit(0)).count() == 0
    t = split.with_texts(d, p).where("result_id = 0").orderBy("piece_index").collect()
    assert all(r["text"] == ("word " * 400)[r["char_start"] : r["char_end"]] for r in t)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 60), st.one_of(st.none(), st.integers(0, 9))), max_size=14), min_size=1, max_size=4))
def test_given_boundaries_go_through_the_same_tables(spark, texts):
    """Ranges of any size give the same pieces of texts with actions, unordered, repeated and of equal place."""
    rows = []
    for i, acts in enumerate(texts):
        first = {}
        acts = [first.setdefault(k, (k, "", at, at, list(range(k)), None, None, n)) for k, at, n in acts]
        rows += [(i, "é" * 70, acts, [(k, 2 * k, 2 * k + 2) for k in range(9)])] * (1 + i % 2)
    d = spark.createDataFrame(rows, SCHEMA)
    want = sorted(map(tuple, split.split_oversized(d, limit=9, overlap=2).collect()))
    for size in (16, 50):
        assert sorted(map(tuple, split.split_oversized(d, limit=9, overlap=2, range_bytes=size).collect())) == want


def test_long_text_in_a_column(spark):
    """20 MB in one row; the slices are made in linear time."""
    d = spark.range(1).selectExpr("1L AS result_id", "repeat('a line of é and 界\n\nanother, somewhat longer, line of the text\n', 330000) AS response", "cast(null AS array<struct<action_index:int,char_start:int,token_indices:array<int>,token_count:int>>) AS actions", "cast(null AS array<struct<token_index:int,char_start:int>>) AS tokens")
    a, b = (split.split_oversized(d, range_bytes=n).selectExpr("count(*) AS n", "max(n_pieces) AS m", "sum(n_tokens) AS t", "max(char_end) AS e", "bit_xor(xxhash64(piece_index, char_start, char_end, hard_cut)) AS h").collect()[0] for n in (1 << 20, 300_001))
    assert a == b and a["n"] == a["m"] > 10_000 and a["e"] == 330_000 * len("a line of é and 界\n\nanother, somewhat longer, line of the text\n")


def test_files_by_offset(spark, tmp_path):
    """A 200 MB file, at two range sizes; never read as a whole."""
    lines = "".join(f"line {i} of é, 界 and 𝄞{'x' * (i * i % 97)}\n" for i in range(20_000))
    times = 200_000_000 // len(lines.encode()) + 1
    big, small = tmp_path / "big.txt", tmp_path / "small.txt"
    with open(big, "w", encoding="utf-8") as f:
        for _ in range(times):
            f.write(lines)
    small.write_text(lines, encoding="utf-8")
    (tmp_path / "empty.txt").write_text("")
    d = spark.createDataFrame([(str(big),), (str(small),), (str(tmp_path / "empty.txt"),), (None,)], "path string")
    sums = ("count(*) AS n", "max(n_pieces) AS m", "max(char_end) AS e", "max(n_tokens) AS t", "bit_xor(xxhash64(piece_index, char_start, char_end, hard_cut)) AS h")
    a, b = (split.split_files(d.where(f"path = '{big}'"), range_bytes=n).selectExpr(*sums).collect()[0] for n in (1 << 22, 9_999_991))
    assert a == b and a["n"] == a["m"] and a["e"] == times * len(lines) and a["t"] <= split.LIMIT
    got = split.split_files(d.where(f"path <> '{big}'"), range_bytes=77_777).drop("path").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, line_rows(spark, [lines]).drop("result_id").collect()))
