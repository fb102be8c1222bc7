"""Edge cases and brute-force checks of the core's operators."""

import math
import re
import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tracewright import registry
from tracewright.functions import arrays, stats
from tracewright.functions import text as tx
from tracewright.operators import batches, credit, groups, nested, rubrics, spans
from tracewright.session import settle
from tracewright.sources import files

# ---- nested records

NESTED = "id bigint, label string, tokens array<struct<token_index:int,text:string>>, actions array<struct<action_index:int,token_indices:array<int>>>"


def test_labels_lead_to_parents(spark):
    rows = [(7, "x", [(0, "a"), (1, "b")], [(0, [0, 9]), (1, None), None]), (8, None, None, [(0, [1])]), (None, "y", [], [])]
    d = spark.createDataFrame(rows, NESTED)
    t = {r["label"]: r for r in nested.flat_table(d, "id", "actions.token_indices").collect()}
    assert {k: v["value"] for k, v in t.items()} == {"7.3.0.1.0": 0, "7.3.0.1.1": 9, "8.3.0.1.0": 1}
    assert t["7.3.0.1.1"]["parent_label"] == "7.3.0"
    actions = nested.flat_table(d, "id", "actions")
    assert {r["label"] for r in actions.collect()} >= {r["parent_label"] for r in t.values()}
    assert actions.where("record_id = 7").count() == 3
    parents = d.select(nested.parent_of(F.lit("7.3.0.1.1")).alias("a"), nested.parent_of(F.lit("7")).alias("b")).first()
    assert (parents["a"], parents["b"]) == ("7.3.0", None)


def test_dangling_links_and_null_targets(spark):
    rows = [(1, "x", [(0, "a"), (2, "b")], [(0, [0, 1, 1, 2, None])]), (2, "x", None, [(0, [5])]), (3, "x", [], [(0, [0])])]
    d = spark.createDataFrame(rows, NESTED)
    got = nested.dangling(d, "id", (nested.TRACE_LINKS[0],)).collect()
    assert sorted((r["record_id"], r["child_pos"], r["target_value"]) for r in got) == [(1, 0, 1), (3, 0, 0)]


def test_nested_clashing_names_and_empty_table(spark):
    d = spark.createDataFrame([(1, [(5, 6)])], "id int, items array<struct<label:int,pos:int>>")
    r = nested.flat_table(d, "id", "items").first()
    assert (r["label"], r["_label"], r["pos"], r["_pos"]) == ("1.1.0", 5, 0, 6)
    assert nested.flat_table(d.limit(0), "id", "items").count() == 0
    assert set(nested.flatten(d, "id")) == {"", "items"}


# ---- array statistics


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-50, 50), max_size=12))
def test_array_statistics(spark, v):
    d = spark.createDataFrame([(v,)], "v array<double>")
    r = d.select(stats.top_r_mean(F.col("v")).alias("t"), stats.median(F.col("v")).alias("m"), stats.mad(F.col("v")).alias("d"), stats.std_pop(F.col("v")).alias("s")).first()
    if not v:
        assert tuple(r) == (0.0, 0.0, 0.0, 0.0)
        return
    k = max(1, math.ceil(math.sqrt(len(v))))
    med = statistics.median(v)
    want = (sum(sorted(v, reverse=True)[:k]) / k, med, statistics.median([abs(x - med) for x in v]), statistics.pstdev(v) if len(v) > 1 else 0.0)
    assert r == pytest.approx(want, abs=1e-9)


def test_statistics_of_nulls(spark):
    d = spark.createDataFrame([(None,), ([None, float("nan")],), ([1.0, None, 3.0],)], "v array<double>")
    got = [r["m"] for r in d.select(stats.median(F.col("v")).alias("m")).collect()]
    assert got == [None, 0.0, 2.0]


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.floats(-3, 3), st.integers(0, 1)), max_size=8))
def test_discounted_returns(spark, steps):
    d = spark.createDataFrame([([a for a, _ in steps], [b for _, b in steps])], "r array<double>, m array<int>")
    got = d.select(arrays.discounted_returns(F.col("r"), F.col("m"), 0.9).alias("g")).first()["g"]
    g, want = 0.0, []
    for r, m in reversed(steps):
        g = r + 0.9 * g
        want.append(g)
        g *= m
    assert got == pytest.approx(want[::-1])


def test_masks_and_padding(spark):
    d = spark.createDataFrame([([5, 9, 9, 1],), ([],), ([1, 2],)], "ids array<int>")
    r = d.select(
        arrays.eos_mask(F.col("ids"), (9,)).alias("e"), arrays.pad_right(F.col("ids"), 3, F.lit(0)).alias("p"), arrays.fit_length(F.col("ids"), 3, F.lit(0), "left").alias("l"),
        arrays.position_ids(F.transform("ids", lambda x: (x > 1).cast("int"))).alias("pos"), arrays.with_eos(F.col("ids"), 9).alias("w"),
    ).collect()
    assert [x["e"] for x in r] == [[1, 1, 0, 0], [], [1, 1]]
    assert [x["p"] for x in r] == [[5, 9, 9], [0, 0, 0], [1, 2, 0]]
    assert [x["l"] for x in r] == [[9, 9, 1], [0, 0, 0], [0, 1, 2]]
    assert [x["pos"] for x in r] == [[0, 1, 2, 2], [], [0, 0]]
    assert [x["w"] for x in r] == [[5, 9, 9, 1, 9], [9], [1, 2, 9]]
    with pytest.raises(PySparkException):
        d.select(arrays.fit_length(F.col("ids"), 3, F.lit(0), "error")).collect()


# ---- groups


def test_group_advantages_edges(spark):
    rows = [(1, 2.0, True), (1, 4.0, True), (1, 9.0, False), (2, 5.0, True), (3, 1.0, False), (None, 1.0, True), (None, 3.0, True)]
    d = spark.createDataFrame(rows, "uid int, s double, on_p boolean")
    got = {(r["uid"], r["s"]): r["advantage"] for r in groups.outcome_advantage(d, "uid", "s", "on_p").collect()}
    assert got[(1, 9.0)] == 1.0 and got[(3, 1.0)] == 1.0
    assert got[(2, 5.0)] == pytest.approx(5.0 / (1 + 1e-6))
    assert got[(1, 4.0)] == pytest.approx(1 / (math.sqrt(2) + 1e-6))
    assert got[(None, 3.0)] == pytest.approx(1 / (math.sqrt(2) + 1e-6))
    same = spark.createDataFrame([(1, 2.0), (1, 2.0)], "uid int, s double")
    assert {r["advantage"] for r in groups.fallback_advantage(same, "uid", "s").collect()} == {0.0}


def test_masked_stats_needs_two(spark):
    d = spark.createDataFrame([(1.0, 1), (5.0, 0)], "v double, m int")
    with pytest.raises(PySparkException):
        groups.masked_stats(d, "v", "m").collect()


# ---- steps of a text


def brute_boundaries(text):
    at = set()
    for p in spans.CUTS:
        for m in re.finditer(p, text):
            if 0 < m.end() < len(text):
                at.add(m.end())
    return at


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="so If then,;. \n1239é，。a", max_size=60))
def test_micro_actions_properties(text):
    got = spans.micro_actions(text, 4, 20)
    assert all(0 <= a < b <= len(text) for a, b, _ in got)
    assert all(x[1] <= y[0] for x, y in zip(got, got[1:], strict=False))
    covered = "".join(text[a:b] for a, b, _ in got)
    assert re.sub(r"\s", "", covered) == re.sub(r"\s", "", text)
    assert {a for a, _, _ in spans.micro_actions(text, 0, 10_000)} <= {0, *range(len(text))}


def test_micro_actions_rules():
    show = lambda t, n=0, m=999: [x for _, _, x in spans.micro_actions(t, n, m)]
    assert show("x=1,000 m, y") == ["x=1,000 m", "y"]
    assert show("x=1,000, y") == ["x=1,000, y"]
    assert show("It is 13. The end") == ["It is", "1", "3. The end"]
    assert show("So, we go") == ["So, we go"]
    assert show("we go. So") == ["we go.", "So"]
    assert show("a long first part, ok, Answer: B", 5) == ["a long first part, ok", "Answer: B"]
    assert show("") == [] and show(" \n ") == []
    assert show("甲是乙，丙是丁。 戊", 0) == ["甲是乙", "丙是丁。", "戊"]
    assert [x for x in show("One thing is here. Two are there.", 40, 20)] == ["One thing is here.", "Two are there."]


def test_split_actions_nulls_and_long_text(spark):
    long = "First we add 2, then we stop. " * 3000
    d = spark.createDataFrame([(1, None), (2, ""), (3, long)], "id int, t string")
    n = {r["id"]: r["n"] for r in d.select("id", F.size(spans.split_actions(F.col("t"))).alias("n")).collect()}
    assert n[1] in (None, -1) and n[2] == 0 and n[3] > 3000


def blocks_by_hand(z, top, most, min_z):
    order = sorted(range(len(z)), key=lambda i: (-z[i], i))
    best = set(order[:top])
    used, out = set(), []
    for i in order:
        left = z[i - 1] if i else -math.inf
        right = z[i + 1] if i + 1 < len(z) else -math.inf
        if i not in best or z[i] < min_z or not (z[i] >= left and z[i] > right):
            continue
        ids = [j for j in (i - 1, i, i + 1) if j == i or j in best]
        if used & set(ids) or len(out) >= most:
            continue
        used |= set(ids)
        out.append((i, ids))
    return out


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-4, 6).map(lambda x: x / 2), max_size=14))
def test_peak_blocks(spark, z):
    acts = [(i, float(v), 10 * i, 10 * i + 5, [i], "t") for i, v in enumerate(z)]
    d = spark.createDataFrame([(acts,)], "a array<struct<action_index:int,z:double,char_start:int,char_end:int,token_indices:array<int>,text:string>>")
    got = d.select(spans.peak_blocks(F.col("a"), 6, 3, 0.5).alias("b")).first()["b"]
    assert [(b["anchor"], b["action_ids"]) for b in got] == blocks_by_hand(z, 6, 3, 0.5)


def test_overlap_rows_long_spans(spark):
    t = spark.createDataFrame([(1, i, 7 * i, 7 * i + 6) for i in range(300)] + [(1, 999, 5, 5)], "k int, token_id int, char_start int, char_end int")
    s = spark.createDataFrame([(1, 0, 0, 2100), (1, 1, 300, 301), (1, 2, 9000, 9100), (2, 3, 0, 50)], "k int, span_id int, char_start int, char_end int")
    got = {(r["span_id"], r["token_id"]) for r in spans.overlap_rows(t, s, ["k"]).collect()}
    want = {(0, i) for i in range(300)} | {(1, i) for i in range(300) if 7 * i + 6 > 300 and 7 * i < 301}
    assert got == want


# ---- texts


def test_text_functions(spark):
    rows = [("<think>a</think><answer>Yes</answer>", "yes"), ("<answer>YES</answer><think>a</think>", "YES"), ("<think>.</think><answer>no</answer>", "no"), (None, None), ("", "")]
    d = spark.createDataFrame(rows, "t string, g string")
    r = d.select(tx.is_strict(F.col("t")).alias("s"), tx.final_label(F.col("t")).alias("l"), tx.yes_no_score(F.col("t"), F.col("g")).alias("y")).collect()
    assert [x["s"] for x in r] == [True, False, False, False, False]
    assert [x["l"] for x in r] == ["YES", "YES", "NO", None, ""] or [x["l"] for x in r][3] in (None, "")
    assert [x["y"] for x in r] == pytest.approx([1.0, 0.0, 0.0, 0.0, 0.0])


def test_normalize_answer(spark):
    given_ = ["x = 1,234", r"\frac12", r"\sqrt2", r"\text{5}\text{ cm}", "$x$ and", "10,5 km", "", None]
    d = spark.createDataFrame([(g,) for g in given_], "t string")
    got = [r["n"] for r in d.select(tx.normalize_answer(F.col("t")).alias("n")).collect()]
    assert got[:3] == ["1234", r"\frac{1}{2}", r"\sqrt{2}"]
    assert got[5] == "105" and got[6] == "" and got[7] is None


def test_intervene(spark):
    d = spark.createDataFrame([("abcdef", 2, 4), ("abc", 2, 9), ("abc", -1, 2), ("abc", None, 2)], "t string, a int, b int")
    got = [r["x"] for r in d.select(tx.intervene(F.col("t"), F.col("a"), F.col("b"), "remove").alias("x")).collect()]
    assert got == ["abef", "abc", "abc", "abc"]


def test_templates():
    with pytest.raises(ValueError, match="unknown placeholders: who"):
        tx.render("{who} is {name}", {"name": F.lit("x")})


def test_expand_images(spark):
    d = spark.createDataFrame([("a<image>b<image>", [1, 2]), ("a<image>", [1, 2])], "p string, n array<int>")
    got = [r["x"] for r in d.select(tx.expand_images(F.col("p"), F.col("n"), pad="P", start="S", end="E").alias("x")).collect()]
    assert got == ["aSPEbSPPE", None]


# ---- rubrics


def test_json_object(spark):
    rows = ['{"a": 1}', '```json\n{"a": 2}\n```', 'so {"a": 3} ok', '[1]', '{"a": ', None, "", "true"]
    d = spark.createDataFrame([(r,) for r in rows], "t string")
    got = [r["j"] for r in d.select(rubrics.json_object(F.col("t")).alias("j")).collect()]
    assert got == ['{"a": 1}', '{"a": 2}', '{"a": 3}', None, None, None, None, None]


def test_check_verdict(spark):
    crit = [("c1", 2), ("c2", 3)]
    good = '{"schema_version": "x.batch_verifier.v2", "answers": [{"judgement": [true, "FALSE"]}, {"answer_index": 2, "judgement": ["true", true], "final_score": 99}]}'
    rows = [(1, good), (2, good.replace("v2", "v1")), (3, good.replace('"FALSE"', '"maybe"')), (4, good.replace('"answer_index": 2', '"answer_index": 1')), (5, good.replace(', "FALSE"', "")), (6, "nothing"), (7, None)]
    d = spark.createDataFrame([(i, p, crit) for i, p in rows], "id int, p string, c array<struct<criterion_id:string,points:int>>")
    got = {r["id"]: r for r in rubrics.check_verdict(d, "p", "c").collect()}
    assert [got[i]["error"] for i in range(1, 8)] == [None, "version", "judgement", "order", "length", "json", "json"]
    assert [a["final_score"] for a in got[1]["answers"]] == [2.0, 5.0]


def test_check_rubric(spark):
    ok = [("k", "Format", "Uses the format", 5), ("k", None, "Names x", 4)]
    rows = [(1, "x.rubric.v1", ok), (2, "x.rubric.v0", ok), (3, "x.rubric.v1", []), (4, "x.rubric.v1", [("k", "Task", "  ", 1)]), (5, "x.rubric.v1", [("k", "Task", "a", 6)]), (6, None, None)]
    d = spark.createDataFrame(rows, "id int, schema_version string, rubrics array<struct<criterion_id:string,category:string,criterion:string,points:int>>")
    got = {r["id"]: r for r in rubrics.check_rubric(d).collect()}
    assert [got[i]["error"] for i in range(1, 7)] == [None, "version", "no criterion", "empty criterion", "points", "version"]
    assert [(c["criterion_id"], c["category"], c["points"]) for c in got[1]["criteria"]] == [("c1", "Format", 1), ("c2", "Task", 4)]
    assert got[1]["total"] == 5


# ---- credit


def credit_by_hand(n, blocks, combined):
    out, any_ = [0.0] * n, False
    for a, b, c in blocks:
        if a < 0 or b < a or a >= n or not c:
            continue
        b = min(b, n - 1)
        any_ = True
        for i in range(a, b + 1):
            out[i] += c / math.sqrt(b - a + 1)
    return out if any_ else [combined] * n


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 8), st.lists(st.tuples(st.integers(-1, 9), st.integers(-1, 12), st.sampled_from([0.0, 1.0, -2.0])), max_size=4))
def test_token_credit(spark, n, bl):
    b = spark.createDataFrame([(1, i, *x) for i, x in enumerate(bl)], "r int, block_index int, token_start int, token_end int, credit double")
    r = spark.createDataFrame([(1, n, 0.5)], "r int, n_tokens int, combined double")
    got = [x["credit"] for x in credit.token_credit(b, r, ["r"]).orderBy("token").collect()]
    assert got == pytest.approx(credit_by_hand(n, bl, 0.5))


# ---- batches


def test_ordinals_and_padding(spark):
    d = spark.range(0, 103).repartition(7).withColumnRenamed("id", "k")
    o = batches.with_ordinal(d, [F.col("k").desc()])
    assert {(r["k"], r["ordinal"]) for r in o.collect()} == {(k, 102 - k) for k in range(103)}
    p = batches.pad_to_divisor(o, "ordinal", 103, 16)
    assert sorted(r["ordinal"] for r in p.collect()) == list(range(112))
    assert batches.unpad(p, "ordinal", 103).count() == 103
    few = batches.with_ordinal(spark.range(0, 3).withColumnRenamed("id", "k"), [F.col("k")])
    got = {r["ordinal"]: r["k"] for r in batches.pad_to_divisor(few, "ordinal", 3, 8).collect()}
    assert got == {i: i % 3 for i in range(8)}
    assert batches.with_ordinal(d.limit(0), [F.col("k")]).count() == 0
    with pytest.raises(ValueError):
        batches.chunks(few, "ordinal", 3, 2)


def test_union_columns_conflict(spark):
    a = spark.createDataFrame([(1, "x", 1), (2, None, 2)], "k int, s string, a int")
    b = spark.createDataFrame([(1, "x", 3), (2, None, 4)], "k int, s string, b int")
    assert batches.union_columns(a, b, "k", ["s"]).count() == 2
    with pytest.raises(PySparkException):
        batches.union_columns(a, b.withColumn("s", F.lit("y")), "k", ["s"]).collect()
    with pytest.raises(ValueError):
        batches.union_info({"a": 1}, {"a": 2})
    assert batches.union_info({"a": 1}, {"a": 1, "b": 2}) == {"a": 1, "b": 2}


def test_train_val_bounds(spark):
    d = spark.range(0, 5).withColumnRenamed("id", "k")
    for n, want in ((-3, 0), (2, 2), (99, 4)):
        assert batches.train_val(d, F.col("k"), n, 5).where("split = 'val'").count() == want


# ---- scorers, files


def test_registry(spark):
    d = spark.createDataFrame([("u", True, r"\boxed{4}", "4"), ("u", False, r"\boxed{4}", "4"), ("u", True, None, "4")], "uid string, is_onpolicy boolean, r string, g string")
    assert sorted(x["score"] for x in registry.score(d, "boxed", "r", "g").collect()) == [0.0, 0.0, 1.0]
    with pytest.raises(ValueError, match="unknown scorer"):
        registry.scorer("none")
    v = registry.rule_verifier(lambda: F.array(F.col("r").isNotNull()))(d)
    assert "true" in v.first()["payload"]


def test_files_round_trip(spark, tmp_path):
    d = spark.createDataFrame([(1, "a\n\"b\"", [1, 2]), (2, None, None)], "id int, t string, a array<int>")
    files.write_jsonl(d, f"{tmp_path}/x.jsonl")
    assert sorted(map(tuple, files.read_records(spark, f"{tmp_path}/x.jsonl", d.schema).collect())) == sorted(map(tuple, d.collect()))
    files.write_csv(d, f"{tmp_path}/x.csv", ["id", "t", "a", "none"])
    got = {r["id"]: r for r in files.read_records(spark, f"{tmp_path}/x.csv").collect()}
    assert got["1"]["t"] == 'a\n"b"' and got["1"]["a"] == "[1,2]" and not got["2"]["t"]
    (tmp_path / "y.json").write_text('[{"id": 1}, {"id": 2}]')
    assert files.read_records(spark, f"{tmp_path}/y.json").count() == 2
    (tmp_path / "bad.jsonl").write_text('{"id": 1}\nno json\n')
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        files.read_records(spark, f"{tmp_path}/bad.jsonl", "id int").collect()
    with pytest.raises(ValueError):
        files.read_records(spark, "x.xml")
    d.write.parquet(f"{tmp_path}/set/train.parquet")
    assert files.read_split(spark, f"{tmp_path}/set").count() == 2
    with pytest.raises(ValueError):
        files.bounded(d, F.lit(True), 0)


def test_write_outputs(spark, sf, tmp_path):
    out = files.write_outputs(spark.read.parquet(f"{sf}/results.parquet"), str(tmp_path))
    s = spark.read.json(out["stats"]).first()
    assert s["records"] > 0 and spark.read.json(out["top_actions"]).count() == s["action_rows"]


def test_images(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"123")
    (tmp_path / "b.png").write_bytes(b"1" * 99)
    (tmp_path / "c.txt").write_bytes(b"1")
    u = files.image_urls(spark, str(tmp_path), 50)
    assert {r["path"][-5:]: r["reason"] for r in u.collect()} == {"a.png": None, "b.png": "size", "c.txt": "type"}
    assert files.image_summary(u).first()["skipped"] == 2


def test_settle_is_written(spark):
    d = settle(spark.range(10))
    assert d.count() == 10 and spark.sparkContext._jsc.sc().getCheckpointDir().isDefined()


def positions_by_hand(segments):
    out, at = ([], [], []), 0
    for n, t, h, w in segments:
        if n:
            for i in range(n):
                for axis in out:
                    axis.append(at + i)
            at += n
        else:
            for a in range(t):
                for b in range(h):
                    for c in range(w):
                        for axis, v in zip(out, (a, b, c), strict=True):
                            axis.append(at + v)
            at += max(t, h, w)
    return out


def test_grid_positions(spark):
    cases = [[(3, 0, 0, 0), (0, 1, 2, 3), (2, 0, 0, 0)], [(0, 2, 2, 2), (0, 1, 1, 4)], []]
    d = spark.createDataFrame([(c,) for c in cases], "s array<struct<n:int,t:int,h:int,w:int>>")
    got = [tuple(r["p"]) for r in d.select(arrays.grid_positions(F.col("s")).alias("p")).collect()]
    assert got == [positions_by_hand(c) for c in cases]
