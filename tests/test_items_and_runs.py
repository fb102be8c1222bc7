"""Prepared records, prompt items, score paths, batches as wholes, runs and streams: edges by hand."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tracewright import registry
from tracewright.functions import arrays
from tracewright.functions import text as tx
from tracewright.operators import advantages, batches, credit, groups, items, spans
from tracewright.operators import run_metrics as rm
from tracewright.plans.records import _encode
from tracewright.sources import files
from tracewright.streaming import jobs


def test_scan_is_the_plain_fold(spark):
    sizes = [0, 1, arrays.CHUNK - 1, arrays.CHUNK, arrays.CHUNK + 1, 5 * arrays.CHUNK + 3]
    d = spark.createDataFrame([(n, [(i * 7) % 5 for i in range(n)]) for n in sizes] + [(-1, None)], "n int, a array<int>")
    got = {r["n"]: r for r in d.select("n", "a", arrays.prefix_offsets(F.col("a")).alias("s"), arrays.position_ids(F.col("a")).alias("p")).collect()}
    for n in sizes:
        a, at, want = got[n]["a"], 0, []
        for x in a:
            want.append(at)
            at += x
        assert got[n]["s"] == want and len(got[n]["p"]) == n
    assert got[-1]["s"] is None and got[-1]["p"] is None


def test_long_responses(spark):
    """200,000 tokens in a row: copying the result for each element would move 160 GB."""
    d = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(200_000)), lambda x: F.lit(1.0)).alias("r"))
    g = d.select(arrays.discounted_returns(F.col("r"), F.transform("r", lambda x: F.lit(1)), 1.0).alias("g")).select(F.size("g").alias("n"), F.get("g", F.lit(0)).alias("first")).first()
    assert g["n"] == 200_000 and g["first"] == 200_000.0


def test_whiten_arrays(spark):
    d = spark.createDataFrame([(1, [1.0, 2.0, 9.0], [1, 1, 0]), (2, [3.0], [1]), (3, None, None)], "k int, v array<double>, m array<int>")
    got = {r["k"]: r["v"] for r in groups.whiten_arrays(d, "v", "m").collect()}
    assert got[1] == pytest.approx([-1.0, 0.0, 0.0], abs=1e-6) and got[2] == pytest.approx([1.0], abs=1e-6) and got[3] is None
    with pytest.raises(Exception, match="at least two"):  # raised within a subquery
        groups.whiten_arrays(d.where("k = 2"), "v", "m").collect()


def test_criterion_override_checks_the_shape(spark):
    d = spark.createDataFrame([("u", [1.0, 2.0], [1, 0])], f"uid string, {advantages.CRITERION} array<double>, mask array<int>")
    assert advantages.advantages(d, "grpo").first()["advantages"] == [1.0, 0.0]
    bad = spark.createDataFrame([("u", [1.0], [1, 0])], d.schema)
    with pytest.raises(PySparkException, match="length 1 for 2"):
        advantages.advantages(bad, "grpo").collect()


def test_records_with_nulls_and_extra_columns(spark):
    d = spark.createDataFrame([(1, None, None, None, "x"), (2, " q " * 50, "<answer>7</answer>", " ", "x")], "k int, question string, response string, gold string, problem string")
    r = {x["k"]: x for x in items.records(d, ["k"], {"question": "question", "response": "response", "final_answer": "gold"}, ["Intro"], {"question": 10}).collect()}
    assert list(r[1].asDict()) == ["k", *items.RECORD] and r[1]["problem"] == "Intro\n[Question]" and r[1]["answer"] == ""
    assert r[2]["answer"] == "7" and "[truncated]" in r[2]["problem"] and r[2]["discipline"] == ""
    assert items.records(d.limit(0), ["k"], {}, []).count() == 0


def _items(d, **how):
    flat = lambda m: F.array_join(F.transform(m, lambda x: x["content"]), " ")
    return items.chat_items(d, "p", _encode, 8, pad=0, image_pad=7, template=flat, instruct=False, images="images", pads="pads", **how)


def test_chat_items_errors(spark):
    P = items.PAD
    rows = [(1, "a <image>", ["x"], [2]), (2, "a <image>", ["x", "y"], [2, 2]), (3, "a <image>", ["x"], [9]), (4, f"a {P} <image>", ["x"], [1]), (5, "b " * 9, None, None), (6, None, [], None), (7, "a <image>", ["x"], None)]
    d = spark.createDataFrame(rows, "k int, p string, images array<string>, pads array<int>")
    got = {r["k"]: r for r in _items(d).collect()}
    assert {k: r["error"] for k, r in got.items()} == {1: None, 2: "images", 3: "length", 4: "pads", 5: "long", 6: None, 7: "images"}
    one = got[1]
    assert one["input_ids"][-4:] == [6016, 7, 7, 6014] or one["input_ids"].count(7) == 2
    assert len(one["input_ids"]) == 8 and sum(one["mask"]) == 5 and one["position_ids"][-1] == 4 and one["raw_prompt_ids"].count(7) == 1
    assert all(got[2][c] is None for c in ("input_ids", "mask", "position_ids", "raw_prompt_ids"))
    assert got[6]["input_ids"] == [0] * 8
    cut = {r["k"]: r for r in _items(d, truncation="left", target="p", eos=2).collect()}
    assert cut[5]["error"] is None and len(cut[5]["input_ids"]) == 8 and cut[5]["target_ids"][-1] == 2 and cut[6]["target_ids"] == [2]
    assert _items(d.limit(0)).count() == 0


def test_placeholder_items(spark):
    d = spark.createDataFrame([(1, "a <image>", "x.png", "t"), (2, "w " * 9, None, None), (3, None, None, None)], "k int, p string, image string, t string")
    got = {r["k"]: r for r in items.placeholder_items(d, "p", _encode, 8, image_pad=7, answer="t", target="t", eos=2, image="image").collect()}
    assert got[1]["input_ids"][-1] == items.PLACEHOLDER and got[1]["raw_prompt_ids"][-1] == 7 and got[1]["image_paths"] == ["x.png"] and not got[1]["needs_dummy"]
    assert got[2]["error"] == "length" and got[2]["input_ids"] is None and got[3]["target_ids"] == [2] and got[3]["needs_dummy"]


def test_response_info_defaults(spark):
    d = spark.createDataFrame([(0, [5, 6, 7], [1, 1, 0]), (1, None, None)], "i int, ids array<int>, m array<int>")
    got = {r["batch_index"]: r for r in items.response_info(d, "i", "ids", "m").collect()}
    assert got[0]["response_ids"] == [5, 6] and got[0]["uncertainties"] == [0.0, 0.0] and got[0]["uid"] == "sample-0" and got[0]["is_onpolicy"] and got[0]["image_paths"] == []
    assert got[1]["response_length"] == 0 and got[1]["uncertainties"] == [] and got[1]["response_text"] == ""


def test_score_paths(spark):
    d = spark.createDataFrame([("u", True, r"\boxed{4}", "4", 2), ("u", False, r"\boxed{4}", "4", 1), ("v", None, None, "4", 0)], "uid string, is_onpolicy boolean, r string, g string, n int")
    plain = registry.token_rewards(d.drop("uid"), "boxed", "r", "g", "n").collect()
    assert sorted(r["rewards"] for r in plain) == [[], [0.0, 1.0], [1.0]] and {r["path"] for r in plain} == {"rule"}
    off = {r["n"]: r["score"] for r in registry.token_rewards(d, "boxed", "r", "g", "n").collect()}
    assert off == {2: 1.0, 1: 0.0, 0: 0.0}
    assert {r["n"]: r["score"] for r in registry.token_rewards(d, "boxed", "r", "g", "n", score_offpolicy=True).collect()}[1] == 1.0
    assert registry.score(d, "boxed", "r", "g", score_offpolicy=True).agg(F.sum("score")).first()[0] == 2.0


def test_prompt_forms_and_rubrics(spark):
    d = spark.createDataFrame([("  q  ", [("c1", 'say "é"', 3), (None, None, None)]), (None, []), (None, None)], "q string, r array<struct<criterion_id:string,criterion:string,points:int>>")
    rows = d.select(tx.prompt_form(F.col("q"), "boxed").alias("p"), tx.pretty_rubric(F.col("r"), ("criterion_id", "criterion", "points")).alias("r")).collect()
    assert rows[0]["p"].startswith("q You FIRST") and [r["r"] for r in rows[1:]] == ["[]", None]
    want = [{"criterion_id": "c1", "criterion": 'say "é"', "points": 3}, {"criterion_id": None, "criterion": None, "points": None}]
    assert rows[0]["r"] == json.dumps(want, ensure_ascii=False, indent=2)
    with pytest.raises(ValueError, match="unknown form"):
        tx.prompt_form(F.col("q"), "none")


def test_covered_actions_equal_a_full_scan():
    text = "So we add 2 and 3, then check it. Step 2. Therefore it is 5, because 3 + 2 = 5; and that is all there is to it."
    words, at = [], 0
    for w in text.split(" "):
        words.append((at, at + len(w)))
        at += len(w) + 1
    for tokens in (words, [*words[:3], (9, 9), *words[3:]], words[::-1], [*words, (None, 4)], []):
        starts, ends = [a for a, _ in tokens], [b for _, b in tokens]
        got = spans.covered_actions(text, starts, ends, 12, 260, 0)
        for a, b, _, hit in got:
            assert hit == [i for i, (x, y) in enumerate(tokens) if x is not None and y > a and x < b and y > x]
        assert all(len(h) <= 4 for *_, h in spans.covered_actions(text, starts, ends, 12, 260, 4))


def test_batches_as_wholes(spark, tmp_path):
    a = spark.createDataFrame([(1, "x")], "k int, t string")
    d, info = batches.concat([(a, {"s": 1}), (a.select("t", "k"), {"s": 2})])
    assert sorted(r["part"] for r in d.collect()) == [0, 1] and info == {"s": 1}
    for bad in ([], [(a, {}), (a.drop("t"), {})]):
        with pytest.raises(ValueError):
            batches.concat(bad)
    b, _ = batches.from_columns(spark, {"x": [1, 2]}, {"y": ["a", None]})
    assert b.count() == 2 and b.columns == ["ordinal", "x", "y"]
    with pytest.raises(ValueError, match="length"):
        batches.from_columns(spark, {"x": [1]}, {"y": []})
    with pytest.raises(ValueError, match="twice"):
        batches.from_columns(spark, {"x": [1]}, {"x": [1]})
    e = spark.createDataFrame([(1, "é", [1.0, 2.0]), (None, None, None)], "k bigint, t string, v array<double>")
    assert {r["column"]: r["bytes"] for r in batches.byte_size(e).collect()} == {"k": 8, "t": 2, "v": 16}
    files.save_batch(e, {"step": 4}, str(tmp_path / "b"))
    back, info = files.load_batch(spark, str(tmp_path / "b"))
    assert back.count() == 2 and info == {"step": 4}


def test_retention_tracker_and_work(spark, tmp_path):
    p = spark.createDataFrame([(f"/r/global_step_{i}", float(i == 2)) for i in range(1, 11)] + [("/r/tmp_3", 9.0)], "path string, score double")
    got = {r["step"]: r["drop"] for r in rm.retention(p, "path", "score", 5, 2).collect()}
    assert got == {1: "all", 3: "all", 4: "all", 5: "all", 6: "shards", 7: "shards", 8: "shards"}
    assert rm.retention(p, "path", "score").count() == 0
    assert rm.resume_path(spark, str(tmp_path), p, "path") is None
    rm.write_tracker(spark, str(tmp_path), 10)
    assert rm.resume_path(spark, str(tmp_path), p, "path") == "/r/global_step_10"
    rm.write_tracker(spark, str(tmp_path), 11)
    assert rm.resume_path(spark, str(tmp_path), p, "path") is None
    assert rm.model_flops(p, "score", {"model_type": "other"}, 1.0).first()[0] == 0.0


def test_splits_samples_and_addresses(spark, tmp_path):
    (tmp_path / "test.jsonl").write_text('{"q": "a"}\n{"q": "b"}\n')
    assert files.read_split(spark, f"{tmp_path}@test").where("split = 'test'").count() == 2
    with pytest.raises(FileNotFoundError):
        files.read_split(spark, f"{tmp_path}@none")
    d = spark.createDataFrame([(i, f"q{i}") for i in range(9)], "o int, question string").withColumns({c: F.lit(None).cast("string") for c in ("id", "source", "answer")})
    one, two = ({r["sample_id"]: r["place"] for r in files.samples(d, "o", "s", seed=s).collect()} for s in (1, 2))
    assert sorted(one.values()) == list(range(9)) and one != two
    first = {k for k, v in one.items() if v < 3}
    assert first == {r["sample_id"] for r in files.samples(d, "o", "s", most=3, seed=1).collect()}
    u = files.url_images(spark.createDataFrame([("https://a.test/x.png",), ("data:image/png;base64,aa",), ("x.png",), (None,)], "u string"), "u")
    assert [r["reason"] for r in u.collect()] == [None, None, "not an address", "not an address"]


def test_source_named_all_has_its_own_row(spark):
    d = spark.createDataFrame([("all", 1.0), ("b", 3.0), (None, 5.0)], "s string, v double")
    assert sorted((r["source"], r["mean_score"], r["n"]) for r in groups.score_by_source(d, "s", "v").collect()) == [("all", 1.0, 1), ("all", 3.0, 3), ("b", 3.0, 1), ("unknown", 5.0, 1)]


def test_score_effects(spark):
    a = spark.createDataFrame([("u", 0.8, True), ("v", 0.8, False)], "k string, score double, ok boolean")
    b = spark.createDataFrame([("u", 0, 0.5), ("v", 0, 0.5), ("w", 0, 0.5)], "k string, block_index int, score double")
    assert {r["k"]: round(r["score_effect"], 9) for r in credit.score_effects(a, b, ["k"], valid="ok").collect()} == {"u": 0.3, "v": -0.5}


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    one = spark.createDataFrame([(1, "a"), (2, "b")], "k int, t string")
    one.coalesce(1).write.parquet(source)
    stream = lambda: spark.readStream.schema(one.schema).parquet(source)
    assert jobs.run_to_table(spark, stream(), "s", checkpoint=state, out=out).count() == 2
    assert jobs.run_to_table(spark, stream(), "s", checkpoint=state, out=out).count() == 2  # nothing is read again
    spark.createDataFrame([(3, "c")], one.schema).coalesce(1).write.mode("append").parquet(source)
    assert sorted(r["k"] for r in jobs.run_to_table(spark, stream(), "s", checkpoint=state, out=out).collect()) == [1, 2, 3]


def test_batch_that_is_run_again_is_written_once(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, 2.0), (1, 4.0)], "user_id bigint, value double").coalesce(1).write.parquet(source)
    for i in range(2):  # a state that was lost: the same batch comes again
        d = jobs.running_coefficient(spark.readStream.schema("user_id bigint, value double").parquet(source), 3.0, 10, 0.2)
        got = jobs.run_to_table(spark, d, "c", "update", str(tmp_path / f"state{i}"), out).collect()
        assert len(got) == 1 and got[0]["steps"] == 2 and got[0]["batch_id"] == 0


def test_bounded_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(100).repartition(3).write.parquet(source)
    d = spark.readStream.schema("id bigint").option("maxFilesPerTrigger", 1).parquet(source)
    got = jobs.run_to_table(spark, jobs.bounded_stream(d, F.col("id") % 2 == 0, 7), "b").collect()
    assert len(got) == 7 and all(r["id"] % 2 == 0 for r in got)
    with pytest.raises(ValueError):
        jobs.bounded_stream(d, F.lit(True), 0)


def test_sessions(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, h) AS ts, 1L AS user_id FROM VALUES (0), (1), (5) AS t(h)").write.parquet(source)
    got = jobs.session_counts(spark.read.parquet(source)).collect()
    assert sorted(r["n"] for r in got) == [1, 2]
