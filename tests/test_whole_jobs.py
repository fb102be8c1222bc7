"""The whole input reaches the operators: nothing is cut or filtered away before the job."""

import statistics

import pytest

from tests.oracle import compare, connect
from tracewright.operators import batches
from tracewright.plans import metrics, shapes, tables


def test_samples_loaded_keeps_whole_questions(spark, sf):
    assert "left(" not in tables.ORACLE["samples_loaded"]
    compare(tables.samples_loaded(spark, sf), connect(sf), tables.ORACLE["samples_loaded"])


def test_samples_loaded_by_hand(spark, tmp_path):
    long = "why " * 50 + "so?"
    rows = [(1, long, "web", "a"), (2, " " * 90 + "late start", None, None), (3, " \n" * 60, "web", "b"), (4, None, "web", "c")]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string, discipline string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["sample_id"]: r["question"] for r in tables.samples_loaded(spark, str(tmp_path)).collect()}
    assert got == {"sample-000000": long, "sample-000001": "late start"}


def test_left_pad_collate_keeps_whole_lists(spark, sf):
    compare(shapes.left_pad_collate(spark, sf), connect(sf), shapes.ORACLE["left_pad_collate"])


def test_collate_pads_to_the_batch(spark):
    rows = [(1, 0, [5] * 90), (2, 0, [6, 7]), (3, 1, [8]), (4, 1, []), (5, 2, [])]
    d = spark.createDataFrame(rows, "k bigint, batch int, ids array<int>")
    got = {r["k"]: (r["input_ids"], r["mask"], r["position_ids"]) for r in batches.collate_left(d, "ids", 0, "batch").collect()}
    assert got == {1: ([5] * 90, [1] * 90, list(range(90))), 2: ([0] * 88 + [6, 7], [0] * 88 + [1, 1], [0] * 89 + [1]), 3: ([8], [1], [0]), 4: ([0], [0], [0]), 5: ([], [], [])}


def test_left_pad_collate_in_batches(spark, tmp_path):
    spark.range(600).selectExpr("id as result_id", "transform(sequence(1, cast(id + 1 as int)), x -> 9) as generated_token_ids").write.parquet(f"{tmp_path}/results.parquet")
    compare(shapes.left_pad_collate(spark, str(tmp_path)), connect(str(tmp_path)), shapes.ORACLE["left_pad_collate"])


def test_every_customer_has_a_path(spark, sf):
    got = [r["path"] for r in metrics._paths(spark, sf).collect()]
    keys = [k for (k,) in connect(sf).execute("SELECT c_custkey FROM customer").fetchall()]
    assert sorted(got) == sorted(f"/run/{'global_step_' if k % 7 else 'tmp_'}{k}" for k in keys)


@pytest.mark.parametrize("name", ["checkpoint_retention", "latest_checkpoint"])
def test_checkpoints_of_all_rows(name, spark, sf):
    compare(metrics.QUERIES[name](spark, sf), connect(sf), metrics.ORACLE[name])


def test_all_estimators_come_out(spark, sf):
    """As the registered SQL has them; the two that are whitened also folded by hand."""
    d = shapes.advantage_dispatch(spark, sf)
    compare(d, connect(sf), shapes.ORACLE["advantage_dispatch"])
    raw, want = {"gae": {}, "reinforce_plus_plus": {}}, {}
    for k, tokens in connect(sf).execute("SELECT result_id, list_transform(tokens, lambda t: {'i': t.token_index, 'id': t.token_id}) FROM results WHERE len(tokens) > 0").fetchall():
        rewards, values = [float(t["id"] % 3) for t in tokens], [float(t["i"]) for t in tokens]
        gae, plain, a, g = [], [], 0.0, 0.0
        for i in reversed(range(len(tokens))):
            a = rewards[i] + (values[i + 1] if i + 1 < len(tokens) else 0.0) - values[i] + 0.95 * a
            gae.append(a)
            plain.append(rewards[i] + g)
            g = plain[-1] * (values[i] < 100)
        mask = [int(v < 100) for v in values]
        raw["gae"][k], raw["reinforce_plus_plus"][k] = (gae[::-1], mask), (plain[::-1], mask)
    for kind, rows in raw.items():
        on = [x for a, m in rows.values() for x, k in zip(a, m, strict=True) if k]
        mean, sd = statistics.fmean(on), statistics.stdev(on)
        for k, (a, m) in rows.items():
            white = [(x - mean) / sd * y for x, y in zip(a, m, strict=True)]
            want[(k, kind)] = (white[0], sum(white))
    got = {(r["result_id"], r["estimator"]): (r["first"], r["total"]) for r in d.where("estimator in ('gae', 'reinforce_plus_plus')").collect()}
    assert got.keys() == want.keys() and want
    assert all(got[k] == pytest.approx(want[k], rel=1e-6, abs=1e-4) for k in want)


def test_all_blocks_are_located(spark, sf):
    want = []
    for k, response, tokens, blocks in connect(sf).execute("SELECT result_id, response, list_transform(tokens, lambda t: {'a': t.char_start, 'b': t.char_end}), list_transform(candidate_blocks, lambda b: b.text) FROM results WHERE tokens IS NOT NULL AND response IS NOT NULL").fetchall():
        for i, q in enumerate(blocks or [None]):
            p = response.find(q) if q else -1
            hit = [n for n, t in enumerate(tokens) if p >= 0 and t["b"] > p and t["a"] < p + len(q)]
            want.append((k, i if blocks else None, p, p + len(q) if p >= 0 else -1, hit[0] if hit else -1, hit[-1] + 1 if hit else -1))
    got = [tuple(r) for r in shapes.attribution_spans(spark, sf).collect()]
    assert max(w[1] or 0 for w in want) > 0
    assert sorted(got, key=repr) == sorted(want, key=repr)
