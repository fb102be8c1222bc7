"""Every registered query of the core runs on the smallest tables and equals its SQL where it has one."""

import importlib
from collections import defaultdict

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect
from tracewright.operators import spans

MODULES = [importlib.import_module(f"tracewright.plans.{n}") for n in entry.FAMILIES]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.ORACLE.items()}


def steps_tile_the_text(rows, con):
    """Steps are in order, don't overlap, show what stands there, and leave nothing but blanks between them."""
    texts = dict(con.execute("SELECT result_id, response FROM results WHERE response IS NOT NULL").fetchall())
    by = defaultdict(list)
    for r in rows:
        by[r["result_id"]].append((r["pos"], r["char_start"], r["char_end"], r["text"]))
    assert set(by) == {k for k, t in texts.items() if t.strip()}
    for k, own in by.items():
        at, t = 0, texts[k]
        for i, (pos, a, b, shown) in enumerate(sorted(own)):
            assert pos == i and at <= a < b <= len(t) and not t[at:a].strip() and spans.shown(t[a:b]) == shown
            at = b
        assert not t[at:].strip()


def blocks_hold(rows, con):
    """At most six blocks a response, of neighbouring steps that no other block of it has, around a peak of z >= 0.5, by falling z,
    and with the text of the response between their ends."""
    texts = dict(con.execute("SELECT result_id, response FROM results WHERE response IS NOT NULL AND tokens IS NOT NULL").fetchall())
    by = defaultdict(list)
    for r in rows:
        by[r["result_id"]].append(r)
    assert by and set(by) <= set(texts)
    for k, own in by.items():
        own.sort(key=lambda r: r["block_index"])
        used = [i for r in own for i in r["action_ids"]]
        assert [r["block_index"] for r in own] == list(range(len(own))) and len(own) <= 6 and len(set(used)) == len(used)
        for r in own:
            assert r["anchor"] in r["action_ids"] and r["max_z"] >= 0.5 and r["mean_z"] <= r["max_z"] + 1e-9 and len(r["action_ids"]) <= 3
            assert max(r["action_ids"]) - min(r["action_ids"]) == len(r["action_ids"]) - 1
            assert 0 <= r["char_start"] < r["char_end"] <= len(texts[k])
            if r["token_count"]:
                assert r["token_start"] <= r["token_end"]


INVARIANTS = {"micro_action_split": steps_tile_the_text, "span_candidates": blocks_hold}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, con):
    df = QUERIES[name](spark, sf)
    if name in SQL:
        compare(df, con, SQL[name])
    else:
        INVARIANTS[name](df.collect(), con)


def test_sql_has_queries():
    assert set(SQL) <= set(QUERIES) and set(QUERIES) - set(SQL) == set(INVARIANTS)
    assert len(QUERIES) == sum(len(m.QUERIES) for m in MODULES)


def test_entry(spark, sf):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
