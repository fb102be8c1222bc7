"""Every registered training-data query runs on the smallest tables and equals its SQL where it has one."""

import math
from collections import defaultdict

import pytest

from tests.oracle import compare, connect
from tracewright.llm import pack, spam, split, truncation
from tracewright.llm.queries import ORACLE, QUERIES

COLUMNS = {
    "p1_found": [("result_id", "bigint"), ("need", "string")], "p4_found": [("result_id", "bigint")], "p5_found": [("result_id", "bigint"), ("side", "string"), ("defect", "string")],
    "p6_found": [("doc_id", "bigint")], "p7_found": [("source", "string")], "p8_found": [("doc_id", "bigint")],
}


def some(con, sql):
    return con.execute(sql).fetchall()


def pieces_hold(rows, con):
    """Pieces of at most 320 tokens, one behind the other, each repeating the last 32 tokens of the one before."""
    by = defaultdict(list)
    for r in rows:
        by[r["result_id"]].append(r)
    n = dict(some(con, "SELECT result_id, length(response) FROM results"))
    for k, own in by.items():
        own.sort(key=lambda r: r["piece_index"])
        assert len(own) == own[0]["n_pieces"] > 1 and own[0]["char_start"] == 0 and own[-1]["char_end"] == n[k]
        assert all(r["n_tokens"] <= split.LIMIT and r["char_start"] < r["char_end"] for r in own)
        assert all(a["token_end"] - b["token_start"] == b["overlap_tokens"] == split.OVERLAP for a, b in zip(own, own[1:], strict=False))


def scores_hold(rows, con):
    assert len(rows) == some(con, "SELECT count(*) FROM results WHERE error IS NULL AND response IS NOT NULL")[0][0]
    assert all(0 <= r["p_cut"] <= 1 for r in rows) and 0 < sum(r["is_cut"] for r in rows) < len(rows) / 2


def shares_of_cuts_hold(rows, con):
    assert sum(r["n_responses"] for r in rows) == some(con, "SELECT count(*) FROM results WHERE error IS NULL AND response IS NOT NULL")[0][0]
    assert all(r["cut_share"] == r["n_cut"] / r["n_responses"] for r in rows) and len({r["source"] for r in rows}) == len(rows)


def ids_of_answered(rows, con):
    ids = {k for (k,) in some(con, "SELECT result_id FROM results WHERE error IS NULL AND response IS NOT NULL")}
    assert rows and {r["result_id"] for r in rows} <= ids and len({r["result_id"] for r in rows}) == len(rows)


def defects_hold(rows, con):
    """At most one defect a side; all that is null is empty."""
    assert len({(r["result_id"], r["side"]) for r in rows}) == len(rows)
    assert {(r["side"], r["defect"]) for r in rows} <= {("response", d) for d in ("empty", "truncated", "refusal", "copy", "language")} | {("gold_answer", "empty"), ("gold_answer", "copy")}
    empty = {(r["result_id"], r["side"]) for r in rows if r["defect"] == "empty"}
    for side in ("response", "gold_answer"):
        assert {(k, side) for (k,) in some(con, f"SELECT result_id FROM results WHERE error IS NULL AND coalesce(trim({side}), '') = ''")} <= empty


def places_hold(rows, con):
    """Every document comes out whole: its pieces follow each other, sequences hold at most 2,048 tokens and have no gaps."""
    docs, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r["doc_id"]].append((r["token_start"], r["token_end"]))
        if r["sequence_id"] is not None:
            bins[r["sequence_id"]].append((r["sequence_offset"], r["n_tokens"]))
    assert set(docs) == {k for (k,) in some(con, "SELECT doc_id FROM documents")}
    for own in docs.values():
        own.sort()
        assert own[0][0] == 0 and all(a[1] == b[0] for a, b in zip(own, own[1:], strict=False)) and (len(own) == 1 or own[-1][1] > pack.CAPACITY)
    for own in bins.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= pack.CAPACITY


def fill_holds(rows, con):
    (r,) = rows
    assert r["fullest"] <= pack.CAPACITY and r["least_sequences"] <= r["n_sequences"] <= 1.02 * r["least_sequences"] + 1 and abs(r["room_left"] - (1 - r["n_tokens"] / (r["n_sequences"] * pack.CAPACITY))) < 1e-9


def large_documents(rows, con):
    assert all(n > pack.CAPACITY for (n,) in some(con, f"SELECT length(text) FROM documents WHERE doc_id IN ({','.join(str(r['doc_id']) for r in rows) or 'NULL'})"))


def uses_hold(rows, con):
    most = dict(some(con, "SELECT source, max_repeats FROM mix_targets"))
    assert rows and all(math.floor(r["mean_uses"] + 1e-9) <= r["uses"] <= min(most[r["source"]], math.floor(r["mean_uses"]) + 1) for r in rows)
    assert len(rows) == some(con, "SELECT count(*) FROM documents WHERE lower(trim(source)) IN (SELECT lower(trim(source)) FROM mix_targets)")[0][0]


def shares_hold(rows, con):
    assert len(rows) == 10 and math.isclose(sum(r["actual_share"] for r in rows), 1)
    for r in rows:
        assert r["used_tokens"] <= r["max_repeats"] * r["source_tokens"] and r["is_short"] == (r["target_tokens"] > r["max_repeats"] * r["source_tokens"])
        assert r["is_short"] or abs(r["used_tokens"] - r["target_tokens"]) < 6000  # half of the largest document


def short_sources(rows, con):
    assert {r["source"] for r in rows} <= {k for (k,) in some(con, "SELECT source FROM mix_targets")}


def spam_holds(rows, con):
    assert len(rows) == some(con, r"SELECT count(*) FROM documents WHERE regexp_matches(text, '[\pL\pN]')")[0][0]
    assert all(r["distance2"] >= 0 and 0 <= r["listing"] <= 1 and r["is_spam"] == (r["distance2"] > spam.DISTANCE2 and r["towards"] > spam.TOWARDS) for r in rows)


def spam_pages(rows, con):
    assert 0 < len(rows) < 0.2 * some(con, "SELECT count(*) FROM documents")[0][0]


INVARIANTS = {
    "p1_pieces": pieces_hold, "p4_scores": scores_hold, "p4_sources": shares_of_cuts_hold, "p4_found": ids_of_answered, "p5_found": defects_hold, "p6_sequences": places_hold,
    "p6_fill": fill_holds, "p6_found": large_documents, "p7_uses": uses_hold, "p7_shares": shares_hold, "p7_found": short_sources, "p8_scores": spam_holds, "p8_found": spam_pages,
}


def test_every_query_is_checked():
    assert set(QUERIES) == set(ORACLE) | set(INVARIANTS)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf):
    df = QUERIES[name](spark, sf)
    if name in COLUMNS:
        assert df.dtypes == COLUMNS[name]
    if name in ORACLE:
        compare(df, connect(sf), ORACLE[name])
    else:
        INVARIANTS[name](df.collect(), connect(sf))


def test_small_ranges_give_the_same_pieces(spark, sf):
    a, b = QUERIES["p1_ranges"](spark, sf), QUERIES["p1_pieces"](spark, sf)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(a.columns).collect()))


def test_cut_and_found_agree(spark, sf):
    """Every row of problem 4 has a probability at the threshold. Problem 5's truncated responses are these rows and those
    that limits or longer versions show."""
    scores = QUERIES["p4_scores"](spark, sf).collect()
    cut = {r["result_id"] for r in scores if r["is_cut"]}
    assert all(r["p_cut"] >= truncation.THRESHOLD for r in scores if r["is_cut"])
    five = {r["result_id"] for r in QUERIES["p5_found"](spark, sf).where("defect = 'truncated'").collect()}
    assert cut <= five
