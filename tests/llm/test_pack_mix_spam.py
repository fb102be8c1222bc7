import math
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewright.llm import mix, pack, spam
from tracewright.llm.tokens import encoding, token_count


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=40))
def test_first_fit_decreasing(sizes):
    got = pack.first_fit_decreasing(sizes, 40)
    bins = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):  # the plain way, bin by bin
        b = next((k for k, u in enumerate(bins) if u + sizes[i] <= 40), len(bins))
        if b == len(bins):
            bins.append(0)
        assert got[i] == (b, bins[b])
        bins[b] += sizes[i]


def test_pack_places_everything_once(spark):
    rows = [(i, (i * 37) % 90 + 1) for i in range(2000)] + [(5000, 250), (5001, 100), (5002, 200), (5003, 0), (5004, None), (None, 7), (5005, 3), (5005, 3)]
    d = spark.createDataFrame(rows, "doc_id bigint, n int")
    got = pack.pack(d, "doc_id", "n", 2000, capacity=100, group_items=500).collect()
    by = defaultdict(list)
    for r in got:
        if r["sequence_id"]:
            by[r["sequence_id"]].append((r["sequence_offset"], r["n_tokens"]))
    for places in by.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 100
    assert sum(r["n_tokens"] for r in got) == sum(n or 0 for _, n in rows)
    assert {r["piece_index"] for r in got if r["doc_id"] == 5000} == {0, 1, 2} and len([r for r in got if r["doc_id"] == 5005]) == 2
    assert [r["sequence_id"] for r in got if r["doc_id"] in (5003, 5004)] == [None, None]
    assert all(r["n_pieces"] == 1 for r in got if r["doc_id"] in (5001, 1, 2))
    assert len(by) <= 1.03 * sum(n or 0 for _, n in rows) / 100 + 4
    assert pack.pack(d.limit(0), "doc_id", "n", 0).count() == 0


def test_mix(spark):
    docs = [(i, " Big", 100 + i % 50) for i in range(3000)] + [(10_000 + i, "small ", 80) for i in range(40)] + [(20_000, None, 50), (20_001, "other", 50), (20_002, "big", None), (20_003, "BIG", 0)]
    d = spark.createDataFrame(docs, "doc_id bigint, source string, n_tokens int")
    t = spark.createDataFrame([("big", 0.6, 3), ("small", 0.3, 5), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    uses, shares = mix.mix(d, t)
    u, s = uses.collect(), {r["source"]: r for r in shares.collect()}
    assert len(u) == 3042 and max(r["uses"] for r in u if r["source"] == "small") == 5 and s["small"]["is_short"] and s["none"]["is_short"] and not s["big"]["is_short"]
    used = sum(r["n_tokens"] * r["uses"] for r in u if r["source"] == "big")
    assert used == s["big"]["used_tokens"] and abs(used - s["big"]["target_tokens"]) <= 150
    assert sum(r["actual_share"] for r in s.values()) == pytest.approx(1)
    again = {r["doc_id"]: r["uses"] for r in mix.mix(d.repartition(5), t)[0].collect()}
    assert again == {r["doc_id"]: r["uses"] for r in u}
    assert mix.mix(d.limit(0), t)[1].count() == 3 and mix.mix(d.limit(0), t)[0].count() == 0


def expected_uses(sizes, target, most, power):
    """The plain way: the rate by bisection."""
    w = [2 ** (math.floor(math.log2(n) * mix.STEPS) * power / mix.STEPS) for n in sizes]
    lo, hi = 0.0, 1e9
    for _ in range(200):
        c = (lo + hi) / 2
        lo, hi = (c, hi) if sum(n * min(most, c * x) for n, x in zip(sizes, w, strict=True)) < target else (lo, c)
    return [min(most, lo * x) for x in w]


@pytest.mark.parametrize("target_share,most,power", [(0.3, 1, 0.5), (0.7, 1, 1.0), (0.9, 4, 0.5), (0.5, 2, 0.0), (1.0, 1, 0.5)])
def test_mix_inclusion_follows_each_documents_odds(spark, target_share, most, power):
    sizes = [[10, 100, 1000][i % 3] for i in range(6000)]
    d = spark.createDataFrame([(i, "a", n) for i, n in enumerate(sizes)] + [(9000, "b", 10)], "doc_id bigint, source string, n_tokens int")
    t = spark.createDataFrame([("a", target_share, most), ("b", 1 - target_share, 1)], "source string, target_share double, max_repeats int")
    uses, shares = mix.mix(d, t, power=power)
    total = sum(sizes) + 10
    want = expected_uses(sizes, target_share * total, most, power)
    got = {r["doc_id"]: r for r in uses.collect()}
    assert all(abs(got[i]["mean_uses"] - w) < 1e-6 and math.floor(w) <= got[i]["uses"] <= min(most, math.floor(w) + 1) for i, w in enumerate(want))
    for k in range(3):
        own = [i for i in range(6000) if i % 3 == k]
        assert abs(sum(got[i]["uses"] for i in own) - sum(want[i] for i in own)) < 0.04 * len(own)
    a = shares.where("source = 'a'").collect()[0]
    assert abs(a["used_tokens"] - min(target_share * total, most * sum(sizes))) <= 500
    assert a["is_short"] == (target_share * total > most * sum(sizes))


def test_short_sources_come_after_the_sampling(spark):
    """What is short is read off the uses, so the plan holds the ranking."""
    d = spark.createDataFrame([(i, "ab"[i % 2], 10 + i) for i in range(50)], "doc_id bigint, source string, n_tokens int")
    t = spark.createDataFrame([("a", 0.9, 1), ("b", 0.1, 1)], "source string, target_share double, max_repeats int")
    short = mix.mix(d, t)[1].where("is_short").select("source")
    assert "Window" in short._jdf.queryExecution().optimizedPlan().toString() and [r[0] for r in short.collect()] == ["a"]


def test_tokens(spark):
    texts = ["Hello, world", "", None, "<|endoftext|> 边界", "word " * 20_000]
    got = [r["n"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(token_count(F.col("t")).alias("n")).collect()]
    e = encoding("/opt/tokenizers/byte_bpe_50k.tiktoken")
    assert got == [len(e.encode_ordinary(t)) if t else 0 for t in texts]
    assert e.decode(e.encode_ordinary(texts[3])) == texts[3]


PROSE = "When the census roll is removed, the number of households drops within a few steps. This is why the table lists the share for each group, and the rest is left blank. "
SPAM = ["cheap tutor, essay writer, lab report, " * 30, "#essay_writer #cheaptutor #labreport " * 30, "".join(f"https://a{i}.test/cheap-tutor/p?x={i}\n" for i in range(40)), "".join(f'<a href="http://b.test/x{i}/">Cheap Tutor</a> · ' for i in range(40)), "Home > Shop > Cheap Tutor > Essay Writer\n" * 25, "".join(f"Kit X{i} | SKU {i}-D | in stock | tags: tutor, notes, essay\n" for i in range(30)), "作业答案, 考试题库, 论文代写, 免费资料, " * 15]
PLAIN = [PROSE * 5, "\n".join(f"{i}. {'ABCD'[i % 4]}" for i in range(80)) + "\n" + PROSE, "a | 1 | 2\nb | 3 | 4\n" * 20, "import x\nfor i in range(9):\n    print(i * 4)\n" * 15, "Rotor: the part that turns and is held by the frame.\n" * 12, PROSE * 4 + "\nTags: rotor, frame, tutor", PROSE * 3 + "Further reading\n[1] Lecture on the rotor, https://a.test/x\n[2] Lecture on the frame, https://b.test/y", "因此需要从41中减去27，所以结果不变。另外，边界必须满足给定的条件。" * 5]


def share(t):
    return spam.features(t, None)[1][spam.FEATURES.index("listing")]


def test_listing():
    assert all(share(t) > 0.9 for t in SPAM)
    assert all(share(t) < 0.2 for t in PLAIN)
    assert 0.4 < share(PROSE * 2 + "\n" + "cheap tutor, essay writer, " * 12) < 0.6
    assert share("cheap tutor cheap cheap tutor") == 1.0 and share("It is the rotor.") == 0.0  # five words
    assert share("Residue class notes, free residue class, buy residue class, " * 9) > 0.9  # no code
    assert share("".join(f'<a href="http://b.test/{i}">{"tutor " * 80}</a>\n' for i in range(3))) == 1.0  # link texts of any length
    assert spam.features(" \n?", None) is None and spam.features("word", None)[0] == "und"


def test_spam_pages(spark):
    rows = [(i, PROSE * (1 + i % 5) + f"Part {i} is next to the other.", "en") for i in range(150)] + [(1000 + i, t, None) for i, t in enumerate(SPAM)] + [(2000 + i, t, "EN ") for i, t in enumerate(PLAIN)] + [(3000, None, "en"), (3001, "", None), (3002, "x " * 30_000, "und"), (3003, "cheap tutor cheap cheap tutor", "en"), (3004, "It is the rotor.", "en"), (3005, "short", "en")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r["doc_id"] for r in spam.spam_pages(d).where("is_spam").collect()}
    assert {1000 + i for i in range(len(SPAM))} <= got and not {i for i in got if i < 1000 or 2000 <= i < 3000 or i > 3003}
    assert 3003 in got
    assert spam.spam_pages(d.limit(0)).count() == 0


def test_lists_are_no_outliers_where_most_pages_are_lists(spark):
    """Distance is from the language's centre: nothing but distance and direction decides."""
    lists = [(i, "".join(f"Piece X{i}{k} | SKU {k}-D | stock | note, essai\n" for k in range(20 + i % 7)), "fr") for i in range(60)]
    prose = [(1000 + i, PROSE * (1 + i % 5) + f"Part {i} is next to the other.", "en") for i in range(150)] + [(2000, lists[0][1], "en")]
    got = {r["doc_id"]: r for r in spam.spam_pages(spark.createDataFrame(lists + prose, "doc_id bigint, text string, lang string")).collect()}
    assert all(got[i]["listing"] > 0.9 and not got[i]["is_spam"] for i in range(60))
    assert got[2000]["is_spam"] and got[2000]["listing"] == got[0]["listing"]


def test_unknown_languages_are_held_against_all_texts(spark):
    """However many pages without a language there are, they aren't their own measure."""
    rows = [(i, PROSE * (1 + i % 5) + f"Part {i} is next to the other.", "en") for i in range(300)] + [(1000 + i, f"tutor{i % 9}, essay, report, " * 20, None) for i in range(60)]
    got = spam.spam_pages(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).where("is_spam")
    assert {r["doc_id"] for r in got.collect()} == {1000 + i for i in range(60)}
