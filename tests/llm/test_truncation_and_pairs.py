from random import Random

import pytest
import xxhash

from tracewright.llm import pairs, truncation
from tracewright.llm.queries import _answered


@pytest.fixture(scope="module")
def rows(spark, sf):
    return [(r["response"], r["gold_answer"]) for r in _answered(spark, sf.replace("sf0.001", "sf0.01")).where("response is not null").collect()]


def test_held_out_accuracy(rows):
    """Fitted on one half of the intact texts, tried on artificial cuts of the other half."""
    intact = sorted({(t, g or "") for t, g in rows if truncation.looks_intact(t, g) and len(t) > 80})
    r = Random(1)
    r.shuffle(intact)
    half = len(intact) // 2
    w = truncation.fit(*truncation.training_set([(t, g, False, None) for t, g in intact[:half]]))
    hit = n = 0
    for t, g in intact[half:]:
        core = truncation.core_of(t)[0]
        p = r.randrange(len(core) // 3, len(core))
        cases = [(t, 0)] + ([(core[:p] + r.choice(["", " [cut]", "...", "  "]), 1)] if not truncation._whole_here(core, p) else [])
        for text, y in cases:
            n += 1
            said = pairs.is_cut("q", "q", text, g, truncation.score(w, text, g, False))
            hit += said == bool(y)
    assert n > 300 and hit / n > 0.97


def test_ends():
    f = truncation
    assert f.core_of("It is 5... ") == ("It is 5", True) and f.core_of("It is so.") == ("It is so.", False)
    assert f.core_of("a [truncated]\n")[0] == "a" and f.core_of("...") == ("...", False) and f.core_of("") == ("", False)
    assert f.is_open("<think>\na") and not f.is_open("<think>a</think> b") and not f.is_open("")
    assert f.ends_with_gold("Then so.\nAnswer: 21.96", "21.96") and not f.ends_with_gold("Answer: 2", "21.96")
    assert f.ends_with_gold("x\n\\boxed{No}", "No") and not f.ends_with_gold("x\n\\boxed{No", "No") and not f.ends_with_gold("x", None)
    assert f.script_of("因此得到39.") == "cjk" and f.script_of("It is 39.") == "latin" and f.script_of("39.") == "none"
    assert f.features("", None, False) and f.features("\x00" * 9000, None, True)


def test_open_sections_and_number_ends_are_learned(rows):
    texts = sorted({(t, g or "") for t, g in rows if t and truncation.looks_intact(t, g)})
    texts += [(f"这意味着每个样本再增加7个单位。另外，条款必须满足给定的条件。因此需要从{i}.{i % 7}中减去{i * 3}。首先计算边界的值，得到{i}.25。", "7") for i in range(200)]
    w = truncation.fit(*truncation.training_set([(t, g, False, None) for t, g in texts]))
    for text in ("<think>\n1. The bound of 5 is never reached.", "<think>\nSo it is 5.\nAnswer: 5", "因此需要从41中减去278，得到39."):
        assert truncation.score(w, text, "7", False) >= truncation.THRESHOLD
    for text in ("<think>\n1. The bound of 5 is never reached.\n</think>\nAnswer: 5", "因此需要从41中减去278，得到39。", "So the value is 39."):
        assert truncation.score(w, text, "7", False) < truncation.THRESHOLD
    assert truncation.score(truncation.fit([], []), "The bound of", None, True) < 1e-9  # nothing to learn from


def test_limit_feature_is_measured(rows):
    """Where unfinished texts stand at a limit, cuts are made there; where none do, the feature never comes with a cut."""
    texts = sorted({(t, g or "") for t, g in rows if t and len(t) > 300})
    on = truncation.features("The bound of", None, True)
    limit = (set(on) - set(truncation.features("The bound of", None, False))).pop()
    for at, many in ((True, True), (False, False)):
        x, y = truncation.training_set([(t, g, at and not truncation.looks_intact(t, g), 200) for t, g in texts])
        assert any(limit in f for f, c in zip(x, y, strict=True) if c) == many and not any(limit in f for f, c in zip(x, y, strict=True) if not c)


@pytest.mark.parametrize("text", [None, "", " ​\xa0", "N/A", "null", "(no answer)", "<think></think><answer> </answer>", "Answer: \n", "\\boxed{}", "—", "?"])
def test_empty(text):
    assert pairs.is_empty(text)


@pytest.mark.parametrize("text", ["0", "B", "No", "none of the above", "Answer: 3", "<answer>5</answer>", "边界", "cannot be determined", "unknown"])
def test_not_empty(text):
    assert not pairs.is_empty(text)


Q = "The Wenlan survey recorded 73 for the labour contract and 848 for every exchange rate. How many readings exceed 5?"
PROMPT = f"Work through the task below.\n\nTask:\n{Q}"


@pytest.mark.parametrize("text", [Q, Q.upper(), Q.lower().replace(".", ""), "Question: " + Q, f"{Q}\n\n{Q}", Q + "\nAnswer:", f"<think>\n{Q}\n</think>", Q.replace("848", "reversible"), PROMPT])
def test_copy(text):
    assert pairs.is_copy(text, Q, PROMPT)


@pytest.mark.parametrize("text", ["", "B", Q + "\nAnswer: 42", Q + " First we add 2 and 3, which gives 5, and then we compare that with all the others.\nSo it is 5.", "The survey recorded 73.", Q + "\n<answer>5</answer>"])
def test_no_copy(text):
    assert not pairs.is_copy(text, Q, PROMPT) and not pairs.is_copy(text, None, None)


@pytest.mark.parametrize("text", ["I'm sorry, but I can't help with this task.", "<think>\n</think>\nI’d rather not answer that. I hope you understand.", "Lo siento, pero no puedo ayudar con esa solicitud.", "Je dois refuser de traiter cet exercice.", "很抱歉，我无法回答这个问题。", "It would not be appropriate for me to discuss this topic.", "Dazu möchte ich keine Auskunft geben.", "Debo abstenerme de dar una solución a este ejercicio.", "对不起，这个请求超出了我的能力范围，请咨询老师。"])
def test_refusal(text):
    assert pairs.is_refusal(text)


def test_long_refusals():
    long = "I'm sorry, but I can't help with this task. " + "It is part of a live exam and every student must be treated alike. " * 30 + "Please ask a teacher."
    assert len(long) > 2000 and pairs.is_refusal(long)
    late = "Thank you for the question. It is a fine one. I have read it. It is long. I must decline to answer it. " + "Ask a tutor. " * 9
    assert pairs.is_refusal(late)
    assert not pairs.is_refusal(long + "\nHere is the argument anyway.")


@pytest.mark.parametrize("text", ["", "I cannot give an exact value at once, but a bound is enough. So it is 5.\nAnswer: 5", "I'm sorry for the confusion earlier; here is the corrected argument. 3 + 4 = 7.", "The rule cannot hold."])
def test_no_refusal(text):
    assert not pairs.is_refusal(text)


def test_language():
    assert pairs.language("Since the rotor is coupled, we can ignore the capacitor for now and this is the end.") == "en"
    assert pairs.language("Esto significa que cada red aporta 4 unidades más, así que el valor queda en 84.") == "es"
    assert pairs.language("Daraus folgt, dass man 35 von 35 abziehen muss und die Menge nicht leer ist.") == "de"
    assert pairs.language("Par conséquent, il faut retrancher 42 de 70, donc la valeur reste à 98.") == "fr"
    assert pairs.language("因此需要从41中减去27，所以结果不变。") == "zh"
    assert pairs.language("no la es") == "es" and pairs.language("“" + "es la de los " * 400 + "” is what the text of it was, and that is all.") == "en"
    assert pairs.language("B") is None and pairs.language(None) is None
    assert pairs.asked_language(Q + " Reply in Chinese.") == "zh" and pairs.asked_language(Q) == "en"
    assert pairs.asked_language(Q + " (Language of the answer: French)") == "fr"


def test_defects_one_for_each_side():
    assert pairs.defects_of(Q, PROMPT, None, None, False) == [("response", "empty"), ("gold_answer", "empty")]
    assert pairs.defects_of(Q, PROMPT, "It is 5.", "5", False) == []
    assert pairs.defects_of(Q, PROMPT, "It is the", "5", True) == [("response", "truncated")]
    assert pairs.defects_of(None, None, "It is 5.", Q, False) == []


def test_longer_versions_and_limits_decide_by_themselves():
    for evidence in ({"goes_on": True}, {"at_limit": True}):
        assert pairs.is_truncated("First, write the area in terms of", "5", 0.0, **evidence) and not pairs.is_truncated("First, write the area in terms of", "5", 0.0)
    assert not pairs.is_truncated("So it is 5.", "7", 0.0, at_limit=True)  # a whole ending
    assert not pairs.is_truncated("First, it is the\nAnswer: 21.5", "21.5", 1.0, True, True)  # the whole expected answer
    for lone in ("Answer: 33", "17.", "∴ 4", "\\boxed{6}"):  # each begins a longer answer by chance
        assert not pairs.is_truncated(lone, "N/A", 0.1, goes_on=True)
    assert not pairs.is_truncated("Rotor", "7", 0.1, goes_on=True) and pairs.is_truncated("Rotor", "7", 0.3, goes_on=True)
    assert not pairs.is_truncated(None, None, None) and not pairs.is_truncated("", "5", None, True, True)


def test_shortened_equals_brute_force(spark):
    base = "a shared beginning, "
    texts = [base + "x" * i for i in range(30)] + [base + "y", "short", None, base + "x" * 5, "z" * 50, "z" * 49 + "y", "It is so.", "It is so. And it", "It is so.  \n", "It is so. An…", "", " "]
    texts += [base * 30 + f"{i} and {i}" for i in range(40)] + [base * 30 + f"{i} an" for i in range(20)]  # alike far behind the range key
    d = spark.createDataFrame([(t,) for t in texts], "t string").repartition(7)
    plain = {t.rstrip(pairs.ENDING) for t in texts if t and t.rstrip(pairs.ENDING)}
    want = {}
    for t in plain:
        longer = sorted(u for u in plain if u != t and u.startswith(t))
        if longer:
            want[(xxhash.xxh64_intdigest(t.encode(), seed=42), len(t))] = pairs.goes_on(t, longer[0])
    got = {(r["__h"] % (1 << 64), r["__n"]): r["goes_on"] for r in pairs.shortened(d, "t").collect()}
    assert got == want and True in want.values() and False in want.values()
    assert pairs.shortened(d.limit(0), "t").count() == 0


def test_without_the_sort_and_the_limits_rows_are_lost(spark):
    """Ablation: no score (sample 0). Longer versions and limits show what is truncated, whatever the source."""
    whole = [f"The {w} of the rotor follows from the rule for part {i}, and the rest is blank at step {i * i}." for i, w in enumerate(["share", "bound", "pulse"] * 30)]
    cut = [t[: 45 + i % 17] for i, t in enumerate(whole[:20])]
    at = [f"{'ab cd '[i % 5 :]}{i:03d} then we write the result in terms"[:30] for i in range(24)]  # 30 characters: a limit
    rows = [(i, "s", Q, PROMPT, t, "5") for i, t in enumerate(whole)] + [(1000 + i, "s", Q, PROMPT, t, "5") for i, t in enumerate(cut)] + [(2000 + i, "short", Q, PROMPT, t, "5") for i, t in enumerate(at)]
    d = spark.createDataFrame(rows, "result_id bigint, source string, question string, prompt string, response string, gold_answer string")
    got = {r["result_id"] for r in pairs.broken_pairs(d, sample=0).where("defect = 'truncated'").collect()}
    assert {2000 + i for i in range(24)} <= got and len({1000 + i for i in range(20)} & got) >= 18 and not {i for i in got if i < 1000}
    assert pairs.cut_rows(d, sample=0).where("is_cut").count() == 0


def test_tables_with_nulls_and_ties(spark):
    rows = [(1, "s", Q, PROMPT, None, None), (2, None, None, None, "x", ""), (3, "s", Q, PROMPT, "long " * 20_000 + "end.", "5"), (3, "s", Q, PROMPT, "long " * 20_000 + "end.", "5"), (None, "s", Q, PROMPT, "", "5")]
    d = spark.createDataFrame(rows, "result_id bigint, source string, question string, prompt string, response string, gold_answer string")
    got = pairs.broken_pairs(d)
    assert got.where("defect = 'empty'").count() == 4
    assert pairs.broken_pairs(d.limit(0)).count() == 0
    assert pairs.cut_rows(d).count() == 4


def test_limits_ignore_copies(spark):
    rows = [("s", "x" * (100 + i % 37) + str(i)) for i in range(200)] + [("s", (str(i) + "y" * 300)[:300]) for i in range(40)] + [("s", "z" * 200)] * 50
    d = spark.createDataFrame(rows, "source string, response string")
    assert {(r["__s"], r["__len"]) for r in truncation.limits(d, "source", "response").collect()} == {("s", 300)}


def test_the_sample_does_not_depend_on_the_partitioning(spark, sf):
    d = _answered(spark, sf)
    found = truncation.limits(d, "source", "response").cache()
    w = [truncation.model_for(truncation.with_limit(x, "source", "response", found), "source", "response", "gold_answer", found, sample=50) for x in (d, d.repartition(9))]
    assert (w[0] == w[1]).all() and w[0].any()
