"""Problem 5: broken prompt and response pairs.

Method: the different responses are sorted by text and compared with their neighbours' common prefixes, which
finds shortened versions of other responses; one that stops where the longer text leaves a word or sentence
open is truncated. Lengths at which a source's responses pile up are its limits; a response at a limit without a
whole ending is truncated. Both decide by themselves. As only a part of the truncated responses has a longer version or
stands at a limit, problem 4's score decides for the others. Copy, refusal and language rules follow. Every rule
reads the whole texts and is one pass without a shuffle; only the different texts are sorted, so that copies of
one text can't make one partition large.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from tracewright.llm import truncation as cut
from tracewright.session import settle

#: Texts are spread over the sort's partitions by this many characters, so what sets the ranges is bounded.
RANGE_KEY = 256
#: Closing characters that don't belong to a text: blanks and dots of omission.
ENDING = " \t\n\r\u00a0\u3000\u200b\u2060\ufeff…"

# Placeholders for "nothing here", compared in lower case without brackets and stops.
PLACEHOLDERS = frozenset(
    "n/a na n.a none null nil nan undefined empty blank missing unknown tbd todo tba no answer no response not available not provided not given"
    " no solution no output to be determined to be done placeholder pending error void keine antwort sin respuesta pas de réponse keine ninguna aucune vacío vide leer 无 空 无答案 没有答案 暂无".split(" ")
) | frozenset(("no answer", "no response", "not available", "not provided", "not given", "no solution", "no output", "to be determined", "to be done", "keine antwort", "sin respuesta", "pas de réponse", "no data", "left blank", "answer here", "your answer here", "insert answer", "insert answer here"))
PLACEHOLDERS -= frozenset("no answer response not available provided given solution output to be determined done antwort sin de pas réponse respuesta error unknown".split())

# How requests are declined, by language. Compared in lower case with plain apostrophes.
REFUSALS = tuple(
    re.compile(p)
    for p in (
        r"\b(?:can't|cannot|can not|won't|will not|not able to|unable to|am not allowed to|not permitted to|must decline to|have to decline to|decline to|rather not|refuse to|not going to|do not allow me to|don't allow me to|not appropriate for me to|inappropriate for me to)\b.{0,30}?\b(?:help|assist|answer|discuss|share|give|provide|solve|complete|comment|do|work|talk|respond|support|produce|offer|continue|fulfil|fulfill|engage|write|reveal|say)\b",
        r"\bsomething i (?:do not|don't|can't|cannot|won't)\b",
        r"\b(?:not|in)\s?(?:be )?appropriate for me\b",
        r"\b(?:pass on this|no comment on this|leave it there|talk about something else|best if we stop|let's stop here|stop here)\b",
        r"\b(?:beyond|outside) my (?:abilities|ability|scope|role|remit)|\bnot something i\b",
        r"\b(?:outside|beyond) (?:what i am|what i'm|the scope of what i)\b",
        r"\b(?:blocked|prohibited|restricted|forbidden|disallowed) (?:by|under) (?:\w+ )?(?:policy|policies|guidelines|rules)\b",
        r"\b(?:would be cheating|don't have an opinion|do not have an opinion|do not have a view|as an ai\b|against my (?:policy|guidelines)|too sensitive for|a matter for a professional|will not produce)\b",
        r"\b(?:lo siento|lamento|me temo|disculpa|disculpe|perdón)\b.{0,30}\bno (?:puedo|me es posible|podré|estoy)\b",
        r"\bno (?:puedo|me es posible|me está permitido|estoy autorizad[oa]|estoy en condiciones|voy a|podré|quiero|debo)\b.{0,40}\b(?:ayudar|ayudarte|responder|contestar|resolver|dar|hablar|comentar|discutir|atender|ofrecer|tratar|opinar)\w*",
        r"\b(?:prefiero no|debo negarme|tengo que rechazar|debo rechazar|debo declinar|abstenerme|me abstengo|me niego)\b",
        r"\b(?:tut mir leid|bedaure|bedauere|leider|entschuldig\w*|verzeih\w*)\b.{0,80}\b(?:nicht|keine?n?|ablehnen|unmöglich)\b",
        r"\b(?:kann|darf|möchte|werde|will)\b.{0,50}\b(?:nicht|keine?n?)\b.{0,40}\b(?:helfen|beantworten|antworten|lösen|geben|sagen|äußern|besprechen|bearbeiten|weiterhelfen|auskunft)\b",
        r"\bmuss ich (?:ablehnen|leider)|\b(?:nicht gestattet|nicht erlaubt|muss ich ablehnen|lehne ich ab|ich lehne|enthalte ich mich|steht mir nicht zu)\b",
        r"\b(?:désolée?|navrée?|regrette|malheureusement)\b.{0,60}\b(?:ne peux|ne puis|ne suis|ne saurais|impossible|pas)\b",
        r"\b(?:je ne (?:peux|puis|suis pas|saurais|souhaite|veux)|il ne m'est pas|je dois refuser|je préfère ne pas|je refuse|il m'est impossible|m'abstenir|je m'abstiens|je décline)\b",
        r"超出.{0,8}(?:能力|范围|权限|职责)|(?:请|建议).{0,4}咨询",
        r"(?:抱歉|对不起|很遗憾|不好意思).{0,12}(?:无法|不能|不便|不会|没法|不予)",
        r"(?:我|本人)?(?:无法|不能|不便|不可以|不会|拒绝|没法)(?:回答|帮助|提供|协助|讨论|解答|完成|处理|满足|给出|透露|就此)",
    )
)
LANGUAGES = {"english": "en", "spanish": "es", "german": "de", "french": "fr", "chinese": "zh"}
# Names of the languages in these languages.
NAMES = {
    "en": ("english", "inglés", "englisch", "anglais", "英语", "英文"), "es": ("spanish", "español", "castellano", "spanisch", "espagnol", "西班牙语"),
    "de": ("german", "alemán", "deutsch", "allemand", "德语", "德文"), "fr": ("french", "francés", "französisch", "français", "法语", "法文"),
    "zh": ("chinese", "mandarin", "chino", "chinesisch", "chinois", "中文", "汉语"),
}
# Frequent short words.
FUNCTION_WORDS = {
    "en": frozenset("the of and to in is that for it with as on at by so we be are this which not from must but only an or if then was let has have what when than how does both more".split()),
    "es": frozenset("el los las del que y es en un una por con para se al lo su como más pero si entonces esto cada no la de está era queda así cuál qué ser otra primero sin según cuando".split()),
    "de": frozenset("der die das und ist nicht ein eine den dem des zu mit auf für von dass sich es wir man noch also wenn dann aus bei im hängt daraus schon jede jeder weil war wie wäre gäbe".split()),
    "fr": frozenset("le les des et est un une du que qui dans pour pas ne sur au ce cela il faut par donc la de si serait car en aux avec plus chaque était y on ou reste dès quelle quel".split()),
}
_ASK = re.compile(
    r"(?:reply|respond|answer|write|solution|solve|explain|language of the answer|responde|contesta|escribe|antworte|schreib\w*|réponds|répondez|rédige\w*|écris|idioma|sprache|langue|语言|回答|作答|书写|写)[^.?!。？！\n]{0,40}?(%s)"
    % "|".join(sorted((n for v in NAMES.values() for n in v), key=len, reverse=True)),
    re.I,
)
_NAME_OF = {n: k for k, v in NAMES.items() for n in v}
_TAG = re.compile(r"</?\w{1,20}>")
_WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_CJK = re.compile(r"[\u3400-\u9fff]")
_QUOTED = re.compile(r"\"[^\"\n]*\"|“[^“”\n]*”|«[^«»\n]*»|「[^「」\n]*」|`[^`\n]*`")
# How a sentence that goes on to argue begins, in the languages of the data.
_GOES_ON = re.compile(r"^[\W_]*(?:here is|here's|let's|let us|let me|first,|firstly|then|therefore|hence|thus|so |consequently|since|it follows|still,|nevertheless|however, we|aquí|primero|entonces|por lo tanto|así que|luego|hier ist|zuerst|also |daraus|daher|folglich|voici|d'abord|donc|ainsi|par conséquent|首先|因此|所以|于是|那么)")
_PARTS = re.compile(r"(?:[^\W\d_]+|\d+(?:[.,]\d+)*)")
_LEAD = re.compile(r"^\W*(?:question|problem statement|problem|task|exercise|q|pregunta|ejercicio|frage|aufgabe|exercice|问题|题目)\W*[:：]\s*", re.I)
_ANSWER_LINE = re.compile(rf"(?:^|\n)[\W_]*(?:{cut.LABELS})\**\s*[:：]\**[ \t]*(?P<v>[^\n]*)", re.I)


@lru_cache(maxsize=1)
def _hidden() -> dict[int, None]:
    """Characters that can't be seen: the categories Cf and Cc but for line breaks and tabs."""
    return {i: None for i in range(sys.maxunicode + 1) if unicodedata.category(chr(i)) in ("Cf", "Cc") and chr(i) not in "\n\t"}


def visible(text: str | None) -> str:
    """The text without blanks at its ends and without characters that can't be seen."""
    return (text or "").translate(_hidden()).strip()


def is_empty(text: str | None) -> bool:
    """Null, blank, invisible, a placeholder, or tags and labels without content."""
    t = visible(text)
    if not t:
        return True
    t = _TAG.sub(" ", t)
    t = re.sub(r"\\(?:boxed|text|mathrm|fbox)\s*\{\s*\}", " ", t)
    t = re.sub(rf"(?im)^[\W_]*(?:{cut.LABELS}|question|problem|q|a)\**\s*[:：]\**\s*$", " ", t)
    t = re.sub(r"```\w*", " ", t).strip()
    if not re.search(r"\w", t):
        return not re.search(r"[^\W_]|[∅∞→√±]", t)
    bare = re.sub(r"^[\W_]+|[\W_]+$", "", t.lower())
    return bare in PLACEHOLDERS or bool(re.fullmatch(r"[\W_]*", bare))


def _tokens(text: str) -> list[str]:
    found = _PARTS.findall(text.lower())
    if _CJK.search(text):
        found = [x for m in found for x in (m if _CJK.search(m) else (m,))]
    return [m.replace(",", "") if m[0].isdigit() else m for m in found]


def is_copy(text: str, question: str | None, prompt: str | None) -> bool:
    """Only the question or the prompt again, once or more often, perhaps with small changes. An answer after the
    question, in an answer line, a box, a tag or a line of its own, makes it no copy."""
    if not question:
        return False
    t = _TAG.sub("\n", visible(text))
    r, q = _tokens(t), _tokens(question)
    if len(r) < 4 or len(q) < 4 or len(r) < 0.75 * len(q):
        return False
    cq = Counter(q)
    if sum((Counter(r) & cq).values()) < 0.75 * len(q):
        return False
    p = _tokens(prompt or "")
    known = Counter(p) | cq
    t = re.sub(rf"(?im)^[\W_]*(?:{cut.LABELS})\**\s*[:：]\**\s*$", " ", t)
    r = _tokens(t)
    cr = Counter(r)
    body = cut._BLANK.sub("", t)
    low_q = "\n" + question.lower()
    for m in _ANSWER_LINE.finditer(body):
        v = re.sub(r"[\W_]+", "", m.group("v"))
        if v and m.group("v").strip().lower() not in low_q and m.group("v").strip().strip("\"'.… ") not in (prompt or ""):
            return False
    if re.search(r"\\boxed\{[^}]*\w", body) and "\\boxed" not in question:
        return False
    times = max(1, round(len(r) / len(q)))
    lead = [len(_tokens(m.group(0))) for m in [_LEAD.match(t)] if m]
    for size, of in ((len(q), cq), (len(p), Counter(p))):
        if not size:
            continue
        n = max(1, round((len(r) - sum(lead)) / size))
        many = Counter({k: v * n for k, v in of.items()})
        same = sum((cr & many).values())
        if same >= 0.8 * max(len(r) - sum(lead), 1) and same >= 0.8 * n * size:
            break
    else:
        many = Counter({k: v * times for k, v in known.items()})
        same = sum((cr & many).values())
        if not (same >= 0.85 * (len(r) - sum(lead)) and sum((cr & cq).values()) >= 0.85 * len(q)):
            return False
    # What stands after the question's last words: a line of its own that isn't in the prompt is an answer.
    last = body.strip().split("\n")[-1].strip()
    if "\n" in body.strip() and len(last) <= 40:
        v = _tokens(last)
        if v and not all(x in known for x in v):
            return False
        if v and len(v) <= 2 and len(last) <= 12 and not _ANSWER_LINE.match(last):
            return False
    return True


def language(text: str | None) -> str | None:
    """The language of most of a text by its letters, or None if there is too little to tell. Quotations and
    formulas don't count."""
    t = _QUOTED.sub(" ", text or "")
    t = re.sub(r"\\[A-Za-z]+(?:\{[^{}]*\})?|</?\w+>|\$[^$]*\$|https?://\S+", " ", t)
    zh = len(_CJK.findall(t))
    low = t.lower().replace("’", "'")
    words = _WORDS.findall(low)
    if zh:
        words = [w for w in words if not _CJK.search(w)]
    latin = sum(map(len, words))
    if zh >= 6 and zh * 3 >= latin:
        return "zh"
    counts = Counter(words)
    score = {k: sum(n for w, n in counts.items() if w in v or ("'" in w and w.split("'")[0] in v)) for k, v in FUNCTION_WORDS.items()}
    score["de"] += sum(low.count(c) for c in "ßäöü") / 4
    score["es"] += sum(low.count(c) for c in "ñ¿¡óíáú") / 4
    score["fr"] += sum(low.count(c) for c in "èàçêœùîâ") / 4 + t.count("’") / 4
    best = sorted(score.items(), key=lambda x: -x[1])
    enough = 3 if len(words) > 4 else max(2, len(words) - 1)  # of a few words nearly all must be function words
    if best[0][1] < enough or best[0][1] < 1.15 * best[1][1]:
        return None
    return best[0][0]


def asked_language(question: str | None) -> str | None:
    """The language a question asks for, else its own."""
    q = question or ""
    found = _ASK.findall(q)
    return _NAME_OF[found[-1].lower()] if found else language(q)


def is_refusal(text: str) -> bool:
    """The text declines to answer and gives nothing else, however long it is: no answer line, no numbers, and no
    sentence besides that goes on to argue."""
    t = _TAG.sub("\n", visible(text)).replace("’", "'").lower().strip()
    if not t or re.search(r"\\boxed|=|\d", t):
        return False
    if any(re.search(r"\w", m.group("v")) for m in _ANSWER_LINE.finditer(t)):
        return False
    if not any(p.search(t) for p in REFUSALS):
        return False
    declines = False
    for s in re.split(r"(?<=[.!?。！？])\s*|\n+", t):
        if any(p.search(s) for p in REFUSALS):
            declines = True
        elif _GOES_ON.search(s):
            return False
    return declines


def shortened(df: DataFrame, text: str) -> DataFrame:
    """(__h, __n, goes_on): hash and length, both without closing blanks and dots of omission, of the different texts that
    are a proper prefix of another; goes_on: the longer text goes on within a word, a sentence or a list item.

    Sorted by text, a text's extensions stand right behind it, so comparing neighbours is enough. The range
    partitions' edges are compared with each other afterwards (two texts for each partition)."""
    key = F.rtrim(F.col(text), F.lit(ENDING))
    d = df.select(key.alias("__text")).where("__text <> ''").distinct()
    d = d.repartitionByRange(F.left("__text", F.lit(RANGE_KEY))).sortWithinPartitions("__text").withColumns({"__h": F.xxhash64("__text"), "__n": F.length("__text")})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, before = TaskContext.get().partitionId(), None, None
        types = [pa.int64(), pa.int32(), pa.bool_(), pa.string(), pa.int32()]
        make = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["__h", "__n", "goes_on", "edge", "part"])
        for b in batches:
            out = []
            for t, h, n in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if before is None:
                    first = (t, h, n)
                elif t.startswith(before[0]):
                    out.append((before[1], before[2], goes_on(before[0], t), None, part))
                before = (t, h, n)
            if out:
                yield make(out)
        if first is not None:
            yield make([(first[1], first[2], None, first[0], 2 * part), (before[1], before[2], None, before[0], 2 * part + 1)])

    found = settle(d.mapInArrow(work, "__h bigint, __n int, goes_on boolean, edge string, part int"))
    w = Window.orderBy("part")  # two rows for each partition
    edges = found.where("edge is not null").withColumn("__next", F.lead("edge").over(w)).where("part % 2 = 1")
    across = edges.where(F.col("__next").startswith(F.col("edge"))).select("__h", "__n", _goes_on("edge", "__next").alias("goes_on"))
    return found.where("edge is null").select("__h", "__n", "goes_on").unionByName(across)


def goes_on(text: str, longer: str) -> bool:
    """Whether `longer`, which begins with `text`, is within a unit where `text` ends."""
    return not cut._whole_here(longer, len(text))


@F.pandas_udf(BooleanType())
def _goes_on(text: pd.Series, longer: pd.Series) -> pd.Series:
    return pd.Series([goes_on(a, b) for a, b in zip(text, longer, strict=True)], dtype="bool")


def is_truncated(response: str | None, gold: str | None, p: float | None, at_limit: bool = False, goes_on: bool = False, threshold: float = cut.THRESHOLD) -> bool:
    """A longer version goes on where the response ends, the response stands at a limit without a whole ending, or problem
    4's probability p is at the threshold; but not if it ends with its whole expected answer. A lone phrase or
    answer line may begin a longer text by chance, so there half the threshold is asked for as well."""
    if not response or cut.ends_with_gold(response, gold):
        return False
    if goes_on:
        lines = cut.lines_of(cut.core_of(response)[0])
        if len(lines) > 1 or cut.kind_of(lines) == "prose":
            return True
        threshold /= 2
    return (at_limit and not has_whole_ending(response, gold)) or (p or 0.0) >= threshold


def has_whole_ending(text: str, gold: str | None) -> bool:
    """One of the usual whole ends, or a short sentence with its stop."""
    if cut.looks_intact(text, gold):
        return True
    core, marked = cut.core_of(text)
    return not marked and cut.kind_of(cut.lines_of(core)) in ("only", "bare") and core.rstrip(cut._CLOSERS)[-1:] in tuple(cut._STOPS)


def defects_of(question: str | None, prompt: str | None, response: str | None, gold: str | None, truncated: bool) -> list[tuple[str, str]]:
    """The defects of one pair, at most one for each side, the first that holds of: empty, copy, refusal, truncated, language."""
    out = []
    if is_empty(response):
        out.append(("response", "empty"))
    elif is_copy(response, question, prompt):
        out.append(("response", "copy"))
    elif is_refusal(response):
        out.append(("response", "refusal"))
    elif truncated:
        out.append(("response", "truncated"))
    else:
        want = asked_language(question)
        have = language(response) if want else None
        if have and have != want:
            out.append(("response", "language"))
    if is_empty(gold):
        out.append(("gold_answer", "empty"))
    elif is_copy(gold, question, prompt):
        out.append(("gold_answer", "copy"))
    return out


def is_cut(question: str | None, prompt: str | None, response: str | None, gold: str | None, p: float | None, threshold: float = cut.THRESHOLD) -> bool:
    """Problem 4's decision: the regression's, but for the exact checks after it, which only take away."""
    if (p or 0.0) < threshold or cut.ends_with_gold(response, gold):
        return False
    return not (is_empty(response) or is_copy(response, question, prompt) or is_refusal(response))


def _scored(df: DataFrame, id_col: str, source: str, sample: int, sample_chars: int) -> tuple[DataFrame, np.ndarray]:
    """df with at_limit, and problem 4's weights."""
    d = df.select(id_col, F.col(source).alias("source"), "question", "prompt", "response", "gold_answer")
    found = settle(cut.limits(d, "source", "response"))
    d = cut.with_limit(d, "source", "response", found)
    return d, cut.model_for(d, "source", "response", "gold_answer", found, sample, sample_chars)


def cut_rows(df: DataFrame, id_col: str = "result_id", source: str = "source", sample: int = cut.SAMPLE, sample_chars: int = cut.SAMPLE_CHARS) -> DataFrame:
    """(id, source, p_cut, is_cut) for every row of df with a response; columns question, prompt, response and
    gold_answer are used. Null responses give no row. The source is as given; compare it as needed."""
    d, w = _scored(df, id_col, source, sample, sample_chars)
    return d.where("response is not null").mapInArrow(_cut_worker(w, id_col), f"`{id_col}` bigint, source string, p_cut double, is_cut boolean")


def _cut_worker(w: np.ndarray, id_col: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = {n: b.column(n).to_pylist() for n in ("question", "prompt", "response", "gold_answer", "at_limit")}
            p = [cut.score(w, t, g, a) for t, g, a in zip(c["response"], c["gold_answer"], c["at_limit"], strict=True)]
            y = [is_cut(q, pr, t, g, x) for q, pr, t, g, x in zip(c["question"], c["prompt"], c["response"], c["gold_answer"], p, strict=True)]
            ids = b.column(id_col)
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), b.column("source"), pa.array(p, pa.float64()), pa.array(y, pa.bool_())], names=[id_col, "source", "p_cut", "is_cut"])

    return work


def broken_pairs(df: DataFrame, id_col: str = "result_id", source: str = "source", sample: int = cut.SAMPLE, sample_chars: int = cut.SAMPLE_CHARS) -> DataFrame:
    """(id, side, defect) for every defective side of every row.

    A null response or gold answer is empty. A null question allows no copy and no language defect, a null
    prompt none by the prompt. Rows given twice come out twice. An empty table gives none. With `sample` 0 problem
    4's score finds nothing, and only longer versions and limits show what is truncated."""
    d, w = _scored(df, id_col, source, sample, sample_chars)
    # Texts are told apart by a 64-bit hash and their length.
    short = settle(shortened(d, "response").where("goes_on").select("__h", "__n").distinct())
    key = F.rtrim("response", F.lit(ENDING))
    j = d.join(cut.small(short), (F.xxhash64(key) == F.col("__h")) & (F.length(key) == F.col("__n")), "left").withColumn("goes_on", F.col("__h").isNotNull()).drop("__h", "__n")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("question", "prompt", "response", "gold_answer", "at_limit", "goes_on")
        for b in batches:
            ids, sides, kinds = [], [], []
            for i, (q, pr, t, g, a, s) in zip(b.column(id_col).to_pylist(), zip(*(b.column(n).to_pylist() for n in names), strict=True), strict=True):
                p = cut.score(w, t, g, a) if t else None
                for side, kind in defects_of(q, pr, t, g, is_truncated(t, g, p, a, s)):
                    ids.append(i), sides.append(side), kinds.append(kind)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sides, pa.string()), pa.array(kinds, pa.string())], names=[id_col, "side", "defect"])

    return j.mapInArrow(work, f"`{id_col}` bigint, side string, defect string")
