"""Problem 8: keyword-stuffed and link-list pages.

Method: every text gets features of density, entropy, repetition and function words; robust centre and scatter
of the features are computed per language over all texts; a text is flagged if its robust Mahalanobis distance
makes it an outlier and if it lies in the spam-directed direction (fewer function words and sentences, more
repetition, links, separators and listing): its part of the distance along that direction must be large itself.
Nothing else decides.

`listing` is a density too: the share of a text's characters that stand in parts that are no sentences, but
repeated keywords, links, menus, product or tag lists. Tables, code, lists of answers and glossaries are
neither. It weighs most in the direction, as the others also rise in reading lists, answer keys and terms that
are repeated in sentences; but it counts from the language's centre, like all features: where most pages are lists,
a list is no outlier.

One pass over the texts in Arrow batches; all that follows reads a few numbers for each text. The centre and
scatter are a row for each language (five, and one over all texts for the others), so they go to the driver.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.session import settle

FEATURES = ("words", "stops", "repeats", "entropy", "links", "separators", "listing")
#: Towards spam, by feature.
DIRECTION = np.array([-1.0, -1.0, 1.0, -1.0, 1.0, 1.0, 4.0])
#: Chi-square of seven degrees of freedom at 0.999.
DISTANCE2 = 24.32
#: Least part of the distance along the spam direction.
TOWARDS = 18.0

# Short frequent words of sentences, by language; words that advertisements use too are left out.
STRONG = {
    "en": frozenset("the a an and to is are was were be been it its that this these those as if then than from or not no but we he she they you i which what when where why how who there here so because since must has have had can may would could should will does did do both every each only more most between within unless whether although however therefore hence thus let also yet into about above below after before under over one two some any all other".split()),
    "es": frozenset("el los las del que y es son en un una por con para se al lo su sus como pero si entonces esto esta cada no la de está era fue queda así cuál qué quién ser otra otro desde sin sobre según cuando más también porque".split()),
    "de": frozenset("der die das und ist sind nicht ein eine einen den dem des zu mit auf für von dass sich es wir man noch also wenn dann aus bei im ins hängt schon jede jeder weil war wie wäre gäbe daraus wird werden durch nach über unter aber oder".split()),
    "fr": frozenset("le les des et est sont une du que qui dans pour ne sur au aux ce cette cela il elle faut par donc la de si serait car en avec plus chaque était y on ou reste dès quelle quel mais se sa son leur comme".split()),
}
_ANY = frozenset().union(*STRONG.values())
_ZH = frozenset("的了是在和不有这那么因从中如果需每再但就一另所以也与及或被把对为之而")
_WORD = re.compile(r"[^\W_]+")
_CJK = re.compile(r"[㐀-鿿]")
_CJK_RUN = re.compile(r"[㐀-鿿]+")
_LINK = re.compile(r"<a\s[^<>]*>[^<]*</a>|\[[^\[\]\n]*\]\([^()\s]*\)|(?:https?://|www\.)[^\s<>\"]+|(?<![\w@.-])[\w-]+(?:\.[\w-]+)+/[^\s<>\"]*|#\w+", re.I)
_TAG = re.compile(r"</?[a-z][^<>\n]*>", re.I)
_BREAK = re.compile(r"<br\s*/?>|</?(?:p|li|div|tr|ul|ol|h\d)\b[^<>]*>", re.I)
# Signs that end sentences and signs that part the items of lists.
_STOPS = (". ", "! ", "? ", ".\n", "!\n", "?\n", "。", "！", "？")
_SEPARATORS = ("|", "»", "›", ">", ",", ";", "#", "/", "·", "•", "::", "* ", "*\n")
_SENTENCES = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])")
_CODE = re.compile(r"^\s*(?:import|from|def|return|while|var|let|const|function)\s|\bselect\b.*\bfrom\b|\bclass\s+\w+\s*[:({]|\bfor\s+\w+\s+in\s+[\w.]+(?:\(|:)|\bprint\(|[{}]\s*$|\w+\(.*\)|\s=\s|\+=|\w\[\w*\]")
_FIELDS = re.compile(r"\||»|›|::| > | / | · ")
LONG = 240


def _plain(text: str) -> str:
    return html.unescape(text) if "&" in text else text


def language_key(lang: str | None, words: Counter, cjk: int, n: int) -> str:
    k = (lang or "").strip().lower()[:2]
    if k in STRONG or k == "zh":
        return k
    if cjk > n:
        return "zh"
    score = sorted(((sum(words[w] for w in v), k) for k, v in STRONG.items()), reverse=True)
    return score[0][1] if score[0][0] >= 3 and score[0][0] > score[1][0] else "und"


def _has_links(text: str) -> bool:
    return "/" in text or "#" in text or "www." in text.lower()


def features(text: str, lang: str | None) -> tuple[str, list[float]] | None:
    """Language key and the FEATURES; None for texts without a word."""
    plain = _plain(text)
    low = plain.lower()
    parts = [(p, _WORD.findall(p)) for p in _parts(low)]
    n = sum(len(w) for _, w in parts)
    if not n:
        return None
    cjk = len(_CJK.findall(low)) if _CJK.search(low) else 0
    size = max(n, cjk // 2)
    words = Counter(chain.from_iterable(w for _, w in parts))
    strong = sum(words[w] for w in _ANY & words.keys())
    if cjk:
        strong += sum(c in _ZH for run in _CJK_RUN.findall(low) for c in run)
    total = n + cjk - (sum(words[w] for w in words if _CJK.match(w)) if cjk else 0)
    hot = {w for w, c in words.items() if c >= 3}
    repeats = sum(words[w] for w in hot - _ANY if len(w) > 2)
    entropy = -sum(k * c / n * math.log2(c / n) for c, k in Counter(words.values()).items())
    links = sum(m.end() - m.start() for m in _LINK.finditer(text)) if _has_links(text) else 0
    stops = sum(map(low.count, _STOPS)) + low.endswith((".", "!", "?"))
    f = [
        strong / max(1, total), stops / size, repeats / n, entropy / math.log2(max(n, 2)),
        links / len(text), sum(map(low.count, _SEPARATORS)) / size, listing(parts, words, hot),
    ]
    return language_key(lang, words, cjk, n), f


def _parts(text: str) -> Iterator[str]:
    """Lines; long ones by sentence; what is still long in runs of a dozen words."""
    for line in (_BREAK.sub("\n", text) if "<" in text else text).split("\n"):
        line = line.strip()
        if len(line) <= LONG:
            if line:
                yield line
            continue
        for s in _SENTENCES.split(line):
            if len(s) <= LONG:
                if s.strip():
                    yield s
            else:
                w = s.split()
                for i in range(0, len(w), 12):
                    yield " ".join(w[i : i + 12])


def spam_part(part: str, w: list[str], words: Counter, hot: set[str]) -> bool | None:
    """True: keywords, links, menu, product or tag list. False: a sentence. None: neither. `part` is in lower case and has
    the words `w`; `words` are the counts of the whole text, `hot` its words that stand there three times."""
    linked, rest = 0, part
    if _has_links(part):
        found = [m.span() for m in _LINK.finditer(part)]
        linked = sum(b - a for a, b in found)
        for a, b in reversed(found):
            rest = rest[:a] + " " + rest[b:]
    if "<" in rest:
        rest = _TAG.sub(" ", rest)
    if rest is not part:
        w = _WORD.findall(rest)
    strong = sum(map(_ANY.__contains__, w))
    if linked * 2.5 >= len(part):
        return None if strong >= 2 and strong * 4 >= len(w) else True
    if not w:
        return None
    if not rest.isascii() and (runs := _CJK_RUN.findall(rest)):
        cjk, longest = sum(map(len, runs)), max(map(len, runs))
        if sum(map(_ZH.__contains__, "".join(runs))) * 14 >= cjk and longest > 6:
            return False
        if longest <= 8:
            return True if sum(words[r] for r in runs) >= 3 * len(runs) else None
        return False
    if strong and strong * 12 >= len(w):
        return False
    numbers = sum(x.isdigit() or len(x) == 1 for x in w)
    if numbers * 2 > len(w) or (_CODE.search(rest) and not re.search(r"\bsku\b", rest)):
        return None
    long = [x for x in w if len(x) > 2 and not x.isdigit()]
    if not long:
        return None
    if sum(map(hot.__contains__, long)) * 2 >= len(long):
        return True
    return True if len(_FIELDS.findall(rest)) >= 2 else None


def listing(parts: list[tuple[str, list[str]]], words: Counter, hot: set[str]) -> float:
    """Share of a text's characters that stand in spam parts."""
    spam = total = 0
    for p, w in parts:
        total += len(p)
        if spam_part(p, w, words, hot):
            spam += len(p)
    return spam / total if total else 0.0


MEASURED = "id bigint, lang string, f array<double>"


def _measure(id_col: str, text: str, lang: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys, fs = [], [], []
            for i, t, g in zip(b.column(id_col).to_pylist(), b.column(text).to_pylist(), b.column(lang).to_pylist(), strict=True):
                if t and (m := features(t, g)):
                    ids.append(i), keys.append(m[0]), fs.append(m[1])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.string()), pa.array(fs, pa.list_(pa.float64()))], names=["id", "lang", "f"])

    return work


def measure(df: DataFrame, id_col: str, text: str, lang: str) -> DataFrame:
    return df.select(F.col(id_col).cast("bigint").alias(id_col), text, lang).mapInArrow(_measure(id_col, text, lang), MEASURED)


FLOOR = np.array([0.04, 0.02, 0.08, 0.04, 0.02, 0.08, 0.04])


def robust_models(measured: DataFrame, least: int = 40) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By language key: medians, scales (quartile range / 1.349, with a floor) and inverse of the robust scatter, which
    is that of the scaled features clipped at 2.5. Over all texts; '*' is over all languages, and texts of languages
    of fewer than `least` texts or of no known language use it."""
    k = len(FEATURES)
    both = measured.select("lang", "f").unionByName(measured.select(F.lit("*").alias("lang"), "f"))
    quart = [F.percentile_approx(F.col("f")[i], [0.25, 0.5, 0.75], 2000).alias(f"q{i}") for i in range(k)]
    first = both.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *quart).collect()
    centre = {r["lang"]: (np.array([r[f"q{i}"][1] for i in range(k)]), np.maximum(np.array([(r[f"q{i}"][2] - r[f"q{i}"][0]) / 1.349 for i in range(k)]), FLOOR)) for r in first if r["lang"] == "*" or (r["lang"] != "und" and r["n"] >= least)}
    if not centre:
        return {}
    z = []
    for i in range(k):
        m = F.create_map(*(F.lit(x) for key, (a, _) in centre.items() for x in (key, float(a[i]))))
        s = F.create_map(*(F.lit(x) for key, (_, b) in centre.items() for x in (key, float(b[i]))))
        z.append(F.greatest(F.least((F.col("f")[i] - m[F.col("lang")]) / s[F.col("lang")], F.lit(2.5)), F.lit(-2.5)).alias(f"z{i}"))
    scaled = both.where(F.col("lang").isin(list(centre))).select("lang", *z)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    second = scaled.groupBy("lang").agg(*(F.avg(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"c{i}_{j}") for i, j in pairs)).collect()
    out = {}
    for r in second:
        c = np.zeros((k, k))
        for i, j in pairs:
            c[i, j] = c[j, i] = r[f"c{i}_{j}"]
        c += 0.15 * np.eye(k)
        out[r["lang"]] = (*centre[r["lang"]], np.linalg.inv(c))
    return out


def outliers(measured: DataFrame, models: dict, distance2: float = DISTANCE2, towards: float = TOWARDS) -> DataFrame:
    """measured with distance2 (squared robust Mahalanobis distance), towards (the part of the distance along the spam
    direction, signed), is_outlier (by distance) and is_spam (by distance and direction). The models, a row for each language, are joined as linear forms of the features."""
    if not models:
        return measured.withColumns({"distance2": F.lit(None).cast("double"), "towards": F.lit(None).cast("double"), "is_outlier": F.lit(False), "is_spam": F.lit(False)})
    k = len(FEATURES)
    rows = []
    for key, (m, s, inv) in models.items():
        root = np.linalg.cholesky(inv).T / s  # distance2 is the squared length of root @ (f - m)
        to = inv @ DIRECTION / math.sqrt(float(DIRECTION @ inv @ DIRECTION)) / s
        rows.append((key, *map(float, root.ravel()), *map(float, -root @ m), *map(float, to), float(-to @ m)))
    names = ["__key", *(f"a{i}_{j}" for i in range(k) for j in range(k)), *(f"b{i}" for i in range(k)), *(f"u{j}" for j in range(k)), "u"]
    model = measured.sparkSession.createDataFrame(rows, ", ".join(f"{n} {'string' if n == '__key' else 'double'}" for n in names))
    key = F.when(F.col("lang").isin(list(models)), F.col("lang")).otherwise(F.lit("*"))
    j = measured.withColumn("__key", key).join(F.broadcast(model), "__key")
    line = lambda cs, c: sum((F.col(n) * F.col("f")[i] for i, n in enumerate(cs)), F.col(c))
    d2 = sum((F.pow(line([f"a{i}_{q}" for q in range(k)], f"b{i}"), F.lit(2.0)) for i in range(k)), F.lit(0.0))
    out = j.select(*measured.columns, d2.alias("distance2"), line([f"u{q}" for q in range(k)], "u").alias("towards"))
    out = out.withColumn("is_outlier", F.col("distance2") > distance2)
    return out.withColumn("is_spam", F.col("is_outlier") & (F.col("towards") > towards))


def spam_pages(df: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", distance2: float = DISTANCE2, towards: float = TOWARDS) -> DataFrame:
    """(id, lang, distance2, towards, listing, is_outlier, is_spam) for each text with a word in it.

    Null and empty texts and texts of signs only have no row. Copies are scored alike, each with its own row. An
    unknown or missing language is guessed from the function words, else 'und', which is held against all
    texts. An empty table gives no rows."""
    measured = settle(measure(df, id_col, text, lang))  # a few numbers for each text, read three times
    out = outliers(measured, robust_models(measured), distance2, towards)
    return out.select(F.col("id").alias(id_col), "lang", "distance2", "towards", F.col("f")[FEATURES.index("listing")].alias("listing"), "is_outlier", "is_spam")
