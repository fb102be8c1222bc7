"""Problem 4: texts that were cut off.

Method: values that look intact are cut artificially to make positives, and a hashed logistic regression on
closing characters, closing words, punctuation, open brackets, tags and sections, and length at the source's limit
is trained on them. Every record is then scored, and no record is cut whose probability is below the threshold.
Exact checks may only take records away: a text that ends with its whole expected answer, repeats its question
or says nothing isn't cut (problem 5 names the latter).

Lengths at which a source's responses pile up are counted over all rows. The limit feature is learned from them:
intact texts keep what their own length says, and artificial cuts are made at the source's limits as often as the
unfinished texts of the sample stand at them. The regression is fitted on the driver on at most `sample` texts
of at most `sample_chars` characters (documented bounds; they are the texts with the least hashes in a share of all,
so the sample doesn't depend on partitioning).
"""

from __future__ import annotations

import re
import zlib
from random import Random

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 6000
SAMPLE_CHARS = 20_000
DIMENSIONS = 1 << 16
THRESHOLD = 0.4
SMALL_ROWS = 50_000

# The words that open an answer line, in the languages of the data.
LABELS = "final answer|answer|respuesta final|respuesta|antwort|réponse|reponse|答案|solution|result|resultado|ergebnis|résultat"
_LABEL = re.compile(rf"^[\W_]*(?:{LABELS})\**\s*[:：]\**\s*", re.I)
_MARK = re.compile(r"\s*(?:\[(?:…|\.{3}|cut|cut off|truncated|snip|snipped|more|continued)\]|<(?:snip|cut|truncated|more)>|(?:\.{3}|…)?\((?:more|continued|cut|truncated)\)|…|\.{3})\s*$", re.I)
_BLANK = re.compile(r"[\s ​-‏⁠﻿]+$")
_STOPS = ".!?。！？"
_CLOSERS = "\"'”’»)]}*`」』）"
_LIST = re.compile(r"^\s*(?:[-*•+]|\d{1,3}[.)]|[a-zA-Z][.)])(?:\s+|$)")
_NUMBERED = re.compile(r"^\s*(\d{1,3})[.)]\s")
_INLINE = re.compile(rf"(?<=[.!?。！？>`])\s+(?=\**(?:{LABELS})\**\s*[:：])", re.I)
_ARROW = re.compile(r"^\s*(?:=>|->|→|∴|⇒)\s*")
_WORD = re.compile(r"[^\W\d_]+|\d+(?:[.,]\d+)*|[^\w\s]|_")
_DIGITS = re.compile(r"\d+")


def core_of(text: str) -> tuple[str, bool]:
    """The text without closing blanks and cut marks, and whether there was a mark."""
    t, marked = _BLANK.sub("", text), False
    while m := _MARK.search(t):
        if m.start() == 0:
            break
        t, marked = _BLANK.sub("", t[: m.start()]), True
    return t, marked


def is_open(text: str) -> bool:
    """A reasoning section was opened and never closed."""
    low = text.lower()
    return low.rfind("<think>") > low.rfind("</think>")


def _value(line: str) -> str:
    v = _ARROW.sub("", _LABEL.sub("", line))
    v = re.sub(r"^\\boxed\{(.*)\}[.。]?$", r"\1", v.strip())
    v = re.sub(r"</?\w+>", "", v)
    return v.strip().strip("*`").strip().rstrip(".。").strip().lower()


def lines_of(core: str) -> list[str]:
    """Lines; an answer label that stands behind a sentence in its line begins a line too."""
    lines = core.split("\n")
    if parts := list(_INLINE.finditer(lines[-1])):
        at = parts[-1].end()
        lines[-1:] = [lines[-1][:at].rstrip(), lines[-1][at:]]
    if lines[-1].strip() == "```" and len(lines) > 1 and (parts := list(_INLINE.finditer(lines[-2]))):
        lines[-2:-1] = [lines[-2][: parts[-1].end()].rstrip(), lines[-2][parts[-1].end() :]]
    return lines


def ends_with_gold(text: str, gold: str | None) -> bool:
    """The text ends with the whole expected answer, as its last line's value or as a closing sentence."""
    g = (gold or "").strip().rstrip(".。").strip().lower()
    core, _ = core_of(text)
    if not g or not core or not re.search(r"\w", g):
        return False
    lines = lines_of(core)
    last = lines[-1]
    if last.count("{") != last.count("}") or core.rfind("<answer>") > core.rfind("</answer>"):
        return False
    if _value(last) == g and (len(lines) == 1 or kind_of(lines) != "prose"):
        return True
    return len(g) > 20 and core.lower().rstrip("".join((_STOPS, _CLOSERS))).endswith(g.rstrip("".join((_STOPS, _CLOSERS))))


def script_of(line: str) -> str:
    """The script of the last letter."""
    for c in reversed(line):
        if c.isalpha():
            return "cjk" if "㐀" <= c <= "鿿" else "latin" if c < "ɐ" else "other"
    return "none"


def kind_of(lines: list[str]) -> str:
    last = lines[-1].strip()
    if last.startswith("\\boxed"):
        return "boxed"
    if last.startswith("```"):
        return "fence"
    if _LABEL.match(last):
        return "label"
    if last.startswith("<"):
        return "tag"
    if _ARROW.match(last):
        return "arrow"
    if _LIST.match(last):
        return "item" if last[0] in "-*•+" else "number"
    if len(last) <= 40 and len(last.split()) <= 5:
        return "bare" if len(lines) > 1 else "only"
    return "prose"


def _end(c: str) -> str:
    if c in _STOPS:
        return "stop"
    if c.isdigit():
        return "digit"
    if c.isalpha():
        return "cjk" if "㐀" <= c <= "鿿" else "upper" if c.isupper() else "lower"
    if c in ",;:，；：、-–—(（[{<\\/=+":
        return "open"
    return "close" if c in _CLOSERS else "other"


def features(text: str, gold: str | None, at_limit: bool) -> list[int]:
    """Indices of the hashed features that are on."""
    core, _ = core_of(text)
    if not core:
        return [0]
    lines = lines_of(core)
    last = lines[-1]
    kind, c = kind_of(lines), core[-1]
    bare = core.rstrip(_CLOSERS)
    ends = _end(c) if c not in _CLOSERS or not bare else f"close-{_end(bare[-1])}"
    plain = _DIGITS.sub("0", last.lower())
    words = _WORD.findall(plain)
    body = last
    for s in _STOPS:
        body = body.replace(s + " ", "\x00")
    tail = body.rsplit("\x00", 1)[-1]
    script = script_of(last)
    f = [f"kind {kind}", f"end {ends}", f"ke {kind} {ends}", f"limit {at_limit}", f"lines {min(len(lines), 3)}"]
    f.append(f"script {script} {'stop ' + c if c in _STOPS else ends}")
    if plain.endswith("0."):
        f.append(f"number dot {script} {kind}")
    f += [f"s{k} {plain[-k:]}" for k in (1, 2, 3, 4, 6)]
    f += [f"w{k} {kind if k == 1 else ''} {' '.join((['^'] + words)[-k:])}" for k in (1, 2, 3)]
    f += [f"w2 {' '.join((['^'] + words)[-2:])}", f"tail {min(len(tail.split()), 8)} {ends}"]
    opening = _WORD.findall(tail.lower())[:1] if ends.split("-")[-1] != "stop" else []
    f += [f"opens with {kind} {w}" for w in opening]
    if len(plain) <= 28:
        f.append(f"line {kind} {plain}")
        f.append(f"shape {kind} {''.join('A' if w[0].isalpha() else w[0] for w in words)[:8]}")
    # What is left open in the last line or the whole text.
    opened = ["<think>"] if is_open(core) else []
    for a, b in (("{", "}"), ("(", ")"), ("[", "]"), ("（", "）"), ("“", "”"), ("«", "»")):
        if last.count(a) > last.count(b):
            opened.append(a)
    if last.count('"') % 2:
        opened.append('"')
    if last.count("**") % 2:
        opened.append("**")
    if last.count("$") % 2:
        opened.append("$")
    if core.count("```") % 2:
        opened.append("```")
    if core.count("\\left") > core.count("\\right"):
        opened.append("\\left")
    if core.rfind("<answer>") > core.rfind("</answer>"):
        opened.append("<answer>")
    if re.search(r"<[/\w]*$", last):
        opened.append("<tag")
    if re.search(r"\\[A-Za-z]*$", last):
        opened.append("\\command")
    if c == "�":
        opened.append("half character")
    if re.match(r"^\s*(?:\d{1,3}[.)]?|[-*•])$", last) and len(lines) > 1 and any(_LIST.match(x) for x in lines[:-1]) and not (gold and last.strip() == gold.strip()):
        opened.append("empty item")
        before = [int(m.group(1)) for x in lines[:-1] if (m := _NUMBERED.match(x))]
        number = re.sub(r"\D", "", last)
        if before and number and int(number) == before[-1] + 1:
            opened.append("next item")
    if opened[:1] == ["<think>"]:
        f += [f"section {kind}", f"section {ends}", f"section {script}"]
    f += [f"open {x}" for x in opened] + [f"opens {min(len(opened), 2)} {kind}"]
    v = _value(last)
    f.append(f"value {kind} {'none' if not v else 'text' if v[0].isalpha() else 'number'} {min(len(v.split()), 5)}")
    g = (gold or "").strip().rstrip(".。").strip().lower()
    if g and v:
        tail_gold = core.lower().rstrip("".join((_STOPS, _CLOSERS))).endswith(g.rstrip(_CLOSERS)) and len(g) > 8
        if v == g or tail_gold:
            rel = "is"
        elif g.startswith(v) and (len(v) >= 6 or (kind in ("label", "arrow") and not v.isdigit())):
            rel = "begins"
        elif len(v) > 12 and any(g.startswith(tail.strip().lower()[k:]) for k in range(0, max(1, len(tail.strip()) - 12), 1) if k == 0 or not tail.strip()[k - 1].isalnum()):
            rel = "begins"
        else:
            rel = "other"
        f += [f"gold {rel}", f"gold {rel} {kind}"]
    return [1 + zlib.crc32(x.encode("utf-8", "replace")) % (DIMENSIONS - 1) for x in dict.fromkeys(f)]


def looks_intact(text: str, gold: str | None) -> bool:
    """A text whose end is one of the usual whole ends; only such texts are cut to train on."""
    core, marked = core_of(text)
    if marked or not core or is_open(core) or core.count("```") % 2:
        return False
    lines = lines_of(core)
    kind = kind_of(lines)
    g = (gold or "").strip().rstrip(".。").lower()
    if kind in ("boxed", "tag", "fence"):
        return core[-1] in "}>`." and lines[-1].count("{") == lines[-1].count("}")
    if kind == "label":
        return bool(_value(lines[-1])) and lines[-1].count("**") % 2 == 0
    if kind in ("bare", "only", "arrow"):
        return _value(lines[-1]) == g or bool(re.fullmatch(r"[\W]*(?:[A-Ea-e]|\d[\d.,]*|yes|no|Yes|No)[\W]*", lines[-1]))
    if kind == "item":
        return len(lines) > 2 and not re.search(r"[,;:(\-]$", core) and len(lines[-1]) > 6 and lines[-1].split()[-1] in {x.split()[-1] for x in lines[:-1] if x.split()}
    return core.rstrip("\"'”’»)*`」』）")[-1:] in _STOPS and core[-2:-1] != "."


def _whole_here(text: str, p: int) -> bool:
    """Whether a cut at p leaves no unit open: after a stop and before a blank, or at a line's end."""
    left, right = text[:p].rstrip(), text[p:]
    if not left or not right.strip() or not re.search(r"\w", right):
        return True
    if left.endswith((":", "：")):
        return False
    if text[:p].endswith("\n") or right.startswith("\n"):
        return not re.fullmatch(r"\s*(?:\d{1,3}[.)]?|[-*•])\s*", left.split("\n")[-1])
    return left[-1] in "。！？" or (left[-1] in ".!?" and (right[0].isspace() or text[p - 1 : p].isspace()) and not re.search(r"(?:^|\n)\s*\d{1,3}\.$", left))


def training_set(texts: list[tuple[str, str | None, bool, int | None]], examples: int = 24_000, seed: int = 5) -> tuple[list[list[int]], list[int]]:
    """Features and labels from (text, gold, at_limit, limit), where limit is the greatest of the source's limits below
    the text's length, if any: intact texts, the same ended at a sentence or line, and the same cut elsewhere."""
    r = Random(seed)
    seeds = [(core_of(t)[0], g, a, n) for t, g, a, n in texts if looks_intact(t, g)]
    x: list[list[int]] = []
    y: list[int] = []

    def add(text: str, gold: str | None, at_limit: bool, label: int) -> None:
        x.append(features(text, gold, at_limit))
        y.append(label)

    if not seeds:
        return x, y
    # How many of the unfinished texts stand at a limit, over the share of texts that can be cut at one.
    unfinished = [a for t, g, a, _ in texts if not looks_intact(t, g)]
    at = sum(unfinished) / max(1, len(unfinished)) / max(1e-9, sum(n is not None for *_, n in seeds) / len(seeds))
    rounds = max(1, min(8, examples // (4 * len(seeds))))
    for text, gold, at_limit, limit in seeds:
        # Behind a decimal point: a cut that can be told only where full stops are other signs.
        points = [m.end() for m in re.finditer(r"\d\.(?=\d)", text)]
        points = [p for p in points if script_of(text[:p]) == "cjk"]
        for _ in range(rounds):
            add(text, gold, at_limit, 0)
            lines = lines_of(text)
            v = re.sub(r"^[\s*`]+|[\s*`]+$", "", _LABEL.sub("", lines[-1]))
            if kind_of(lines) == "label" and v and r.random() < 0.5:  # the same answer without its label
                add("\n".join([*lines[:-1], v]) if r.random() < 0.5 else v, r.choice([gold, None, "?"]), False, 0)
            ends = [m.end(1) for m in re.finditer(r"([.!?。！？])(?:\s|$)", text[: len(text) - 1])]
            ends = [p for p in ends if _whole_here(text, p) and text[:p].count("```") % 2 == 0]
            inside = [p for p in ends if is_open(text[:p])]
            if inside:  # whole sentences in a section that is never closed
                add(text[: r.choice(inside)], gold, False, 1)
            for _ in range(1 if inside else 2):
                p = r.randrange(max(1, len(text) // 6), len(text)) if len(text) > 2 and r.random() < 0.8 else max(1, len(text) - r.randrange(1, 24))
                here = limit is not None and limit < len(text) and r.random() < at
                if here:
                    p = limit
                elif points and r.random() < 0.1:
                    p = r.choice(points)  # inside a number
                if text[p : p + 1].isdigit() and re.search(r"\d\.$", text[max(0, p - 2) : p]) and p not in points:
                    continue
                if p >= 20 and (is_open(text[:p]) or not _whole_here(text, p)):
                    add(text[:p], gold, here, 1)
            if ends:
                p = r.choice(ends)
                add(text[:p], gold, False, int(p in inside))
    return x, y


def fit(x: list[list[int]], y: list[int], epochs: int = 12, rate: float = 0.25, decay: float = 1e-6, batch: int = 256, seed: int = 3) -> np.ndarray:
    """Weights of the logistic regression (AdaGrad); weight 0 is the bias."""
    w = np.zeros(DIMENSIONS)
    if not x:
        w[0] = -30.0  # nothing to learn from: nothing is cut
        return w
    width = max(map(len, x)) + 1
    idx = np.full((len(x), width), -1, dtype=np.int64)
    for i, row in enumerate(x):
        idx[i, : len(row) + 1] = [0, *row]
    on = idx >= 0
    idx[~on] = 0
    t = np.asarray(y, dtype=float)
    g2 = np.full(DIMENSIONS, 1e-6)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for k in range(0, len(x), batch):
            b = order[k : k + batch]
            z = (w[idx[b]] * on[b]).sum(1)
            e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - t[b])[:, None] * on[b]
            g = np.bincount(idx[b].ravel(), e.ravel(), DIMENSIONS) / len(b)
            g2 += g * g
            w -= rate * g / np.sqrt(g2) + decay * w
    return w


def score(w: np.ndarray, text: str, gold: str | None, at_limit: bool) -> float:
    z = w[0] + w[features(text, gold, at_limit)].sum()
    return float(1 / (1 + np.exp(-max(-30.0, min(30.0, z)))))


def limits(df: DataFrame, source: str, text: str) -> DataFrame:
    """(__s, __len): lengths at which far more of a source's texts end than at the ten lengths on both sides. Counted
    over all rows; copies of one text count once, so a text that is repeated is no limit."""
    d = df.where(F.length(text) > 0).select(F.col(source).alias("__s"), F.length(text).alias("__len"), F.xxhash64(text).alias("__h"))
    n = d.distinct().groupBy("__s", "__len").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy("__s").orderBy("__len").rangeBetween(-10, 10)
    n = n.withColumn("__near", (F.sum("__n").over(w) - F.col("__n")) / (F.least(F.col("__len") - 1, F.lit(10)) + 10))
    return n.where((F.col("__n") >= 6) & (F.col("__n") >= 5 * (F.col("__near") + 0.4))).select("__s", "__len")


def small(found: DataFrame) -> DataFrame:
    """A written table, broadcast if it has no more than SMALL_ROWS rows (of about 12 bytes)."""
    return F.broadcast(found) if found.count() <= SMALL_ROWS else found


def with_limit(df: DataFrame, source: str, text: str, found: DataFrame) -> DataFrame:
    """df with `at_limit`: its length is one of the written limits `found`."""
    j = df.withColumn("__l", F.length(text)).join(small(found), F.col(source).eqNullSafe(F.col("__s")) & (F.col("__l") == F.col("__len")), "left")
    return j.withColumn("at_limit", F.col("__len").isNotNull()).drop("__l", "__s", "__len")


def model_for(df: DataFrame, source: str, text: str, gold: str, found: DataFrame, sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> np.ndarray:
    """The weights fitted on at most `sample` different texts of df (with `at_limit`) of at most `sample_chars` characters:
    the least hashes of the share that holds about `sample` of them. No task sends more than `sample` texts."""
    d = df.where((F.length(text) > 0) & (F.length(text) <= sample_chars))
    d = d.select(F.xxhash64(text).alias("h"), F.struct(F.col(text).alias("t"), F.col(gold).alias("g"), "at_limit", F.col(source).alias("s")).alias("r"))
    n = d.select("h").distinct().count()
    share = 1.0 if n <= sample else sample / n
    part = d.where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30))).groupBy("h").agg(F.min("r").alias("r")).orderBy("h").limit(sample)
    part = part.join(small(found), F.col("r.s").eqNullSafe(F.col("__s")) & (F.col("__len") < F.length("r.t")), "left").groupBy("h").agg(F.first("r").alias("r"), F.max("__len").alias("n"))
    rows = sorted(part.collect(), key=lambda r: r["h"])
    return fit(*training_set([(r["r"]["t"], r["r"]["g"], r["r"]["at_limit"], r["n"]) for r in rows]))

