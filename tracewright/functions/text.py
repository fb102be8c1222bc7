"""Text columns: tags, answers, scores of answers, prompts. All built from JVM-side functions.

Patterns carry (?U) so that blanks, digits and word characters are those of Unicode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewright.functions.stats import let

BLANK = r"(?U)^\s+|\s+$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, BLANK, "")


def clean(c: Column) -> Column:
    """Null becomes '', the rest is stripped."""
    return F.coalesce(strip(c.cast("string")), F.lit(""))


def key_of(c: Column) -> Column:
    """Stripped and in lower case; null for null or blank."""
    return F.nullif(F.lower(strip(c)), F.lit(""))


def is_one_of(c: Column, allowed: list[str] | None) -> Column:
    """Membership without regard to case and outer blanks; no list lets everything pass."""
    if not allowed:
        return F.lit(True)
    return F.lower(clean(c)).isin([a.lower() for a in allowed])


def truncate(c: Column, most: int, marker: str = "\n...[truncated]") -> Column:
    """Longer texts are cut to `most` characters, stripped on the right and marked; most <= 0 never cuts."""
    t = clean(c)
    if most <= 0:
        return t
    return F.when(F.length(t) > most, F.concat(F.regexp_replace(F.left(t, F.lit(most)), r"(?U)\s+$", ""), F.lit(marker))).otherwise(t)


def tag_contents(text: Column, tag: str, ignore_case: bool = False) -> Column:
    """Contents of all <tag>...</tag>, shortest first match, across lines."""
    return F.regexp_extract_all(text, F.lit(f"(?s{'i' if ignore_case else ''})<{tag}>(.*?)</{tag}>"), F.lit(1))


def is_strict(text: Column, ignore_case: bool = True, need_answer: bool = True) -> Column:
    """Exactly one think and one answer section, think first, with a word character in think and, unless
    need_answer is false, in answer. Null counts as not strict."""
    i = "i" if ignore_case else ""
    think, answer = tag_contents(text, "think", ignore_case), tag_contents(text, "answer", ignore_case)
    order = text.rlike(f"(?s{i})^(?:(?!<answer>.*?</answer>).)*?<think>.*?</think>.*<answer>.*?</answer>")
    ok = (F.size(think) == 1) & (F.size(answer) == 1) & order & F.get(think, F.lit(0)).rlike(r"(?U)\w")
    if need_answer:
        ok = ok & F.get(answer, F.lit(0)).rlike(r"(?U)\w")
    return F.coalesce(ok, F.lit(False))


def final_label(text: Column) -> Column:
    """YES, NO or '': the last answer section, else the whole text, if it is one of these, else the first such word in it."""
    found = tag_contents(text, "answer", True)
    t = F.upper(strip(F.coalesce(F.try_element_at(found, F.lit(-1)), text)))
    return F.when(t.isin("YES", "NO"), t).otherwise(F.coalesce(F.regexp_extract(t, r"\b(YES|NO)\b", 1), F.lit("")))


def yes_no_score(text: Column, truth: Column, format_weight: float = 0.1) -> Column:
    """0 unless the text is strict (tags in lower case, answer part free) and its answer is YES or NO; else
    format_weight, plus the rest if it equals the truth."""
    answer = F.upper(strip(F.get(tag_contents(text, "answer"), F.lit(0))))
    ok = is_strict(text, ignore_case=False, need_answer=False) & answer.isin("YES", "NO")
    hit = F.coalesce(answer == F.upper(strip(truth)), F.lit(False))
    return F.when(F.coalesce(ok, F.lit(False)), F.lit(format_weight) + F.when(hit, F.lit(1.0 - format_weight)).otherwise(F.lit(0.0))).otherwise(F.lit(0.0))


def last_boxed(text: Column) -> Column:
    r"""Content of the last \boxed{...} without braces inside; null if there is none."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(r"\\boxed\{([^{}]+)\}"), F.lit(1)), F.lit(-1))


def boxed_score(text: Column, truth: Column) -> Column:
    """1 for an equal boxed answer (case and outer blanks apart), 0.1 for another, 0 for none."""
    b = last_boxed(text)
    return F.when(b.isNull(), F.lit(0.0)).when(F.lower(strip(b)) == F.lower(strip(truth)), F.lit(1.0)).otherwise(F.lit(0.1))


# The forms a task may be put into; {} stands for the stripped content. The \\n are written as two characters.
FORMS = {
    "answer_line": r'Solve the following math problem step by step. The last line of your response should be of the form Answer: $Answer (without quotes) where $Answer is the answer to the problem.\n\n{}\n\nRemember to put your answer on its own line after "Answer:".',
    "conversation": r"A conversation between User and Assistant. The user asks a question, and the Assistant solves it. The assistant first thinks about the reasoning process in the mind and then provides the user with the answer. The reasoning process and answer are enclosed within <think> </think> and <answer> </answer> tags, respectively, i.e., <think> reasoning process here </think><answer> answer here </answer>\n\nUser:{} \n\nAssistant:",
    "boxed": r"{} You FIRST think about the reasoning process as an internal monologue and then provide the final answer. The reasoning process MUST BE enclosed within <think> </think> tags. The final answer MUST BE put in \boxed{}.",
    "plain": "{}",
    "tagged": "{} A conversation between User and Assistant. The user asks a question, and the Assistant solves it. The assistant first thinks about the reasoning process in the mind and then provides the user with the answer. The reasoning process and answer are enclosed within <think> </think> and <answer> </answer> tags, respectively, i.e., <think> reasoning process here </think><answer> answer here </answer>",
}


def prompt_form(content: Column, form: str) -> Column:
    """The stripped content within one of the FORMS; null counts as empty."""
    if form not in FORMS:
        raise ValueError(f"unknown form {form}; known are {', '.join(FORMS)}")
    before, _, after = FORMS[form].partition("{}")
    return F.concat(F.lit(before), clean(content), F.lit(after))


# Literal replacements, in this order, before answers are compared.
SUBSTITUTIONS = (("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), ("\\ ", ""), (" ", ""), ("mbox", "text"), (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}"))
# Expressions dropped from answers, in this order.
REMOVED = (
    "square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots", "sue", "points", "feet", "minutes", "digits", "cents",
    "degrees", "cm", "gm", "pounds", "meters", "meals", "edges", "students", "childrentickets", "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}",
    "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}", "\\mathrm{th}", "^\\circ", "^{\\circ}", "\\;", ",\\!", "{,}", '"', "\\dots",
)
# LaTeX unwrapping and shorthand, in this order (Java syntax).
UNWRAP = (
    (r"(.*?)(\$)(.*?)(\$)(.*)", r"\$$3\$"), (r"(\\text\{)(.*?)(\})", "$2"), (r"(\\textbf\{)(.*?)(\})", "$2"), (r"(\\overline\{)(.*?)(\})", "$2"),
    (r"(\\boxed\{)(.*)(\})", "$2"), (r"(frac)([^{])(.)", r"frac{$2}{$3}"), (r"(sqrt)([^{])", r"sqrt{$2}"),
)


def normalize_answer(c: Column) -> Column:
    """What follows the last '=', with the fixed replacements made, LaTeX unwrapped and thousands separators dropped."""
    t = F.try_element_at(F.split(c, "="), F.lit(-1))
    for a, b in (*SUBSTITUTIONS, *((x, "") for x in REMOVED)):
        t = F.replace(t, F.lit(a), F.lit(b))
    for p, r in UNWRAP:
        t = F.regexp_replace(t, p, r)
    t = F.replace(t, F.lit("$"), F.lit(""))
    # let: the long chain of replacements is written, and run, once.
    digits = lambda t: F.replace(t, F.lit(","), F.lit(""))
    return let(t, lambda t: strip(F.when(digits(t).rlike(r"^\d+$"), digits(t)).otherwise(t)))


def last_answer(text: Column, tail: int = 300) -> Column:
    """What stands behind the last 'Answer:' in the last `tail` characters; [INVALID] if nothing does."""
    return F.coalesce(F.try_element_at(F.regexp_extract_all(F.right(text, F.lit(tail)), F.lit(r"(?i)Answer\s*:\s*([^\n]+)"), F.lit(1)), F.lit(-1)), F.lit("[INVALID]"))


def answer_accuracy(text: Column, truth: Column) -> Column:
    return F.when(normalize_answer(last_answer(text)) == normalize_answer(truth), F.lit(1.0)).otherwise(F.lit(-1.0))


def overlong_penalty(length: Column, longest: int, buffer: int) -> Column:
    """0 up to longest - buffer, falling to -1 at longest, -1 beyond; 0 for a null length."""
    free = longest - buffer
    return F.when(length.isNull() | (length <= free), F.lit(0.0)).when(length <= longest, (F.lit(free) - length) / F.lit(float(buffer))).otherwise(F.lit(-1.0))


def combined_score(text: Column, truth: Column, length: Column, longest: int, buffer: int, factor: float) -> Column:
    acc, over = answer_accuracy(text, truth), overlong_penalty(length, longest, buffer)
    return F.struct((acc + over * factor).alias("overall"), acc.alias("accuracy"), over.alias("overlong"), (0.5 * (acc + 1.0)).alias("accuracy_normalized"))


def same_answer(a: Column, b: Column) -> Column:
    """Equality of answers by this engine's own rule: normalized text, else equal numbers."""
    num = lambda c: F.try_to_number(F.replace(c, F.lit(","), F.lit("")), F.lit("S999999999999.999999")).cast("double")
    both = F.struct(normalize_answer(a).alias("x"), normalize_answer(b).alias("y"))
    return let(both, lambda p: F.coalesce((F.lower(p["x"]) == F.lower(p["y"])) | (num(p["x"]) == num(p["y"])), F.lit(False)))


def boxed_math_score(text: Column, truth: Column) -> Column:
    """1 for a boxed answer that equals the truth as same_answer has it, 0.1 for another, 0 for none or a null text."""
    b = last_boxed(text)
    return F.when(b.isNull(), F.lit(0.0)).when(same_answer(b, truth), F.lit(1.0)).otherwise(F.lit(0.1))


def math_score(text: Column, truth: Column, format_weight: float = 0.1) -> Column:
    """Format: think section and a box in the whole text, blanks around <, > and / dropped first."""
    t = F.regexp_replace(text, r"\s*(<|>|/)\s*", "$1")
    fmt = F.when(t.rlike(r"(?s)^<think>.*</think>.*\\boxed\{.*\}.*$"), F.lit(1.0)).otherwise(F.lit(0.0))
    acc = F.when(same_answer(last_boxed(t), truth), F.lit(1.0)).otherwise(F.lit(0.0))
    return F.struct((acc * (1 - format_weight) + fmt * format_weight).alias("overall"), fmt.alias("format"), acc.alias("accuracy"))


def think_answer_score(text: Column, truth: Column, format_weight: float = 0.5) -> Column:
    """Format: the whole text is a think and an answer section. The answer must stand on one line, else the whole text counts."""
    fmt = F.when(text.rlike(r"(?s)^<think>.*?</think>\s*<answer>.*?</answer>$"), F.lit(1.0)).otherwise(F.lit(0.0))
    found = text.rlike(r"<answer>(.*?)</answer>")
    given = F.when(found, strip(F.regexp_extract(text, r"<answer>(.*?)</answer>", 1))).otherwise(strip(text))
    acc = F.when(same_answer(given, strip(truth)), F.lit(1.0)).otherwise(F.lit(0.0))
    return F.struct((acc * (1 - format_weight) + fmt * format_weight).alias("overall"), fmt.alias("format"), acc.alias("accuracy"))


def _last_line(t: Column) -> Column:
    return F.try_element_at(F.filter(F.transform(F.split(t, r"\r\n|[\n\r]"), strip), lambda x: x != ""), F.lit(-1))


def extract_answer(text: Column) -> Column:
    """The answer section, else the last box, else the last line behind the closing think tag, else the last line, else ''."""
    tag = F.nullif(strip(F.get(tag_contents(text, "answer", True), F.lit(0))), F.lit(""))
    rest = F.get(F.split(text, "(?i)</think>", 2), F.lit(1))
    return F.coalesce(tag, strip(last_boxed(text)), _last_line(rest), _last_line(text), F.lit(""))


# Fixed value: what stands in for a missing reasoning section.
FILLER = "I solve the problem using the provided facts and reasoning constraints."


def normalize_solution(text: Column, answer: Column) -> Column:
    """<think>...</think><answer>...</answer> rebuilt from a text that may lack parts of it."""
    t = clean(text)
    a = F.coalesce(F.nullif(clean(answer), F.lit("")), F.nullif(extract_answer(t), F.lit("")), F.lit("N/A"))
    inner = strip(F.get(tag_contents(t, "think", True), F.lit(0)))
    before = F.when(t.rlike("(?i)</think>"), strip(F.get(F.split(t, "(?i)</think>", 2), F.lit(0))))
    think = F.coalesce(inner, before, strip(F.regexp_replace(t, "(?is)<answer>(.*?)</answer>", "")))
    think = F.coalesce(F.nullif(think, F.lit("")), F.lit(FILLER))
    return F.concat(F.lit("<think>\n"), think, F.lit("\n</think><answer>"), a, F.lit("</answer>"))


def sections(intro: list[str], parts: list[tuple[str, Column]], last: tuple[str, Column]) -> Column:
    """Intro lines, then '[Label]' sections that aren't blank, then the last one always; stripped."""
    named = [F.when(clean(c) != "", F.concat(F.lit(f"[{n}]\n"), clean(c), F.lit("\n"))) for n, c in parts]
    return strip(F.concat_ws("\n", *map(F.lit, intro), *named, F.concat(F.lit(f"[{last[0]}]\n"), clean(last[1]))))


def render(template: str, given: dict[str, Column]) -> Column:
    """Placeholders {name} replaced one after the other; an unknown one is an error before anything runs."""
    import re

    unknown = sorted(set(re.findall(r"\{([a-z_][a-z0-9_]*)\}", template)) - set(given))
    if unknown:
        raise ValueError("unknown placeholders: " + ", ".join(unknown))
    t = F.lit(template)
    for k, v in given.items():
        t = F.replace(t, F.lit("{" + k + "}"), F.coalesce(v.cast("string"), F.lit("")))
    return t


def render_column(template: Column, given: dict[str, Column]) -> Column:
    """As render, for templates in a column; a row with an unknown placeholder gives null."""
    known = F.array(*map(F.lit, given))
    names = F.regexp_extract_all(template, F.lit(r"\{([a-z_][a-z0-9_]*)\}"), F.lit(1))
    t = template
    for k, v in given.items():
        t = F.replace(t, F.lit("{" + k + "}"), F.coalesce(v.cast("string"), F.lit("")))
    return F.when(F.size(F.array_except(names, known)) == 0, t)


def answer_block(label: str, answers: Column, first: int = 1) -> Column:
    """'Label i:' and the answer on the next line, separated by blank lines."""
    return F.array_join(F.transform(answers, lambda a, i: F.concat(F.lit(label + " "), (i + first).cast("string"), F.lit(":\n"), a)), "\n\n")


def chat(*turns: tuple[str, Column]) -> Column:
    return F.array(*(F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in turns))


def filled(*cs: Column) -> Column:
    """The first that isn't null or blank, stripped; else null."""
    return F.coalesce(*(F.nullif(strip(c.cast("string")), F.lit("")) for c in cs))


def number_or_null(c: Column) -> Column:
    """A number in a text; null for null, blank or no number."""
    return strip(c.cast("string")).try_cast("double")


def pretty_rubric(criteria: Column, fields: tuple[str, ...] = ("criterion_id", "category", "criterion", "points")) -> Column:
    """A rubric's criteria as indented JSON, as it stands in a prompt: two blanks a level, no escapes but JSON's own. An
    empty list is [], null stays null."""

    def value(x: Column, f: str) -> Column:
        # to_json of a struct gives {"v":...}; null fields are left out of it.
        v = F.to_json(F.struct(x[f].alias("v")))
        return F.when(x[f].isNull(), F.lit("null")).otherwise(F.substr(v, F.lit(6), F.length(v) - 6))

    def one(x: Column) -> Column:
        return F.concat(F.lit("  {\n"), F.concat_ws(",\n", *(F.concat(F.lit(f'    "{f}": '), value(x, f)) for f in fields)), F.lit("\n  }"))

    return F.when(F.size(criteria) > 0, F.concat(F.lit("[\n"), F.array_join(F.transform(criteria, one), ",\n"), F.lit("\n]"))).when(criteria.isNotNull(), F.lit("[]"))


def metric_key(c: Column) -> Column:
    return F.regexp_replace(c, "[^a-zA-Z0-9_.-]+", "_")


# Patterns of rubric criteria on the final answer and on the format.
FINAL_ANSWER = (r"final\s+label", r"known\s+final", r"final\s+answer", r"<answer>.*known", r"known.*<answer>", r"answer.*matches", r"matches.*answer", r"yes/no", r"最终.*标签", r"最终.*答案", r"答案.*一致", r"标签.*一致")
FORMAT = (r"output\s+protocol", r"\bformat\b", r"tag", r"<think>", r"格式", r"标签格式")


def cap_points(category: Column, criterion: Column, points: Column, final_cap: int, format_cap: int) -> Column:
    t = F.lower(F.concat_ws(" ", category, criterion))
    return F.when(t.rlike("|".join(FINAL_ANSWER)), F.least(points, F.lit(max(1, final_cap)))).when(t.rlike("|".join(FORMAT)), F.least(points, F.lit(max(1, format_cap)))).otherwise(points)


# What stands in for a step that is taken out.
REPLACEMENTS = {"remove": "", "neutral": " [The reasoning step here is omitted.] ", "mask": " [MASKED_REASONING_STEP] "}


def intervene(text: Column, start: Column, end: Column, mode: str) -> Column:
    """[start, end) replaced; a span that isn't within the text leaves it as it is. Any other mode is 'mask'."""
    ok = (start >= 0) & (end > start) & (end <= F.length(text))
    put = F.lit(REPLACEMENTS.get(mode, REPLACEMENTS["mask"]))
    return F.when(F.coalesce(ok, F.lit(False)), F.concat(F.left(text, start), put, F.substr(text, end + 1))).otherwise(text)


def image_size(w: Column, h: Column, least: int, most: int) -> Column:
    """Width and height scaled down to `most` pixels or up to `least`, cut to whole numbers."""
    area = (w * h).cast("double")
    k = F.when(area > most, F.sqrt(F.lit(float(most)) / area)).when(area < least, F.sqrt(F.lit(float(least)) / area)).otherwise(F.lit(1.0))
    return F.struct((w * k).cast("int").alias("width"), (h * k).cast("int").alias("height"))


def expand_images(prompt: Column, counts: Column, mark: str = "<image>", start: str = "<|vision_start|>", pad: str = "<|image_pad|>", end: str = "<|vision_end|>") -> Column:
    """Each mark, in order, becomes start, counts[i] pads and end; null if the numbers of marks and counts differ."""
    parts = F.split(prompt, mark.replace("|", r"\|"))
    body = F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit(start), F.repeat(F.lit(pad), F.get(counts, i - 1)), F.lit(end), p))), "")
    return F.when(F.size(parts) - 1 == F.size(counts), body)
