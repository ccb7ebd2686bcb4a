"""Scalar functions on text and loosely typed values."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values: (family, alternatives); the first family counts of which all words of an alternative occur in the lower-cased text.
FAMILY_RULES = (
    ("bit_manipulation", (("bit manipulation",), ("8-bit binary",))),
    ("cipher", (("secret encryption",), ("decrypt",))),
    ("numeral", (("numeral system",),)),
    ("unit_conversion", (("unit", "convert"),)),
    ("gravity", (("gravitational constant",), ("falling distance",))),
    ("equation", (("transformation rules is applied to equations",), ("determine the result for",))),
)
Rules = Sequence[tuple[str, Sequence[Sequence[str]]]]


def first_rule(text: Column, rules: Rules, otherwise: Column) -> Column:
    """The name of the first rule that holds for the lower-cased text: all words of one of its alternatives occur."""
    lower, out = F.lower(F.coalesce(text, F.lit(""))), otherwise
    for name, alternatives in reversed(list(rules)):
        every = [reduce(and_, (F.contains(lower, F.lit(w)) for w in words)) for words in alternatives]
        out = F.when(reduce(or_, every), name).otherwise(out)
    return out


def infer_family(text: Column, rules: Rules = FAMILY_RULES, otherwise: str = "unknown") -> Column:
    """The family of a text by ordered rules; null counts as empty."""
    return first_rule(text, rules, F.lit(otherwise))


#: Phrases that announce an answer. The first phrase that occurs decides, by its last occurrence.
ANSWER_PHRASES = (
    r"The final answer is:\s*([^\n]+)",
    r"Final answer is:\s*([^\n]+)",
    r"Final answer\s*[:：]\s*([^\n]+)",
)
#: Fixed value: a label before the answer in a text's last line.
ANSWER_LABEL = r"(?i)^(final answer|answer|assistant)\s*[:\-]\s*"


def stripped(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize_answer(text: Column, lower: bool = True) -> Column:
    """Without surrounding space and back-ticks, white space joined, without dots at the ends; null becomes empty."""
    out = stripped(F.btrim(stripped(F.coalesce(text, F.lit(""))), F.lit("`")))
    out = F.btrim(F.regexp_replace(out, r"(?U)\s+", " "), F.lit("."))
    return F.lower(out) if lower else out


def final_answer(text: Column, lower: bool = False) -> Column:
    r"""The normalised answer of a text, empty if it has none.

    Where ``\boxed{`` occurs, the last segment that isn't blank decides, cut at its last brace. Else an announcing
    phrase, else the last number, else the last line that is more than a label, without it, else the whole text.
    """
    text = F.coalesce(text, F.lit(""))
    last = lambda a: F.try_element_at(a, F.lit(-1))
    parts = F.split(text, r"\\boxed\{")
    cut = lambda x: F.when(F.contains(x, F.lit("}")), F.regexp_extract(x, r"(?s)^(.*)\}", 1)).otherwise(x)
    segments = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), cut)
    boxed = F.coalesce(last(F.filter(segments, lambda x: stripped(x) != "")), last(segments))
    phrases = [last(F.regexp_extract_all(text, F.lit("(?i)" + phrase), 1)) for phrase in ANSWER_PHRASES]
    number = last(F.regexp_extract_all(text, F.lit(r"(-?\d+(?:\.\d+)?)"), 1))
    lines = F.transform(F.split(text, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"), lambda x: stripped(F.regexp_replace(stripped(x), ANSWER_LABEL, "")))
    return normalize_answer(F.coalesce(boxed, *phrases, number, last(F.filter(lines, lambda x: x != "")), text), lower)


def shown_answer(text: Column) -> Column:
    """Trimmed and lower-cased, as tables of answers show it; null and NaN become empty."""
    plain = F.lower(stripped(F.coalesce(text.cast("string"), F.lit(""))))
    return F.when(plain == "nan", "").otherwise(plain)


def training_answer(answer: Column, style: str = "raw", prompt: Column | None = None) -> Column:
    """The target text: the answer as it is (``raw``), in a box (``boxed``), or in a box behind the prompt's cipher trace
    where it has one (``short_trace_boxed``)."""
    if style not in ("raw", "boxed", "short_trace_boxed"):
        raise ValueError(f"unknown answer style {style!r}")
    plain = stripped(F.coalesce(answer.cast("string"), F.lit("")))
    if style == "raw":
        return plain
    boxed = F.concat(F.lit("\\boxed{"), normalize_answer(plain, lower=False), F.lit("}"))
    if style == "boxed":
        return boxed
    trace = cipher_trace(F.lit("") if prompt is None else F.coalesce(prompt, F.lit("")), plain)
    return F.coalesce(F.concat(trace, F.lit("\nFinal: "), boxed), boxed)


def prompt_text(system: str, prompt: Column) -> Column:
    return F.concat(F.lit(f"System:\n{system}\n\nUser:\n"), F.coalesce(prompt, F.lit("")), F.lit("\n\nAssistant:\n"))


def training_text(system: str, prompt: Column, answer: Column, style: str = "raw") -> Column:
    """The prompt and its target, one text."""
    return F.concat(prompt_text(system, prompt), training_answer(answer, style, prompt))


def point_label(code: Column, step: Column) -> Column:
    """``code-step-N``, or the code alone where there is no step."""
    return F.when(step.isNull(), code).otherwise(F.concat(code, F.lit("-step-"), step.cast("string")))


def custom_rank(value: Column, order: Sequence[str], other: int = 999) -> Column:
    """The position of a value in a list, ``other`` if it isn't there; to sort by."""
    at = F.array_position(F.lit(list(order)), value)
    return F.when(at > 0, at - 1).otherwise(other)


def first_filled(*values: Column) -> Column:
    """The first value that is neither null nor empty text."""
    return F.coalesce(*(F.nullif(v.cast("string"), F.lit("")) for v in values))


def _bound(value: Column, body) -> Column:
    """``body(value)``, with the value worked out once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def cipher_trace(prompt: Column, answer: Column) -> Column:
    """``Trace: word->plain; ...`` for a substitution cipher with worked examples, or null.

    Lines ``cipher -> plain`` give word pairs (the last one of a word counts) and, where a pair's words are equally
    long, letter pairs. A letter with two meanings makes the result null. A word that stays partly unknown takes the
    word at its place in ``answer``.
    """
    words = lambda x: F.filter(F.split(stripped(x), r"(?U)\s+"), lambda w: w != "")
    last = lambda a: F.try_element_at(a, F.lit(-1))
    whole = lambda a: F.filter(a, lambda p: p["c"].isNotNull() & p["p"].isNotNull())
    letter = lambda x: x.rlike(r"^\p{L}$")

    def zipped(a: Column, b: Column) -> Column:
        return whole(F.zip_with(a, b, lambda x, y: F.struct(x.alias("c"), y.alias("p"))))

    def of_line(line: Column) -> Column:
        left = F.regexp_replace(F.substring_index(line, "->", 1), r"^\s*[-*?]?\s*", "")
        right = F.substr(line, F.instr(line, "->") + 2)
        return zipped(words(left), words(right))

    def meanings(pairs: Column) -> Column:
        even = F.filter(pairs, lambda w: F.length(w["c"]) == F.length(w["p"]))
        letters = F.flatten(F.transform(even, lambda w: zipped(F.split(w["c"], ""), F.split(w["p"], ""))))
        return F.array_distinct(F.filter(letters, lambda x: letter(x["c"]) & letter(x["p"])))

    query = words(F.regexp_extract(prompt, r"(?i)decrypt the following text:\s*([^\n.]+)", 1))
    gold = words(F.coalesce(answer, F.lit("")))

    def trace(pairs: Column, letters: Column) -> Column:
        known = lambda x: last(F.filter(letters, lambda y: y["c"] == x))["p"]
        spelt = lambda w: F.array_join(F.transform(F.split(w, ""), lambda x: F.when(letter(x), F.coalesce(known(x), F.lit("?"))).otherwise(x)), "")

        def decoded(word: Column, place: Column) -> Column:
            seen = last(F.filter(pairs, lambda w: w["c"] == word))["p"]
            guess = _bound(spelt(word), lambda s: F.coalesce(F.when(F.contains(s, F.lit("?")), F.get(gold, place)), s))
            return F.coalesce(seen, guess)

        steps = F.transform(query, lambda w, k: F.concat(w, F.lit("->"), decoded(w, k)))
        clash = F.size(letters) > F.size(F.array_distinct(F.transform(letters, lambda x: x["c"])))
        usable = (F.size(pairs) > 0) & ~clash & (F.size(query) > 0)
        return F.when(usable, F.concat(F.lit("Trace: "), F.array_join(steps, "; "), F.lit(".")))

    lines = F.filter(F.split(F.coalesce(prompt, F.lit("")), r"\r\n|[\n\r]"), lambda x: F.contains(x, F.lit("->")))
    whole_trace = _bound(F.flatten(F.transform(lines, of_line)), lambda pairs: _bound(meanings(pairs), lambda letters: trace(pairs, letters)))
    return F.when(F.contains(F.lower(prompt), F.lit("secret encryption rules")), whole_trace)


def to_number(text: Column) -> Column:
    """A double, or null where the text is none; NaN counts as null."""
    value = F.try_cast(F.trim(text.cast("string")), "double") if hasattr(F, "try_cast") else F.trim(text.cast("string")).try_cast("double")
    return F.when(~F.isnan(value), value)


def to_boolean(text: Column) -> Column:
    """true, 1 and yes, whatever their case; all else is false, null stays null."""
    return F.lower(F.trim(text.cast("string"))).isin("true", "1", "yes")


def run_slug(name: Column, size: int = 18) -> Column:
    """Lower-case letters and digits joined by dashes, cut to ``size`` characters; "run" if nothing is left."""
    slug = F.btrim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(slug == "", "run").otherwise(F.substring(slug, 1, size))


#: Fixed values: (code, alternatives) on the lower-cased name and method; the score that has a code of its own.
CODE_RULES = (
    ("04-s4", (("s4",), ("attention_expand",))),
    ("02-raw-full", (("raw_full",), ("active_02",))),
    ("00-raw-1024", (("lora_score_0_62",),)),
    ("smol", (("smol",),)),
)
SCORE_CODE = (0.62, "00-raw-1024")


def experiment_code(name: Column, method: Column, score: Column) -> Column:
    """The code of the first rule that holds, else the run's slug. The score's code stands before the last rule."""
    text = F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(method, F.lit("")))
    last = first_rule(text, CODE_RULES[-1:], run_slug(name))
    return first_rule(text, CODE_RULES[:-1], F.when(score == SCORE_CODE[0], SCORE_CODE[1]).otherwise(last))
