"""Column expressions shared by the operators: counts, spans, segments and roundings of texts."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space inside regular expressions of both Spark and SQL engines.
BLANK = r" \t\n\r\f\x{0B}"
SPACE = f"[{BLANK}]"


def rounded(x: Column, digits: int) -> Column:
    """Scaled, rounded half away from zero, and scaled back."""
    return F.round(x * float(10**digits)) / float(10**digits) if digits else F.round(x)


def apart(words: Sequence[str]) -> bool:
    """Whether no occurrence of a word can overlap one of another."""
    return all(a not in b and not any(a.endswith(b[:k]) for k in range(1, len(b))) for a in words for b in words if a != b)


def occurrences(text: Column, word: str) -> Column:
    """How often a word occurs, without overlaps: by the bytes that go with it, whose number needs no pass over the text."""
    return ((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(word), F.lit("")))) / len(word.encode())).cast("long")


@cache
def words_of(pattern: str) -> tuple[str, ...] | None:
    """The words that a pattern counts, where each can be counted by itself: plain words that cannot overlap, and the letters of a small class."""
    if re.fullmatch(r"\[[^\[\]\\^&-]{1,8}\]", pattern):
        return tuple(dict.fromkeys(pattern[1:-1]))
    words = tuple(dict.fromkeys(pattern.split("|")))
    return words if all(words) and not re.search(r"[\\^$.?*+()\[\]{}]", pattern) and apart(words) else None


def count(text: Column, pattern: str) -> Column:
    """How often a pattern occurs, without overlaps. Plain words that cannot overlap, and the letters of a small class, are counted by replacing them, which is some ten times as fast as a regular expression; letters of other classes by taking out whole runs of them."""
    words = words_of(pattern)
    if words is not None:
        return total([occurrences(text, w) for w in words])
    if re.fullmatch(r"\[[^\[\]]+\]", pattern):
        return (F.length(text) - F.length(F.regexp_replace(text, F.lit(pattern + "+"), F.lit("")))).cast("long")
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_like(text, F.lit(pattern))


def span_chars(text: Column, pattern: str) -> Column:
    """Characters inside all matches of a pattern together."""
    return (F.length(text) - F.length(F.regexp_replace(text, F.lit(pattern), F.lit("")))).cast("long")


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def parts(text: Column, pattern: str) -> Column:
    """The trimmed parts between matches of a pattern that hold more than white space."""
    return F.filter(F.transform(F.split(text, pattern, -1), lambda x: F.regexp_replace(x, F.lit(rf"^{SPACE}+|{SPACE}+\z"), F.lit(""))), lambda x: F.length(x) > 0)


def paragraphs(text: Column, chars: Column | None = None) -> Column:
    """Paragraphs parted by blank lines; where `chars` is given and there are fewer than one in 200 characters, parted by lines."""
    blocks = parts(text, rf"\n{SPACE}*\n")
    return blocks if chars is None else F.when(F.size(blocks) < F.greatest(F.lit(1.0), chars / 200.0), parts(text, "\n")).otherwise(blocks)


def n_parts(text: Column, pattern: str) -> Column:
    """How many `parts` there are, none of them trimmed."""
    return F.size(F.filter(F.split(text, pattern, -1), lambda x: x.rlike(f"[^{BLANK}]"))).cast("long")


def sentences(text: Column, ends: str = "。！？；…!?", least: int = 2) -> Column:
    """Trimmed sentences of `least` characters and more, parted by end marks and line breaks."""
    return F.filter(parts(text, rf"[{ends}\n]+"), lambda x: F.length(x) >= least)


def dense(text: Column) -> Column:
    """The text without spaces and line breaks."""
    return F.replace(F.replace(text, F.lit("\n"), F.lit("")), F.lit(" "), F.lit(""))


def distinct_chars(text: Column) -> Column:
    return F.size(F.array_remove(F.array_distinct(F.split(text, "")), "")).cast("long")


def shares(text: Column, n: int) -> list[Column]:
    """n equal slices of a text, one character at least each; the last runs to the end."""
    size = F.greatest(F.floor(F.length(text) / n), F.lit(1)).cast("int")
    return [F.substring(text, size * k + 1, size) for k in range(n - 1)] + [F.substring(text, size * (n - 1) + 1, F.length(text))]


def first_max(values: dict[str, Column]) -> Column:
    """The name of the largest value, the first of equal ones."""
    array = F.array(*values.values())
    return F.element_at(F.array(*[F.lit(k) for k in values]), F.array_position(array, F.array_max(array)).cast("int"))


def ladder(*steps: tuple[Column, str], otherwise: str | None = None) -> Column:
    """The value of the first step whose condition holds."""
    out = F.when(steps[0][0], F.lit(steps[0][1]))
    for condition, value in steps[1:]:
        out = out.when(condition, F.lit(value))
    return out.otherwise(F.lit(otherwise))


def chinese_number(text: Column) -> Column:
    """A number in digits or in Chinese numerals; a unit multiplies the digit before it, and what gives no number counts its characters."""
    digits = F.create_map(*[F.lit(x) for pair in zip("零一二三四五六七八九两", (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 2), strict=True) for x in pair])
    units = F.create_map(*[F.lit(x) for pair in zip("十百千万", (10, 100, 1000, 10000), strict=True) for x in pair])

    def step(state: Column, c: Column) -> Column:
        digit, unit = F.try_element_at(digits, c), F.try_element_at(units, c)
        raised = F.when(state["now"] == 0, F.lit(1)).otherwise(state["now"]) * unit
        return F.struct(
            F.when(digit.isNull() & unit.isNotNull(), state["sum"] + raised).otherwise(state["sum"]).cast("long").alias("sum"),
            F.when(digit.isNotNull(), digit).when(unit.isNotNull(), F.lit(0)).otherwise(state["now"]).cast("long").alias("now"),
        )

    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("now"))
    value = F.aggregate(F.split(text, ""), start, step, lambda s: s["sum"] + s["now"])
    spelled = F.when(value > 0, value).otherwise(F.length(text))
    return F.when(text == "", F.lit(0)).otherwise(F.coalesce(F.expr("null").cast("long"), text.try_cast("long"), spelled)).cast("long")


def literal(word: str) -> str:
    return re.escape(word)
