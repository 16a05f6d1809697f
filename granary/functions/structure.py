"""Headings: which texts are titles, at what level, and of what kind of region. All as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions import headings as H
from granary.functions.text import trimmed

#: What the patterns of ``promoted`` begin with.
OPENINGS = "^[第附目前序参一二三四五六七八九十百Rr0-9]"


def _long(number: Column) -> Column:
    """Whether the first part of a number is too long for a chapter's: a year, or a number of something else."""
    return F.length(F.element_at(F.split(number, r"\."), 1)) >= 4


def _depth(t: Column) -> Column:
    """Level of a numbered heading, by the dots of its number; null if there is none."""
    number = F.regexp_extract(t, H.NUMERIC, 1)
    return F.when((number != "") & ~_long(number), F.least(F.size(F.split(number, r"\.")), F.lit(3)))


def let(value: Column, then) -> Column:
    """``then`` of a value that is computed once: inside a lambda nothing else shares subexpressions."""
    return F.element_at(F.transform(F.array(value), then), 1)


def promoted_level(text: Column) -> Column:
    """Level 1 to 3 of a paragraph that is a title in all but name, else null. Years and dates are no numbers of chapters."""
    return promoted(trimmed(text))


def promoted(t: Column) -> Column:
    """``promoted_level`` of a trimmed text."""
    number = F.regexp_extract(t, H.NUMERIC, 1)
    date = _long(number) | t.rlike(r"^\d+(?:\.\d+){0,2}(?:\s|$)\s*[年月日]")
    first = F.lit(False)
    for p in (H.TOC, H.PREFACE, H.REFERENCE, H.APPENDIX, H.CHAPTER, H.NUMERAL):
        first = first | t.rlike(p)
    level = F.when(first, 1).when(t.rlike(H.ARTICLE), 2).when((number != "") & ~date, _depth(t)).cast("int")
    # Most paragraphs begin with a letter that begins no heading, and are asked nothing more.
    return F.when(t.rlike(OPENINGS), level)


def inferred_level(text: Column) -> Column:
    t = trimmed(text)
    return F.when(t.rlike(H.CHAPTER) | t.rlike(H.NUMERAL), 1).when(t.rlike(H.ARTICLE), 2).otherwise(_depth(t)).cast("int")


def effective_level(block_type: Column, text: Column, declared: Column) -> Column:
    """Level of a title: what its text says, else what was declared."""
    return F.when(block_type == "title", F.coalesce(inferred_level(text), declared)).cast("int")


def _any(t: Column, patterns) -> Column:
    return reduce(Column.__or__, (t.rlike(p) for p in patterns))


def region_kind(text: Column) -> Column:
    """Kind of region that a title opens, or ''. A line that only gives an identifier opens none."""
    t = trimmed(text)
    found = [F.when(_any(t, patterns), kind) for kind, patterns in H.KINDS.items()]
    return F.when(t.rlike(H.IDENTIFIER_LINE), "").otherwise(F.coalesce(*found, F.lit("")))


def chapter_like(text: Column) -> Column:
    """A short text that is numbered or named like a chapter."""
    t = trimmed(text)
    counted = t.rlike(H.COUNTED) & (F.length(t) <= 40)
    return F.length(t).between(1, 60) & ~t.rlike(H.PAPER_HEADER) & (counted | _any(t, H.CHAPTER_FORMS))


def level_1_like(text: Column) -> Column:
    """A title that may open a chapter: short, without the marks of a sentence, unless its number says so."""
    t = trimmed(text)
    return F.when(F.length(t) == 0, False).when(t.rlike(H.NUMERAL) & (F.length(t) <= 40), True).when(F.length(t) > 30, False).when(t.rlike(r"^\d+(?:\s|$)"), True).otherwise(~t.rlike(H.SENTENCE_MARKS))


def toc_like(text: Column) -> Column:
    """A line of a table of contents: leaders, and a number at its end."""
    return F.coalesce(text.rlike(r"[….·]{2,}") & text.rlike(r"\d+\)?\s*$"), F.lit(False))


def english_level_1(text: Column) -> Column:
    return trimmed(text).rlike(H.ENGLISH_LEVEL_1)
