"""Protected zones: tables and formulas inside a text, which no cut may split."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructType

# What a zone looks like.
_TABLE = re.compile(r"(?:^|\n)(?:\|[^\n]*\|[ \t]*\n)+(?:\|?[\s:|-]+\|?[ \t]*\n)(?:\|[^\n]*\|[ \t]*\n?)+")
_BLOCK = re.compile(r"\$\$(.+?)\$\$", re.S)
_INLINE = re.compile(r"\$+([^\$\n]+?)\$+")


def zones(text: str | None) -> list[tuple[int, int]]:
    """Spans (end exclusive) of tables, block formulas and inline formulas, merged where they overlap."""
    if not text or ("$" not in text and "|" not in text):
        return []
    out: list[tuple[int, int]] = []
    for a, b in sorted(m.span() for p in (_TABLE, _BLOCK, _INLINE) for m in p.finditer(text)):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def inside(position: int, spans: list[tuple[int, int]]) -> bool:
    return any(a <= position < b for a, b in spans)


def safe_cut(position: int, spans: list[tuple[int, int]]) -> int:
    """The position, or the nearer end of the zone it would split (the earlier of equals)."""
    for a, b in spans:
        if a < position < b:
            return a if position - a <= b - position else b
    return position


def segments(text: str, spans: list[tuple[int, int]]) -> list[tuple[bool, str]]:
    """(is a zone, text) in order, without empty ones."""
    out, at = [], 0
    for a, b in spans:
        out += [(False, text[at:a]), (True, text[a:b])]
        at = b
    return [s for s in [*out, (False, text[at:])] if s[1]]


def overlap_tail(text: str, most: int) -> str:
    """The last ``most`` characters, cut before the first zone in them; a shorter text is returned whole."""
    if len(text) <= most:
        return text
    tail = text[-most:] if most > 0 else ""
    held = zones(tail)
    return tail[: held[0][0]] if held else tail


# --- the same as Arrow functions of columns ---------------------------------------------------------

_SPANS = ArrayType(StructType().add("begin", IntegerType()).add("end", IntegerType()))
_PARTS = ArrayType(StructType().add("atomic", BooleanType()).add("text", StringType()))


@F.pandas_udf(_SPANS)
def zone_spans(text: pd.Series) -> pd.Series:
    return pd.Series([[{"begin": a, "end": b} for a, b in zones(t)] for t in text], dtype=object)


@F.pandas_udf(_PARTS)
def zone_parts(text: pd.Series) -> pd.Series:
    return pd.Series([[{"atomic": a, "text": x} for a, x in segments(t or "", zones(t))] for t in text], dtype=object)


@F.pandas_udf(IntegerType())
def safe_position(text: pd.Series, position: pd.Series) -> pd.Series:
    return pd.Series([safe_cut(int(p), zones(t)) for t, p in zip(text, position)])


@F.pandas_udf(StringType())
def safe_tail(text: pd.Series, most: pd.Series) -> pd.Series:
    return pd.Series([overlap_tail(t or "", int(n)) for t, n in zip(text, most)], dtype=object)


def in_zone(position, spans):
    """Whether a position lies in one of the spans, as a column."""
    return F.exists(spans, lambda z: (z["begin"] <= position) & (position < z["end"]))
