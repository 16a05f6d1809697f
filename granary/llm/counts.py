"""Token counts by offset-mapped attribution.

A document is encoded once, whole. The character spans of its tokens are joined with the spans of its
sections by binary search over the sorted bounds. A token that crosses a boundary goes, by ``rule``, to
the section that holds its ``first`` or its ``last`` character. Sections are the lines of the text, each
with its line feed, or the spans in a column ``array<struct<name:string,begin:int,end:int>>``, which
may leave gaps but not overlap; tokens in no section are counted under a null name and section -1.

Defined results: a null or empty text has one section (0, 0, 0) with no token; a null document id stays
null; repeated rows give repeated rows; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary import runtime
from granary.llm import tokens

SCHEMA = "doc_id long, section int, name string, begin int, end int, n_tokens long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("section", pa.int32()), ("name", pa.string()), ("begin", pa.int32()), ("end", pa.int32()), ("n_tokens", pa.int64())])


def token_chars(enc: tokens.Encoder, lengths: np.ndarray, text: str, ids: np.ndarray, rule: str) -> np.ndarray:
    """The character that decides where each token belongs: the one with its first or its last byte."""
    if not enc.by_word:
        spans = np.array(enc.tokenizer.encode(text, add_special_tokens=False).offsets, np.int64).reshape(-1, 2)
        return spans[:, 0] if rule == "first" else np.maximum(spans[:, 0], spans[:, 1] - 1)
    ends = np.cumsum(lengths[ids])
    at = ends - lengths[ids] if rule == "first" else ends - 1
    if text.isascii():
        return at
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    return (np.cumsum((raw & 0xC0) != 0x80) - 1)[at]


def lines(text: str) -> np.ndarray:
    """Bounds of the lines of a text, each with its line feed."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    ends = np.flatnonzero(points == 10) + 1
    if not len(ends) or ends[-1] != len(points):
        ends = np.append(ends, len(points))
    return np.concatenate([[0], ends])


def attribute(docs: DataFrame, definition: str, sections: str | None = None, rule: str = "first", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every section of every document: doc_id, section, name, begin, end, n_tokens."""
    if rule not in ("first", "last"):
        raise ValueError("rule is 'first' or 'last'")
    spark = runtime.ship(docs.sparkSession)
    shared = spark.sparkContext.broadcast(definition)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(shared.value)
        lengths = enc.byte_lengths()
        for batch, held in tokens.portions(batches, "text"):
            parts: list[tuple] = []
            given = batch.column(2).to_pylist() if sections else [None] * len(held)
            for doc, text, ids, spans in zip(batch.column(0).to_pylist(), held, enc.encode(held), given):
                at = token_chars(enc, lengths, text, ids, rule)
                if sections is None:
                    bounds = lines(text)
                    begin, end = bounds[:-1], bounds[1:]
                    names: list = [None] * len(begin)
                else:
                    known = sorted((s for s in spans or [] if s and s["begin"] is not None and s["end"] is not None), key=lambda s: s["begin"])
                    begin, end = np.array([s["begin"] for s in known], np.int64), np.array([s["end"] for s in known], np.int64)
                    names = [s["name"] for s in known]
                where = np.searchsorted(begin, at, side="right") - 1
                if len(begin):
                    where[(where >= 0) & (at >= end[np.maximum(where, 0)])] = -1
                n = np.bincount(where + 1, minlength=len(begin) + 1)
                parts.append((doc, range(len(begin)), names, begin, end, n[1:]))
                if n[0]:
                    parts.append((doc, [-1], [None], [0], [len(text)], [n[0]]))
            joined = [np.concatenate([np.asarray(p[k], np.int64) for p in parts]) if parts else [] for k in (1, 3, 4, 5)]
            columns = [[p[0] for p in parts for _ in p[1]], joined[0], [x for p in parts for x in p[2]], *joined[1:]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)

    chosen = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")] + ([F.col(sections).alias("sections")] if sections else [])
    return docs.select(*chosen).mapInArrow(run, SCHEMA)
