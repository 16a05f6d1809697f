"""Substring dedup by hashing units of text: sentences within lines, lines, or paragraphs.

A unit is normalised (lower case, single spaces) and hashed to 128 bits. Digests are grouped over all
documents by partial aggregates; the occurrence in the row of the lowest rank stays, and within
that row the first. Rows rank by document id, then as they come. Removed are runs of successive repeated units that together have at least
``min_words`` words, so a long passage goes whole though some of its sentences are short, and a short
sentence that documents share by chance stays. Offsets are those of the original text. Sentences are
the default unit because a shared passage may stand amid a line.

Defined results: null and empty texts have no units; a null document id ranks after all others; every row is a document of its
own, whether its id is null or that of other rows: of repeated rows the first stays whole; an empty table gives no row;
extra columns are passed through by ``dedup`` whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary import runtime
from granary.llm import tokens

UNITS = {
    "sentence": re.compile(r"\S[^\n.!?。！？]*(?:[.!?。！？]+(?=[^\s.!?。！？])[^\n.!?。！？]*)*[.!?。！？]*"),
    "line": re.compile(r"\S[^\n]*"),
    "paragraph": re.compile(r"\S[^\n]*(?:\n(?![ \t]*(?:\n|\Z))[^\n]*)*"),
}
#: A unit of more words is cut further, after words that a hash picks (one of four), so that what two long units share
#: falls into the same parts. A part has at least SHORT words, but for the last.
LONG, SHORT = 24, 3
_word = re.compile(r"\S+")
#: Rows without an id rank from here on; where ids are repeated or as high, a rank is the id and the row's number in one decimal.
NAMELESS = 1 << 62


def split(text: str, pattern: re.Pattern) -> Iterator[tuple[int, int, list[str]]]:
    """(begin, end, normalised words) of the units of a text."""
    for m in pattern.finditer(text):
        words = m.group().lower().split()
        if len(words) <= LONG:
            yield m.start(), m.end(), words
            continue
        held: list[str] = []
        begin = end = m.start()
        for w in _word.finditer(text, m.start(), m.end()):
            begin = begin if held else w.start()
            end = w.end()
            held.append(w.group().lower())
            if len(held) >= SHORT and zlib.crc32(held[-1].encode("utf-8", "replace")) % 4 == 0:
                yield begin, end, held
                held = []
        if held:
            yield begin, end, held


def _big(n: int, digits: int = 38) -> Column:
    """An integer that a long may not hold."""
    return F.lit(str(n)).cast(f"decimal({digits},0)")


def ranked(docs: DataFrame, rank: str, id_col: str = "doc_id") -> DataFrame:
    """The rows with a distinct rank: the id if all ids differ, else the id and the number of the row, of rows stored so that every read sees the same numbers."""
    id_ = F.col(id_col).cast("long")
    ids = docs.select(id_.alias("id")).groupBy("id").agg(F.count("*").alias("n")).agg(F.max(F.when(F.col("id").isNull(), F.col("n"))).alias("nameless"), F.max(F.when(F.col("id").isNotNull(), F.col("n"))).alias("n"), F.max("id").alias("top")).first()
    plain = (ids["n"] or 0) <= 1 and (ids["top"] or 0) < NAMELESS
    if plain and not ids["nameless"]:
        return docs.withColumn(rank, id_)
    row = F.monotonically_increasing_id()
    if not plain:
        big = lambda c: c.cast("decimal(38,0)")
        row = (F.coalesce(big(id_) + _big(1 << 63), _big(1 << 64)) * _big(NAMELESS, 19) + big(row)).cast("decimal(38,0)")
        return runtime.materialize(docs.withColumn(rank, row), "ranked")
    return runtime.materialize(docs.withColumn(rank, F.coalesce(id_, F.lit(NAMELESS) + row)), "ranked")


def _id_of(rank: Column, kind: str) -> Column:
    """The document id in a rank."""
    if kind == "bigint":
        return F.when(rank < NAMELESS, rank)
    high = F.floor(rank / _big(NAMELESS, 19)).cast("decimal(38,0)")
    return F.when(high < _big(1 << 64), (high - _big(1 << 63)).cast("long"))


def units(rows: DataFrame, unit: str, rank: str, text_col: str) -> DataFrame:
    """Every unit of every text with its digest; ``first``: no earlier unit of the same text has that digest."""
    runtime.ship(rows.sparkSession)
    pattern = UNITS[unit].pattern
    kind = rows.schema[rank].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest as digest

        find = re.compile(pattern)
        for batch, held in tokens.portions(batches, "text", 400_000):
            counts, no, begin, end, words, raw, first = [], [], [], [], [], [], []
            for text in held:
                seen: set[bytes] = set()
                n = 0
                for a, b, w in split(text, find):
                    d = digest(" ".join(w).encode("utf-8", "replace"))
                    no.append(n)
                    begin.append(a)
                    end.append(b)
                    words.append(len(w))
                    raw.append(d)
                    first.append(d not in seen)
                    seen.add(d)
                    n += 1
                counts.append(n)
            h = np.frombuffer(b"".join(raw), "<i8").reshape(-1, 2)
            who = batch.column(0).take(pa.array(np.repeat(np.arange(len(held)), counts)))
            yield pa.RecordBatch.from_arrays([who, pa.array(h[:, 0]), pa.array(h[:, 1]), *(pa.array(x, pa.int32()) for x in (no, begin, end, words)), pa.array(first, pa.bool_())], names=["rank", "h1", "h2", "no", "begin", "end", "words", "first"])

    return rows.select(F.col(rank).alias("rank"), F.col(text_col).alias("text")).mapInArrow(run, f"rank {kind}, h1 long, h2 long, no int, begin int, end int, words int, first boolean")


def spans(rows: DataFrame, unit: str, min_words: int, rank: str, text_col: str) -> DataFrame:
    """Spans to remove: rank, begin, end, words, units, keepers (the ranks of the rows that keep the same units)."""
    every = units(rows, unit, rank, text_col)
    kept = every.groupBy("h1", "h2").agg(F.min("rank").alias("keeper"), F.count("*").alias("n")).where("n > 1").select("h1", "h2", "keeper")
    # Stored, so that both sides of the join are plain exchanges and a digest with very many occurrences can be split.
    kept = runtime.materialize(kept, "repeated-units")
    again = every.join(kept, ["h1", "h2"]).where("not (rank = keeper and first)").select("rank", "no", "begin", "end", "words", "keeper")
    order = Window.partitionBy("rank").orderBy("no")
    runs = again.withColumn("run", F.col("no") - F.row_number().over(order)).groupBy("rank", "run").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.sum("words").alias("words"), F.count("*").alias("units"), F.array_sort(F.collect_set("keeper")).alias("keepers"))
    return runs.where(F.col("words") >= min_words).drop("run")


def repeats(docs: DataFrame, unit: str = "sentence", min_words: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans to remove: doc_id, begin, end, words, units, kept_doc_ids (documents that keep the same units)."""
    rank = runtime.fresh("granary_rank", docs)
    rows = ranked(docs.select(id_col, text_col), rank, id_col)
    kind = rows.schema[rank].dataType.simpleString()
    found = spans(rows, unit, min_words, rank, text_col)
    return found.select(_id_of(F.col("rank"), kind).alias("doc_id"), "begin", "end", "words", "units", F.transform("keepers", lambda k: _id_of(k, kind)).alias("kept_doc_ids"))


def dedup(docs: DataFrame, unit: str = "sentence", min_words: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with repeated spans cut from their texts; all rows and columns stay."""
    own, key, rank = (runtime.fresh(f"granary_{n}", docs) for n in ("spans", "key", "rank"))
    rows = ranked(docs, rank, id_col)
    found = spans(rows, unit, min_words, rank, text_col).groupBy("rank").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias(own)).withColumnRenamed("rank", key)
    ends = F.concat(F.array(F.lit(0)), F.transform(own, lambda s: s["end"]))
    begins = F.concat(F.transform(own, lambda s: s["begin"]), F.array(F.length(text_col)))
    pieces = F.transform(F.arrays_zip(ends.alias("b"), begins.alias("e")), lambda p: F.substring(F.col(text_col), p["b"] + 1, p["e"] - p["b"]))
    cut = F.when(F.col(own).isNull(), F.col(text_col)).otherwise(F.array_join(pieces, ""))
    return rows.join(found, rows[rank] == found[key], "left").withColumn(text_col, cut).select(*docs.columns)
