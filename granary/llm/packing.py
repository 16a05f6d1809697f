"""Packing: documents into sequences of a fixed length, by bounded-space online best fit.

Each input partition keeps at most ``windows`` open windows. A document's whole windows leave at once;
what remains goes to the open window with the least room that holds it. Where none holds it, the
fullest window is filled with its first ids and leaves, and the rest is placed anew. The windows still
open at the end are joined end to end, first within the partition, then over groups of ``FAN``
partitions, and so on, so one padded sequence is left for the whole input and no task ever sees more
than ``FAN`` unfinished windows.

Defined results: a null or empty text is the end id alone; a null document id is kept as null; repeated
rows are packed each for itself; an empty table gives no piece; extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary import runtime
from granary.llm import tokens

FAN = 256
SCHEMA = "doc_id long, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long, part long, done boolean"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("part", pa.int64()), ("done", pa.bool_())])

#: A piece: document, start in it, the document's ids in all, the piece's ids.
Piece = tuple[int | None, int, int, np.ndarray]


class Packer:
    """Bounded-space best fit; ``finished`` gathers whole windows as lists of pieces."""

    def __init__(self, size: int, windows: int):
        self.size, self.windows = size, windows
        self.open: list[tuple[int, list[Piece]]] = []
        self.finished: list[list[Piece]] = []

    def add(self, piece: Piece) -> None:
        doc, start, total, ids = piece
        while len(ids) >= self.size:
            self.finished.append([(doc, start, total, ids[: self.size])])
            start, ids = start + self.size, ids[self.size :]
        while len(ids):
            fits = [k for k, (used, _) in enumerate(self.open) if used + len(ids) <= self.size]
            if fits:
                k = max(fits, key=lambda i: self.open[i][0])
                used, held = self.open[k]
                self.open[k] = (used + len(ids), [*held, (doc, start, total, ids)])
                if self.open[k][0] == self.size:
                    self.finished.append(self.open.pop(k)[1])
                return
            if len(self.open) < self.windows:
                self.open.append((len(ids), [(doc, start, total, ids)]))
                return
            used, held = self.open.pop(max(range(len(self.open)), key=lambda i: self.open[i][0]))
            room = self.size - used
            self.finished.append([*held, (doc, start, total, ids[:room])])
            start, ids = start + room, ids[room:]

    def close(self) -> list[Piece]:
        """Join the open windows end to end; what fills no whole window is returned."""
        left = join([p for _, held in self.open for p in held], self.size, self.finished)
        self.open = []
        return left


def join(pieces: list[Piece], size: int, finished: list[list[Piece]]) -> list[Piece]:
    """Lay pieces end to end and cut every ``size`` ids; the unfinished window is returned."""
    now: list[Piece] = []
    used = 0
    for doc, start, total, ids in pieces:
        while len(ids):
            take = min(len(ids), size - used)
            now.append((doc, start, total, ids[:take]))
            start, ids, used = start + take, ids[take:], used + take
            if used == size:
                finished.append(now)
                now, used = [], 0
    return now


def _rows(windows: list[list[Piece]], level: int, part: int, first: int, done: bool) -> pa.RecordBatch:
    cols: list[list] = [[] for _ in _ARROW]
    for n, window in enumerate(windows):
        at = 0
        for doc, start, total, ids in window:
            for col, v in zip(cols, (doc, start, len(ids), total, ids.astype("<u4").tobytes(), (level << 58) | (part << 28) | (first + n), at, part, done)):
                col.append(v)
            at += len(ids)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW)], schema=_ARROW)


def pack(docs: DataFrame, definition: str, size: int = 1024, end_id: int = 0, windows: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents: doc_id, start, length, doc_tokens, ids (little-endian uint32), sequence_id, offset."""
    spark = runtime.ship(docs.sparkSession)
    shared = spark.sparkContext.broadcast(definition)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer, part, sent = tokens.encoder(shared.value), Packer(size, windows), TaskContext.get().partitionId(), 0
        for batch, held in tokens.portions(batches, "text"):
            for doc, ids in zip(batch.column(0).to_pylist(), enc.encode(held)):
                ids = np.append(ids, np.uint32(end_id))
                packer.add((doc, 0, len(ids), ids))
            yield _rows(packer.finished, 0, part, sent, True)
            sent += len(packer.finished)
            packer.finished = []
        left = packer.close()
        yield _rows(packer.finished, 0, part, sent, True)
        yield _rows([left] * bool(left), 0, part, sent + len(packer.finished), False)

    def again(level: int, last: bool):
        def merged(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            rows = table.sort_by([("part", "ascending"), ("sequence_id", "ascending"), ("offset", "ascending")]).to_pylist()
            whole: list[list[Piece]] = []
            left = join([(r["doc_id"], r["start"], r["doc_tokens"], np.frombuffer(r["ids"], "<u4")) for r in rows], size, whole)
            part = rows[0]["part"] // FAN
            return pa.Table.from_batches([_rows(whole, level, part, 0, True), _rows([left] * bool(left), level, part, len(whole), last)])

        return merged

    out = runtime.materialize(texts.mapInArrow(first, SCHEMA), "pack")
    done, left, level = [out.where("done")], out.where("not done"), 0
    groups = (left.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        groups, level = -(-groups // FAN), level + 1
        merged = left.groupBy(F.expr(f"part div {FAN}")).applyInArrow(again(level, groups == 1), SCHEMA)
        if groups == 1:
            done.append(merged)
            break
        done.append(merged.where("done"))
        left = merged.where("not done")
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionByName(more)
    return whole.drop("part", "done")


def digests(pieces: DataFrame) -> DataFrame:
    """The pieces with a crc32 in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
