"""Exact top-k search by inner product over a bit-sliced index.

Vectors are quantised to integers. The index holds, for each block of rows, each attribute as bitmaps:
slice s has bit s of the attribute less its least value in the block. A query is evaluated with bitmap
arithmetic: for each signed binary digit of a weight, the attribute's slices are added at that shift (complemented where the digit is negative), three numbers to two by carry-save steps, then by one ripple of carries.
From the slices of the sum the top rows are chosen from the most significant slice downward; rows tied
at the boundary are ordered by their ids. Each block gives its own k best, so the global k best follow
from them exactly.

The index is a stored table of such blocks, dealt over groups of at most ``GROUP`` blocks. Queries are a table too, packed ``query_block`` to a row; every group
gets every row of it, after its own blocks, and answers them as they stream past. Nothing of either reaches the driver.

Defined results: a vector that is null, or has a null or non-finite component, takes no part, and neither does one without
an id or a component; vectors of different lengths have no inner product, so each length is searched by itself; with fewer than k candidates all are returned; rows of
equal id are candidates each, and none of them for a query of that id; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary import runtime

#: Rows of an index block, components of a block of either kind, blocks that one task holds.
ROWS, CELLS, GROUP = 1 << 16, 1 << 22, 16
BLOCK = "part int, side byte, dims int, ids binary, low binary, payload binary"
NAMES = ["part", "side", "dims", "ids", "low", "payload"]


def quantized(vectors: DataFrame, scale: float, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, q): floor(scale * x) of each component as long, of the vectors that take part."""
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & whole).select("vec_id", F.transform("v", lambda x: F.floor(F.lit(scale) * x).cast("long")).alias("q"))


class Slices:
    """The bit-sliced index of one block of rows: ids, least values, and slices of dims x bits x words."""

    def __init__(self, ids: np.ndarray, low: np.ndarray, slices: np.ndarray):
        self.ids, self.low, self.slices = ids, low, slices
        self.n, (self.dims, self.bits, words) = len(ids), slices.shape
        filled = np.zeros(words * 64, np.uint8)
        filled[: self.n] = 1
        self.full = np.packbits(filled, bitorder="little").view("<u8")

    @classmethod
    def of(cls, ids: np.ndarray, q: np.ndarray) -> "Slices":
        order = np.argsort(ids, kind="stable")
        ids, q = ids[order], q[order]
        n, dims = q.shape
        low = q.min(axis=0)
        x = (q - low).astype(np.uint64)
        bits = max(1, int(x.max()).bit_length())
        slices = np.zeros((dims, bits, -(-n // 64)), np.uint64)
        for s in range(bits):
            plane = np.zeros((dims, slices.shape[2] * 64), np.uint8)
            plane[:, :n] = ((x >> np.uint64(s)) & np.uint64(1)).T
            slices[:, s] = np.packbits(plane, axis=1, bitorder="little").view("<u8")
        return cls(ids, low, slices)

    def scores(self, weights: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Bitmaps of the score less a constant, least significant first, and that constant."""
        by_shift: dict[int, list[np.ndarray]] = {}
        constant = int(weights @ self.low)
        top = (1 << self.bits) - 1
        for j, w in enumerate(weights.tolist()):
            planes, other, shift = self.slices[j], None, 0
            while w:
                if w & 1:  # signed digits without two in a row: fewest additions
                    digit = 2 - (w % 4)
                    w -= digit
                    if digit < 0:
                        other = ~planes if other is None else other
                        constant -= top << shift
                    by_shift.setdefault(shift, []).append(planes if digit > 0 else other)
                w >>= 1
                shift += 1
        columns: dict[int, list[np.ndarray]] = {}
        # Stacks of equal height are added three to two, all their slices at once, until none is carried on.
        carried: list[np.ndarray] = []
        shift, last = -1, max(by_shift, default=-1)
        while shift < last or carried:
            shift += 1
            stack, carried = by_shift.get(shift, []) + carried, []
            while len(stack) > 2:
                left = []
                for k in range(0, len(stack) - 2, 3):
                    a, b, c = stack[k : k + 3]
                    t = a ^ b
                    left.append(t ^ c)
                    t &= c
                    t |= a & b
                    carried.append(t)
                stack = left + stack[len(stack) - len(stack) % 3 :]
            for planes in stack:
                columns_add(columns, shift, planes)
        out: list[np.ndarray] = []
        at = min(columns, default=0)
        out = [np.zeros_like(self.full) for _ in range(at)]
        while any(k >= at for k in columns):
            held = columns.pop(at, [])
            while len(held) > 1:
                if len(held) > 2:
                    a, b, c = held.pop(), held.pop(), held.pop()
                    t = a ^ b
                    held.insert(0, t ^ c)
                    columns.setdefault(at + 1, []).append((a & b) | (t & c))
                else:
                    a, b = held.pop(), held.pop()
                    held.append(a ^ b)
                    columns.setdefault(at + 1, []).append(a & b)
            out.append(held[0] if held else np.zeros_like(self.full))
            at += 1
        return out, constant

    def top(self, weights: np.ndarray, k: int, without: int) -> list[tuple[int, int]]:
        """The k best (id, score) by score, then id; rows with the id ``without`` take no part."""
        planes, constant = self.scores(weights)
        alive = self.full.copy()
        lo, hi = np.searchsorted(self.ids, [without, without + 1] if without < (1 << 63) - 1 else [without, without])
        for r in range(lo, hi):
            alive[r >> 6] &= ~(np.uint64(1) << np.uint64(r & 63))
        sure, wanted = np.zeros_like(alive), k
        for plane in reversed(planes):
            if wanted <= 0:
                break
            ones = alive & plane
            n = int(np.bitwise_count(ones).sum())
            if n >= wanted:
                alive = ones
            elif n:
                sure |= ones
                alive &= ~plane
                wanted -= n
        rows = np.concatenate([_members(sure), _members(alive)[: max(wanted, 0)]])
        word, bit = rows >> 6, (rows & 63).astype(np.uint64)
        score = np.full(len(rows), constant, np.int64)
        for s, plane in enumerate(planes):
            score += ((plane[word] >> bit) & np.uint64(1)).astype(np.int64) << s
        return sorted(((int(self.ids[r]), int(v)) for r, v in zip(rows, score)), key=lambda x: (-x[1], x[0]))[:k]


def columns_add(columns: dict[int, list[np.ndarray]], shift: int, planes: np.ndarray) -> None:
    for s, plane in enumerate(planes):
        columns.setdefault(shift + s, []).append(plane)


def _members(bitmap: np.ndarray) -> np.ndarray:
    """Positions of the set bits, ascending."""
    words = np.flatnonzero(bitmap)
    bits = np.unpackbits(bitmap[words].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    w, b = np.nonzero(bits)
    return words[w] * 64 + b


def _blocks(rows: DataFrame, most: int, index: bool) -> DataFrame:
    """Rows of each length, at most ``most`` (and about ``CELLS`` components) of them to a block: part, side, dims, ids, low, payload; low is null where the payload is the vectors themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def block(dims: int) -> pa.RecordBatch:
            ids, q = (np.concatenate(x) for x in zip(*held.pop(dims)))
            made = Slices.of(ids, q) if index else None
            raw = [made.ids, made.low, made.slices] if made else [ids, None, q]
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([0 if index else 1], pa.int8()), pa.array([dims], pa.int32()), *(pa.array([x if x is None else np.ascontiguousarray(x).astype(x.dtype.newbyteorder("<")).tobytes()], pa.binary()) for x in raw)], names=NAMES)

        for batch in batches:
            ids, q = batch.column(0).to_numpy(), batch.column(1)
            sizes = pc.list_value_length(q).to_numpy()
            flat, ends = q.flatten().to_numpy(), np.cumsum(sizes)
            for dims in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dims)
                held.setdefault(dims, []).append((ids[at], flat[(ends[at] - dims)[:, None] + np.arange(dims)]))
                if sum(len(x) for x, _ in held[dims]) >= min(most, max(64, CELLS // dims)):
                    yield block(dims)
        for dims in list(held):
            yield block(dims)

    return rows.mapInArrow(run, BLOCK)


def _answers(k: int):
    """Of rows that come by part, its index blocks before the queries: (query_id, vec_id, score), the k best of each block for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, index = -1, []
        for batch in batches:
            for part, side, dims, ids, low, payload in zip(*(c.to_pylist() for c in batch.columns)):
                if part != at:
                    at, index = part, []
                names = np.frombuffer(ids, "<i8")
                if side == 0:
                    words = -(-len(names) // 64)
                    index.append(Slices(names, np.frombuffer(low, "<i8"), np.frombuffer(payload, "<u8").reshape(dims, -1, words)))
                    continue
                weights = np.frombuffer(payload, "<i8").reshape(-1, dims)
                for block in (b for b in index if b.dims == dims):
                    found = [(int(q), *hit) for q, w in zip(names, weights) for hit in block.top(w, k, int(q))]
                    yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.int64()) for c in range(3)], names=["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, query_ids: str = "vec_id % 50 = 0", k: int = 5, scale: float = 256.0, query_block: int = 512, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each row whose id satisfies ``query_ids``."""
    spark = runtime.ship(vectors.sparkSession)
    rows = runtime.materialize(quantized(vectors, scale, id_col, vector_col).where(F.size("q") > 0), "quantized")
    total = rows.count()
    index = _blocks(rows.repartition(max(1, -(-total // ROWS), min(runtime.partitions(spark), -(-total // 8192)))), ROWS, index=True)
    index = runtime.materialize(index, "index")
    last = index.agg(F.max("part")).first()[0]
    groups = 1 if last is None else -(-(last + 1) // max(1, min(GROUP, (last + 1) // runtime.partitions(spark))))
    asked = _blocks(rows.where(query_ids), query_block, index=False).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select(*NAMES)
    dealt = index.withColumn("part", F.pmod("part", F.lit(groups))).unionByName(asked)
    out = dealt.repartition(groups, "part").sortWithinPartitions("part", "side").mapInArrow(_answers(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
