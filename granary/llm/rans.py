"""Token-ID output: static range asymmetric numeral coding of token ids, in blocks that decode on their own.

One frequency table, counted over all ids, serves every block. A block's ids are dealt to ``LANES``
interleaved lanes, whose 64-bit states step together. Every ``EVERY`` steps a checkpoint keeps all
states and the position in the words, so a block can be decoded from several places at once, and each
span between checkpoints has a crc32 of its ids.

Block layout (little-endian): magic ``GRB1``, lanes u32, ids u64, words u64, checkpoints u32; then for
each checkpoint its first word u64, crc32 u32 and ``lanes`` states u64; then the words u32.

Files: a folder with ``blocks``, the blocks as rows of Parquet files (executors reach a remote store only through Spark's writers), and
``table``, one row with the frequency table, for each id its share of 2**20 as u32 (0 if it never occurs), and its crc32. ``read`` needs
nothing but the folder.

Defined results: a null or empty text is the end id alone; null document ids come first; rows of equal
document id lie in the order of their token ids; an empty table gives no block; extra columns are ignored.

A corpus with more than 2**20 different ids has no table and raises: each id that occurs needs a share of one at least.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary import runtime
from granary.llm import tokens

BITS, LOW = 20, 31
LANES, EVERY = 1024, 256
BLOCK_IDS = 1 << 20
_HEAD = struct.Struct("<4sIQQI")
TABLE = "shares binary, crc long"
BLOCKS = "shard int, block int, before long, doc_ids array<long>, lengths array<long>, n_ids long, payload binary"


def shares(counts: np.ndarray) -> np.ndarray:
    """Scale counts to integers that sum to 2**BITS, at least 1 where the count is not 0."""
    counts = np.asarray(counts, np.float64)
    there = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint32)
    if not len(there):
        return out
    room = (1 << BITS) - len(there)
    if room < 0:
        raise ValueError("more distinct ids than the table has room for")
    part = counts[there] / counts[there].sum() * room
    whole = np.floor(part).astype(np.int64)
    rest = room - int(whole.sum())
    whole[np.argsort(-(part - whole), kind="stable")[:rest]] += 1
    out[there] = whole + 1
    return out


class Coder:
    def __init__(self, share: np.ndarray):
        self.share = share.astype(np.uint64)
        self.base = np.concatenate([[0], np.cumsum(self.share)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(share), dtype=np.uint32), share)

    def encode(self, ids: np.ndarray) -> bytes:
        n = len(ids)
        lanes = max(1, min(LANES, n))
        steps = -(-n // lanes)
        x = np.full(lanes, 1 << LOW, np.uint64)
        words: list[np.ndarray] = []
        states: dict[int, np.ndarray] = {}
        f_all, c_all = self.share[ids], self.base[ids]
        if n and not f_all.all():
            raise ValueError("an id without a share")
        limit_all = f_all << np.uint64(LOW - BITS + 32)
        full = np.uint64(32)
        for t in range(steps - 1, -1, -1):
            k = min(lanes, n - t * lanes)
            f, c, y = f_all[t * lanes : t * lanes + k], c_all[t * lanes : t * lanes + k], x[:k]
            over = y >= limit_all[t * lanes : t * lanes + k]
            words.append(y[over].astype(np.uint32))
            y = np.where(over, y >> full, y)
            q = y // f
            x[:k] = (q << np.uint64(BITS)) + (y - q * f) + c
            if t % EVERY == 0:
                states[t] = x.copy()
        words.reverse()
        starts = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        out = [_HEAD.pack(b"GRB1", lanes, n, int(starts[-1]), len(states))]
        for t in sorted(states):
            span = ids[t * lanes : (t + EVERY) * lanes]
            out += [struct.pack("<QI", int(starts[t]), zlib.crc32(span.astype("<u4").tobytes())), states[t].astype("<u8").tobytes()]
        return b"".join([*out, *(w.astype("<u4").tobytes() for w in words)])

    def spans(self, payload: bytes) -> int:
        """How many spans of the block can be decoded independently."""
        return _HEAD.unpack_from(payload)[4]

    def decode(self, payload: bytes, span: int | None = None) -> np.ndarray:
        """All ids of a block, or those of one span; checks the crc32."""
        magic, lanes, n, n_words, marks = _HEAD.unpack_from(payload)
        if magic != b"GRB1":
            raise ValueError("not a block")
        size = 12 + 8 * lanes
        body = _HEAD.size + marks * size
        words = np.frombuffer(payload, "<u4", n_words, body)
        chosen = range(marks) if span is None else [span]
        parts = []
        for m in chosen:
            at, crc = struct.unpack_from("<QI", payload, _HEAD.size + m * size)
            x = np.frombuffer(payload, "<u8", lanes, _HEAD.size + m * size + 12).astype(np.uint64)
            lo, hi = m * EVERY * lanes, min(n, (m + 1) * EVERY * lanes)
            out = np.empty(hi - lo, np.uint32)
            for b in range(lo, hi, lanes):
                k = min(lanes, hi - b)
                y = x[:k]
                slot = y & np.uint64((1 << BITS) - 1)
                s = self.symbol[slot]
                out[b - lo : b - lo + k] = s
                y = self.share[s] * (y >> np.uint64(BITS)) + slot - self.base[s]
                need = np.flatnonzero(y < np.uint64(1 << LOW))
                y[need] = (y[need] << np.uint64(32)) | words[at : at + len(need)]
                at += len(need)
                x[:k] = y
            if zlib.crc32(out.astype("<u4").tobytes()) != crc:
                raise ValueError("checksum of a span does not match")
            parts.append(out)
        return np.concatenate(parts) if parts else np.empty(0, np.uint32)


def _narrow(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def tokenize(docs: DataFrame, definition: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """Ids of every document with the end id, as a stored table, and the type of one id there."""
    spark = runtime.ship(docs.sparkSession)
    kind = _narrow(max(end_id + 1, tokens.encoder(definition).tokenizer.get_vocab_size()))
    shared = spark.sparkContext.broadcast(definition)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(shared.value)
        for batch, held in tokens.portions(batches, "text"):
            ids = [np.append(x, end_id).astype(kind).tobytes() for x in enc.encode(held)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return runtime.materialize(rows.mapInArrow(run, "doc_id long, ids binary"), "ids"), kind


def frequencies(ids: DataFrame, kind: str, vocabulary: int) -> np.ndarray:
    """Counts of each id over all documents; only one row for each id reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), kind), minlength=vocabulary)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": pa.array(there, pa.int32()), "n": pa.array(total[there], pa.int64())})

    out = np.zeros(vocabulary, np.int64)
    for r in ids.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


def write(docs: DataFrame, definition: str, path: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write all ids in ascending document order; returns the folder of the files.

    Shard k holds the k-th range of document ids, a block some whole documents of it. Without a path the
    files go to the shared scratch folder.
    """
    spark = docs.sparkSession
    ids, kind = tokenize(docs, definition, end_id, id_col, text_col)
    share = shares(frequencies(ids, kind, max(end_id + 1, tokens.encoder(definition).tokenizer.get_vocab_size())))
    shared = spark.sparkContext.broadcast(share)
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard, block = Coder(shared.value), TaskContext.get().partitionId(), 0
        names: list = []
        held: list[np.ndarray] = []
        size = before = 0

        def flush() -> pa.RecordBatch:
            payload = coder.encode(np.concatenate(held).astype(np.uint32))
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((shard, block, before, names, [len(x) for x in held], size, payload), schema)], schema=schema)

        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                names.append(doc)
                held.append(np.frombuffer(raw, kind))
                size += len(held[-1])
                if size >= BLOCK_IDS:
                    yield flush()
                    names, held, before, size, block = [], [], before + size, 0, block + 1
        if held:
            yield flush()

    # The first ids part rows of one document id, or of none, into ranges too.
    first = F.substring("ids", 1, 32)
    blocks = ids.repartitionByRange(runtime.partitions(spark), "doc_id", first).sortWithinPartitions("doc_id", "ids").mapInArrow(run, BLOCKS)
    path = path or runtime.scratch_path(spark, "token-files")
    blocks.write.parquet(f"{path}/blocks")
    raw = share.astype("<u4").tobytes()
    spark.createDataFrame([(bytearray(raw), zlib.crc32(raw))], TABLE).coalesce(1).write.parquet(f"{path}/table")
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    """Decode the files of a folder: doc_id, start, n_tokens, ids (little-endian uint32) of every document.

    A block knows how many ids lie before it in its shard; only one total for each shard reaches the driver. No shuffle.
    """
    runtime.ship(spark)
    blocks, table = spark.read.schema(BLOCKS).parquet(f"{path}/blocks"), spark.read.schema(TABLE).parquet(f"{path}/table").first()
    if zlib.crc32(table["shares"]) != table["crc"]:
        raise ValueError("checksum of the frequency table does not match")
    share = np.frombuffer(table["shares"], "<u4")
    totals = {r["shard"]: r["n"] for r in blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()}
    first, at = {}, 0
    for shard in sorted(totals):
        first[shard] = at
        at += totals[shard]
    shared = spark.sparkContext.broadcast((share, first))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, first = shared.value
        coder = Coder(share)
        for batch in batches:
            for i in range(batch.num_rows):
                shard, _, before, docs, lengths, _, payload = (batch.column(c)[i].as_py() for c in range(7))
                ids = coder.decode(payload).astype("<u4")
                ends = np.cumsum(lengths)
                parts = [ids[e - n : e].tobytes() for e, n in zip(ends.tolist(), lengths)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(ends - lengths + before + first[shard], pa.int64()), pa.array(lengths, pa.int64()), pa.array(parts, pa.binary())], schema=schema)

    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
