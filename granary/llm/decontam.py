"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

Documents are the domains, benchmark items the queries: an item is found in a document if at least
``threshold`` of its shingles of ``width`` words occur there. Shingles are hashed, and an item's sketch is its
``m`` least hashes, where m - 1 is the number of shingles it may lack: of any m shingles a document that contains the item has
at least one, so sketches lose nothing, however long the document is. (Banded signatures of fixed length would: of an item of 20 shingles in a document of
2,000 the Jaccard similarity is 0.008, which 256 hashes miss in 13 % of cases.) Items are partitioned by size, in
powers of two, and the class sets how long its sketches are and what a document's are: none at all where the document has fewer shingles than the least of the class needs, else its hashes
up to the greatest of the class, and of those the ones whose last bits a sketch of the class has. So a class that cannot match costs a comparison, and the others look up a few hashes in a hundred
(``pruning`` measures it), however many items there are. Items that share a hash of the sketches are candidates, verified by exact containment over all shingles of both.

Items are broadcast in blocks of at most ``block_chars`` characters of text on average; a larger
benchmark takes more blocks, and the documents are scanned once for each.

Defined results: an item of fewer than ``width`` words is one shingle of all its words; one without a word, or null, is
never found; null and empty documents hold nothing; null document ids are kept; repeated items and rows give one match
for each pair of ids, that of the greatest containment, then of the first span; empty tables give no row; extra columns are passed through by ``clean`` and ignored by ``matches``.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary import runtime
from granary.llm import tokens

_words = re.compile(r"[^\W_]+")
SCHEMA = "doc_id long, item_id long, containment double, shared int, item_shingles int, begin int, end int"


@dataclass
class Partition:
    """Items of one size class and width of shingles: hashes of their sketches, ascending, the items of each, and the fewest shingles that one of them needs."""

    width: int
    least: int
    hashes: np.ndarray
    items: list[list[int]]

    def __post_init__(self):
        # One entry for each value of a hash's last bits: whether a sketch has such a hash. At most one in sixteen is set.
        self.bits = min(24, max(8, (16 * len(self.hashes)).bit_length()))
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[self._slot(self.hashes)] = True

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def sketch(self, own: np.ndarray) -> np.ndarray:
        """A document's sketch for this class: none if it has fewer shingles than any item here needs, else its hashes up to the greatest of the class whose last bits the class has."""
        if len(own) < self.least:
            return own[:0]
        own = own[own <= self.hashes[-1]]
        return own[self.seen[self._slot(own)]]

    def candidates(self, own: np.ndarray) -> set[int]:
        """Items whose sketches share a hash with a document's."""
        sketch = self.sketch(own)
        if not len(sketch):
            return set()
        at = np.minimum(np.searchsorted(self.hashes, sketch), len(self.hashes) - 1)
        return {k for i in np.unique(at[self.hashes[at] == sketch]).tolist() for k in self.items[i]}


class Index:
    """Items of one block: shingles numbered over the block, and the partitions of their sketches."""

    def __init__(self, items: list[tuple[int, str]], width: int = 5, threshold: float = 0.8, seed: int = 7):
        self.threshold = threshold
        self.vocabulary: dict[str, int] = {}
        grams: dict[tuple, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in _words.findall((text or "").lower())]
            w = min(width, len(ids))
            if w:
                own = {grams.setdefault(tuple(ids[k : k + w]), len(grams)) for k in range(len(ids) - w + 1)}
                self.items.append((item, np.array(sorted(own), np.int64)))
        #: For each width: sorted hashes, and in their order the numbers and words of the shingles.
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.hash = np.zeros(len(grams), np.uint64)
        widths = np.zeros(len(grams), np.int64)
        by_width = defaultdict(list)
        for g, n in grams.items():
            by_width[len(g)].append((g, n))
        while not self._numbered(by_width, widths, width, seed):
            seed += 1
        sketches: dict[tuple[int, int], dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        least: dict[tuple[int, int], int] = {}
        for k, (_, own) in enumerate(self.items):
            needed = int(np.ceil(threshold * len(own) - 1e-9))
            size = int(widths[own[0]]), len(own).bit_length()
            least[size] = min(least.get(size, needed), needed)
            part = sketches[size]
            for h in np.sort(self.hash[own])[: len(own) - needed + 1].tolist():
                part[h].append(k)
        self.partitions = [Partition(w, least[w, c], np.array(sorted(part), np.uint64), [part[h] for h in sorted(part)]) for (w, c), part in sorted(sketches.items())]

    def _numbered(self, by_width: dict[int, list], widths: np.ndarray, width: int, seed: int) -> bool:
        """Fill the tables of shingles; False if two of one width share a hash, which another seed tells apart."""
        self.mix = np.random.default_rng(seed).integers(1, 1 << 62, width, dtype=np.int64).astype(np.uint64) | np.uint64(1)
        for w, known in by_width.items():
            rows, numbers = np.array([g for g, _ in known], np.int64), np.array([n for _, n in known], np.int64)
            hashes = self._hashes(rows.T)
            order = np.argsort(hashes, kind="stable")
            if len(np.unique(hashes)) < len(hashes):
                return False
            self.tables[w] = hashes[order], numbers[order], rows[order]
            self.hash[numbers], widths[numbers] = hashes, w
        return True

    def _hashes(self, columns: np.ndarray) -> np.ndarray:
        out = np.zeros(columns.shape[1], np.uint64)
        for k, c in enumerate(columns):
            out += c.astype(np.uint64) * self.mix[k]
            out ^= out >> np.uint64(29)
            out *= np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(31))

    def shingles(self, text: str) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each width the hashes of a text's shingles, the words they begin with and their words; of those without a word that no item has, as the others are in no sketch."""
        ids = np.fromiter(map(self.vocabulary.get, _words.findall(text.lower()), repeat(0)), np.int64)
        known, out = ids > 0, {}
        for w in self.tables:
            n = len(ids) - w + 1
            if n < 1:
                continue
            whole = known[:n].copy()
            for k in range(1, w):
                whole &= known[k : k + n]
            at = np.flatnonzero(whole)
            if len(at):
                columns = np.stack([ids[at + k] for k in range(w)])
                out[w] = self._hashes(columns), at, columns.T
        return out

    def exact(self, held: dict[int, tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a text's shingles those that items have, word for word: their numbers, the words they begin with and the words they end with."""
        parts = [(np.empty(0, np.int64),) * 3]
        for w, (hashes, at, words) in held.items():
            table, number, rows = self.tables[w]
            where = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
            same = (table[where] == hashes) & (rows[where] == words).all(axis=1)
            parts.append((number[where[same]], at[same], at[same] + w - 1))
        return tuple(np.concatenate(x) for x in zip(*parts))

    def find(self, text: str) -> list[tuple[int, float, int, int, int, int]]:
        """Items in a text: id, containment, shared and all shingles of the item, characters begin to end of what it matches."""
        held = self.shingles(text)
        candidates = {k for p in self.partitions if p.width in held for k in p.candidates(held[p.width][0])}
        if not candidates:
            return []
        numbers, first, last = self.exact(held)
        own, out, spans = np.unique(numbers), {}, None
        for k in sorted(candidates):
            item, needed = self.items[k]
            shared = int(np.isin(needed, own).sum())
            if shared >= self.threshold * len(needed) - 1e-9:
                spans = spans or [m.span() for m in _lowered(text)]
                hit = np.isin(numbers, needed)
                row = (item, shared / len(needed), shared, len(needed), spans[first[hit].min()][0], spans[last[hit].max()][1])
                if item not in out or out[item][1] < row[1]:
                    out[item] = row
        return list(out.values())


def _lowered(text: str):
    """Words of a lower-cased text; offsets are those of the text unless lowering changes its length."""
    low = text.lower()
    return _words.finditer(low if len(low) == len(text) else text)


def blocks(benchmark: DataFrame, block_chars: int, item_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks whose size is checked before any of them is collected."""
    rows = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("text")).where("text is not null")
    size = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // block_chars))
    for k in range(n):
        yield [(r["item"], r["text"]) for r in rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).collect()]


def matches(docs: DataFrame, benchmark: DataFrame, width: int = 5, threshold: float = 0.8, block_chars: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """Every document that holds an item: doc_id, item_id, containment, shared, item_shingles, begin, end."""
    spark = runtime.ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for items in blocks(benchmark, block_chars, item_col, "text"):
        shared = spark.sparkContext.broadcast(Index(items, width, threshold))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch, held in tokens.portions(batches, "text"):
                rows = [(doc, *m) for doc, text in zip(batch.column(0).to_pylist(), held) for m in index.find(text)]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["doc_id", "item_id", "containment", "shared", "item_shingles", "begin", "end"])

        found = texts.mapInArrow(run, SCHEMA)
        out = found if out is None else out.unionByName(found)
    # Of rows of one document id, the one that holds most of the item, then that which begins first.
    best = F.min(F.struct((-F.col("containment")).alias("least"), "begin", "end", "shared", "item_shingles")).alias("m")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", (-F.col("m.least")).alias("containment"), *(f"m.{c}" for c in ("shared", "item_shingles", "begin", "end")))


def pruning(docs: DataFrame, benchmark: DataFrame, width: int = 5, threshold: float = 0.8, block_chars: int = 4_000_000, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """What each size class looks up: block, width, least (shingles needed), sketch_hashes, shingles (of documents, with words of items only), under_bound, looked_up, found."""
    spark = runtime.ship(docs.sparkSession)
    out = None
    for block, items in enumerate(blocks(benchmark, block_chars, item_col, "text")):
        shared = spark.sparkContext.broadcast(Index(items, width, threshold))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, block=block) -> Iterator[pa.RecordBatch]:
            index = shared.value
            sums = np.zeros((len(index.partitions), 4), np.int64)
            for _, texts in tokens.portions(batches, "text"):
                for text in texts:
                    held = index.shingles(text)
                    for k, p in enumerate(index.partitions):
                        own = held[p.width][0] if p.width in held else np.empty(0, np.uint64)
                        sketch = p.sketch(own)
                        sums[k] += (len(own), int((own <= p.hashes[-1]).sum()), len(sketch), int(np.isin(sketch, p.hashes).sum()))
            names = ["block", "width", "least", "sketch_hashes", "shingles", "under_bound", "looked_up", "found"]
            rows = [(block, p.width, p.least, len(p.hashes), *sums[k].tolist()) for k, p in enumerate(index.partitions)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(len(names))], names=names)

        found = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "block long, width long, least long, sketch_hashes long, shingles long, under_bound long, looked_up long, found long")
        out = found if out is None else out.unionByName(found)
    return out.groupBy("block", "width", "least", "sketch_hashes").agg(*(F.sum(c).alias(c) for c in ("shingles", "under_bound", "looked_up", "found")))


def clean(docs: DataFrame, benchmark: DataFrame, width: int = 5, threshold: float = 0.8, block_chars: int = 4_000_000, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The documents that hold no item, with all their columns; no shuffle."""
    spark = runtime.ship(docs.sparkSession)
    at = docs.columns.index(text_col)
    for items in blocks(benchmark, block_chars, item_col, "text"):
        shared = spark.sparkContext.broadcast(Index(items, width, threshold))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                yield batch.filter(pa.array([not x or not index.find(x) for x in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
