"""SimHash near-duplicates: 64-bit fingerprints linked within a Hamming distance, by vantage-point trees.

A vantage-point tree is built over a bounded sample of the fingerprints: each node has a vantage point, and
the median distance parts what lies near from what lies far. Its leaves are the shards. A fingerprint lives
in the leaf that its distances lead to, and is sent as a query to every later leaf that a ball of the
radius around it overlaps: the triangle bound rules out all others. In a shard, a tree over its residents
answers them and the visitors: a node is passed by if the ball lies outside of it, and joined as a whole
if it lies inside the ball; leaves are compared bit by bit. So no pair within the radius is lost, whatever
the sample. A shard with more than ``RESIDENTS`` fingerprints is cut into tiles, its queries into parts,
and each (shard, tile, part) is a unit of work of its own; queries stream past the tree. Of the links in a
unit only as many are kept as join the same components.

Hamming distances of unlike fingerprints are 32 +- 4, so at a radius of 4 about 84 % of the queries at a node's
level go on to each side: a query meets about N^0.75 of N fingerprints.

``similar_documents`` finds texts with a Jaccard similarity of 0.8 or more over sets of five-word
shingles. Candidates come from the same trees, over the SimHash of a text's shingles: none within the distance of 4 is lost. That holds
near copies; texts that are just similar by 0.8 differ in about 15 % of the bits, a distance at which triangle bounds rule out
nothing. So more candidates are added by 1,024 bits, of which the trees' are the first 64: those that agree in one of eighty blocks of 12 bits,
and differ in 72 of 256 bits at most. By calculation a pair at 0.8 shares no block with a probability of
1e-5 and is beyond the bound, 5.5 standard deviations above its mean, with less; unlike texts meet the bound with 1e-12. Texts of at most ``SHORT``
shingles have too few for that (of four and five shingles 19 % of the bits differ), so they, and those a quarter longer, are found by their least hashes instead: as
many as a similar text may lack and one more, of which two similar texts share one for certain. Candidates only group
documents: within a group, texts are linked whose sets of shingles have a similarity of 0.8 or more, and
components are those of such links. Each text of a group first meets the group's first text; only those unlike it meet the
others. A block, or what is left of a group, with more than ``TILE`` members is cut into tiles, and
each pair of tiles is a unit of its own; pairs that links join already are not compared again.

Defined results: a null or empty text, or one of white space, has fingerprint 0 and links like any other; rows of
equal document id are documents of their own; a null document id ranks after all others, and is the component of rows
that reach no other; an empty table gives no row; extra columns are ignored, and passed through by ``distinct_documents``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary import runtime
from granary.llm import tokens
from granary.llm.components import components, spanning

SEED = 42
DISTANCE = 4
#: Fingerprints of a shard, on average; shards at least (if there are as many fingerprints for each) and at most.
RESIDENTS, SHARDS, MOST_SHARDS = 65_536, 64, 4096
#: Fingerprints of the sample for each shard; queries of a unit; queries that are answered at once; values of a tree's leaf.
SAMPLE, QUERIES, AT_ONCE, LEAF = 32, 4_000_000, 65_536, 32

#: The signatures of similar documents: their 64-bit words, blocks of a word, bits of a block, words compared, bits by which those may differ.
WORDS, BLOCKS, WIDTH, COMPARED, APART = 16, 5, 12, 4, 72
JACCARD = 0.8
#: Shingles of a short text, and of the longest that is similar to one.
SHORT, SHORT_PARTNER = 16, 20
KEPT_WORDS = 100_000
TILE = 4096
#: Pairs that are compared at once.
PAIRS = 500_000
#: Characters of a tile of texts, and how many of its texts are compared with one at once.
TILE_CHARS, SOME = 16_000_000, 16
_ODDS = np.random.default_rng(11).integers(1, 1 << 62, 24, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = np.uint64(0x9E3779B97F4A7C15)


# --- fingerprints ----------------------------------------------------------------------------------


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 of each run of ``width`` words joined by spaces; of fewer words, of all of them."""
    from xxhash import xxh64_intdigest as h

    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([h(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - width + 1
    return np.fromiter((h(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[width - 1 :].tolist())), np.uint64, n)


def majority(rows: np.ndarray) -> bytes:
    """Of n rows of 64-bit words, the bits that are set in over half."""
    n = len(rows)
    raw = rows.astype("<u8").view(np.uint8).reshape(n, -1)
    ones = np.zeros(8 * raw.shape[1], np.int64)
    for k in range(0, n, 255):  # so many rows add up in a byte
        ones += np.unpackbits(raw[k : k + 255], axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > n, bitorder="little").tobytes()


def fingerprint(text: str, width: int = 4) -> int:
    """Unsigned 64-bit fingerprint of the shingles of ``width`` words of an ASCII-lower-cased text."""
    words = text.encode("utf-8", "replace").lower().split()
    return int.from_bytes(majority(shingle_hashes(words, width)), "little") if words else 0


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""
    runtime.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, held in tokens.portions(batches, "text"):
            fps = np.array([fingerprint(x, width) for x in held], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


# --- vantage-point trees ---------------------------------------------------------------------------


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


class Tree:
    """A vantage-point tree over distinct 64-bit values. A node's vantage point is one of its values, no value of it lies farther away
    than ``far``, those at most ``limit`` away are on its left. Leaves are numbered from left to right."""

    def __init__(self, values: np.ndarray, leaf: int, radius: int = 0):
        self.vantage: list[np.uint64] = []
        self.far: list[int] = []
        self.limit: list[int] = []
        self.sides: list[list[int]] = []
        self.number: dict[int, int] = {}
        self.members: list[np.ndarray] = []  # of the leaves
        self.whole: list[np.ndarray] = []  # of nodes within the radius of their vantage points, but not in such a node: the values
        todo: list[tuple[np.ndarray, int, int, bool]] = [(values, -1, 0, False)]
        while todo:
            held, parent, side, inner = todo.pop()
            node = len(self.vantage)
            if parent >= 0:
                self.sides[parent][side] = node
            point = self._point(held)
            d = apart(held, point)
            far = int(d.max()) if len(d) else 0
            self.vantage.append(point)
            self.far.append(far)
            self.sides.append([-1, -1])
            tight = 0 < far <= radius
            if tight and not inner:
                self.whole.append(held)
            if len(held) <= leaf or far == 0:
                self.limit.append(far)
                self.number[node] = len(self.members)
                self.members.append(held)
                continue
            limit = min(int(np.median(d)), far - 1)
            self.limit.append(limit)
            todo.append((held[d > limit], node, 1, inner or tight))
            todo.append((held[d <= limit], node, 0, inner or tight))

    @staticmethod
    def _point(values: np.ndarray) -> np.uint64:
        """Of a few of the values, that from which the distances vary most."""
        if len(values) <= LEAF:
            return values[0] if len(values) else np.uint64(0)
        some, seen = values[:: -(-len(values) // 8)], values[:: -(-len(values) // 256)]
        return some[int(apart(some[:, None], seen).std(axis=1).argmax())]

    def route(self, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which value, leaf, whether it is home there): the home of each, and the later leaves that its ball overlaps. Values may be new to the tree."""
        which, leaf, own = [], [], []
        todo = [(0, np.arange(len(values)), np.ones(len(values), bool))]
        while todo:
            node, rows, home = todo.pop()
            if node in self.number:
                which.append(rows)
                leaf.append(np.full(len(rows), self.number[node]))
                own.append(home)
                continue
            if not len(rows):
                continue
            d, limit = apart(values[rows], self.vantage[node]), self.limit[node]
            near = d <= limit
            right = np.where(home, ~near | (d + radius > limit), d + radius > limit)
            left = np.where(home, near, d - radius <= limit)
            todo.append((self.sides[node][1], rows[right], (home & ~near)[right]))
            todo.append((self.sides[node][0], rows[left], home[left]))
        return np.concatenate(which), np.concatenate(leaf), np.concatenate(own)

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Links (value, query) within the radius that the tree was built for. Of a node that lies in a query's ball as a whole only the vantage point is linked; ``whole`` links the rest to it."""
        todo = [(0, np.arange(len(queries)))]
        while todo:
            node, rows = todo.pop()
            d, far = apart(queries[rows], self.vantage[node]), self.far[node]
            if far <= radius:
                inside = d + far <= radius
                yield np.full(int(inside.sum()), self.vantage[node]), queries[rows[inside]]
                rows, d = rows[~inside], d[~inside]
            close = d - far <= radius
            rows, d = rows[close], d[close]
            if not len(rows):
                continue
            if node in self.number:
                held = self.members[self.number[node]]
                for k in range(0, len(rows), 1 << 15):
                    some = queries[rows[k : k + (1 << 15)]]
                    i, j = np.nonzero(np.bitwise_count(some[:, None] ^ held) <= radius)
                    yield held[j], some[i]
                continue
            todo.append((self.sides[node][1], rows[d + radius > self.limit[node]]))
            todo.append((self.sides[node][0], rows[d - radius <= self.limit[node]]))


def _by_unit(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """(unit, side, columns after those two) of rows that come by unit and side, in portions as they arrive."""
    for batch in batches:
        unit, side, *rest = (np.asarray(c.to_numpy(zero_copy_only=False)) for c in batch.columns)
        cuts = np.flatnonzero((unit[1:] != unit[:-1]) | (side[1:] != side[:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(unit)]):
            if b > a:
                yield int(unit[a]), int(side[a]), [c[a:b] for c in rest]


class _Unit:
    """Residents, then queries, of one unit; keeps a spanning set of the links found."""

    def __init__(self, radius: int):
        self.radius = radius
        self.residents: list[np.ndarray] = []
        self.waiting: list[np.ndarray] = []
        self.n = 0
        self.tree: Tree | None = None
        self.links: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, side: int, fps: np.ndarray) -> None:
        if side == 0:
            self.residents.append(fps)
            return
        self.waiting.append(fps)
        self.n += len(fps)
        if self.n >= AT_ONCE:
            self.answer()

    def _keep(self, a: np.ndarray, b: np.ndarray) -> None:
        other = a != b
        self.links.append((a[other].view(np.int64), b[other].view(np.int64)))
        self.size += len(self.links[-1][0])
        if self.size > 1_000_000:
            self.links = [self.spanned()]
            self.size = len(self.links[0][0])

    def spanned(self) -> tuple[np.ndarray, np.ndarray]:
        none = np.empty(0, np.int64)
        return spanning(*(np.concatenate([none, *(x[k] for x in self.links)]) for k in (0, 1)))

    def answer(self) -> None:
        if self.n and self.residents:
            if self.tree is None:
                self.tree = Tree(np.concatenate(self.residents), LEAF, self.radius)
                for held in self.tree.whole:
                    self._keep(np.full(len(held), Tree._point(held)), held)
            for a, b in self.tree.search(np.concatenate(self.waiting), self.radius):
                self._keep(a, b)
        self.waiting, self.n = [], 0


def links(points: DataFrame, radius: int = DISTANCE) -> DataFrame:
    """(a, b) between distinct fingerprints of ``points(fp long)``: they join the same components as all pairs within the radius."""
    spark = runtime.ship(points.sparkSession)
    n = points.count()
    shards = max(1, min(MOST_SHARDS, max(n // RESIDENTS, min(SHARDS, n // SAMPLE))))
    # At most SAMPLE * MOST_SHARDS values of 8 bytes, chosen by hash; every later step is exact whatever they are.
    some = [r[0] for r in points.select("fp").orderBy(F.xxhash64("fp")).limit(SAMPLE * shards).collect()]
    top = Tree(np.array(some, np.int64).view(np.uint64), SAMPLE)
    shared = spark.sparkContext.broadcast(top)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home = visits = 0
        for batch in batches:
            _, leaf, own = shared.value.route(batch.column(0).to_numpy().view(np.uint64), radius)
            home = home + np.bincount(leaf[own], minlength=len(shared.value.members))
            visits = visits + np.bincount(leaf[~own], minlength=len(shared.value.members))
        if np.ndim(home):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(home)), pa.int32()), pa.array(home), pa.array(visits)], names=["shard", "home", "visits"])

    # One row for each shard: at most SAMPLE * MOST_SHARDS, whatever the input.
    tiles, parts = np.ones(len(top.members), np.int64), np.ones(len(top.members), np.int64)
    for r in points.select("fp").mapInArrow(count, "shard int, home long, visits long").groupBy("shard").agg(F.sum("home").alias("home"), F.sum("visits").alias("visits")).collect():
        tiles[r["shard"]] = max(1, -(-r["home"] // (4 * RESIDENTS)))
        parts[r["shard"]] = max(1, -(-(r["home"] + r["visits"]) // QUERIES))
    cut = spark.sparkContext.broadcast((tiles, parts))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles, parts = cut.value
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            which, leaf, own = shared.value.route(fps, radius)
            lot = ((fps * _FOLD) >> np.uint64(33)).astype(np.int64)[which]
            # Residents go to their tile of every part, every value is a query to its part of every tile.
            at = np.flatnonzero(own)
            first, part = np.repeat(at, parts[leaf[at]]), tokens._ranges(np.zeros(len(at), np.int64), parts[leaf[at]])
            second, tile = np.repeat(np.arange(len(which)), tiles[leaf]), tokens._ranges(np.zeros(len(which), np.int64), tiles[leaf])
            row = np.concatenate([first, second])
            t = np.concatenate([lot[first] % tiles[leaf[first]], tile])
            p = np.concatenate([part, (lot[second] // 65_537) % parts[leaf[second]]])
            unit = (leaf[row].astype(np.int64) << 32) | (t << 16) | p
            side = np.concatenate([np.zeros(len(first), np.int8), np.ones(len(second), np.int8)])
            value = fps[which[row]].view(np.int64)
            for k in range(0, len(row), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 100_000]) for x in (unit, side, value)], names=["unit", "side", "fp"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, now = -1, _Unit(radius)

        def done() -> pa.RecordBatch:
            now.answer()
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in now.spanned()], names=["a", "b"])

        for unit, side, (fps,) in _by_unit(batches):
            if unit != at:
                yield done()
                at, now = unit, _Unit(radius)
            now.add(side, fps.view(np.uint64))
        yield done()

    units = points.select("fp").mapInArrow(deal, "unit long, side byte, fp long")
    return units.repartition(runtime.partitions(spark), "unit").sortWithinPartitions("unit", "side").mapInArrow(search, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): the smallest document id that links of at most 4 bits reach."""
    fps = runtime.materialize(fingerprints(docs, width, id_col, text_col), "fingerprints")
    points = runtime.materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "points")
    groups = runtime.materialize(components(runtime.materialize(links(points), "links")), "groups")
    linked = runtime.materialize(groups.join(points, groups["node"] == points["fp"]).select("node", "component", "least"), "linked")
    tops = linked.groupBy("component").agg(F.min("least").alias("top"))
    named = linked.join(tops, "component").select("node", "top")
    every = points.join(named, points["fp"] == named["node"], "left").select("fp", F.coalesce("top", "least").alias("component_id"))
    return fps.join(every, "fp").select("doc_id", "fp", "component_id")


def digests(found: DataFrame) -> DataFrame:
    """The fingerprint as 16 lowercase hex digits."""
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- similar documents -----------------------------------------------------------------------------


class _Words(dict):
    """Hashes of words; a worker keeps at most so many of them."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = found = xxh64_intdigest(word, SEED)
        return found


_known = _Words()


def shingle_set(text: str, width: int = 5) -> np.ndarray:
    """Sorted hashes of the set of a lower-cased text's shingles; of fewer words than ``width``, of all of them; none without a word."""
    held = text.lower().encode("utf-8", "replace").split()
    if not held:
        return np.empty(0, np.uint64)
    words = np.fromiter(map(_known.__getitem__, held), np.uint64, len(held))
    w = min(width, len(words))
    n = len(words) - w + 1
    out = np.full(n, w, np.uint64)
    for k in range(w):
        out = (out ^ words[k : k + n]) * _FOLD
        out ^= out >> np.uint64(29)
    return np.unique(out)


def set_digest(h: np.ndarray) -> bytes:
    """128 bits that tell sets of shingles apart."""
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(h.astype("<u8").tobytes())


def set_signature(h: np.ndarray, words: int) -> bytes:
    """SimHash of a set, of ``words`` times 64 bits; of an even number of shingles, the least breaks ties, or short texts would have too few bits set."""
    if not len(h):
        return bytes(8 * words)
    if len(h) % 2 == 0:
        h = np.append(h, h[0])
    x = h[:, None] * _ODDS[:words]
    x ^= x >> np.uint64(32)
    x *= _ODDS[8 : 8 + words]
    return majority(x ^ (x >> np.uint64(29)))


@dataclass
class _Shares:
    """How the blocks with many members are cut into tiles."""

    tiles: np.ndarray  # by block and value

    def deal(self, sig: np.ndarray, rep: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(which row, unit, side) for each block in turn. Of t tiles, tile i meets tiles i to t - 1: unit (i, j) holds those of i and, on side 1, of j."""
        lot = ((rep.view(np.uint64) * _FOLD) >> np.uint64(33)).astype(np.int64)
        for first, value in _values(sig):
            block = first + value
            t = self.tiles[block]
            mine = lot % t
            row, other = np.repeat(np.arange(len(sig)), t), tokens._ranges(np.zeros(len(sig), np.int64), t)
            i, j = np.minimum(mine[row], other), np.maximum(mine[row], other)
            yield row, (block[row] << 32) | (i << 16) | j, (mine[row] > other).astype(np.int8)


def _values(sig: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the first value, value of each signature) for each block."""
    for w in range(WORDS):
        for b in range(BLOCKS):
            value = (sig[:, w] >> np.uint64(b * WIDTH)) & np.uint64((1 << WIDTH) - 1)
            yield (w * BLOCKS + b) << WIDTH, value.astype(np.int64)


def _compare(unit: np.ndarray, side: np.ndarray, rep: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within whole units, which come one after the other and by side: side 0 meets itself or, where there is one, side 1."""
    first = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
    ends = np.append(first[1:], len(unit))
    half = np.add.reduceat(side == 0, first)
    size = ends - first
    two = np.repeat(half < size, size)
    at = np.arange(len(unit))
    mine = np.flatnonzero(side == 0)
    begin = np.where(two, np.repeat(first + half, size), at + 1)[mine]
    partners = np.repeat(ends, size)[mine] - begin
    found_a, found_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    k, total = 0, np.concatenate([[0], np.cumsum(partners)])
    while k < len(mine):
        stop = max(k + 1, int(np.searchsorted(total, total[k] + PAIRS, side="right")) - 1)
        n = partners[k:stop]
        i, j = np.repeat(mine[k:stop], n), tokens._ranges(begin[k:stop], n)
        d = np.bitwise_count(sig[i, 0] ^ sig[j, 0])
        near = d <= APART
        i, j, d = i[near], j[near], d[near].astype(np.int64)
        for w in range(1, sig.shape[1]):
            d += np.bitwise_count(sig[i, w] ^ sig[j, w])
        near = d <= APART
        found_a.append(rep[i[near]])
        found_b.append(rep[j[near]])
        if sum(map(len, found_a)) > 1_000_000:
            a, b = spanning(np.concatenate(found_a), np.concatenate(found_b))
            found_a, found_b = [a], [b]
        k = stop
    return spanning(np.concatenate(found_a), np.concatenate(found_b))


def tree_links(points: DataFrame) -> DataFrame:
    """(a, b) between the ``rep`` of ``points(rep long, fp long)``: by the trees, they group all fingerprints that differ in DISTANCE bits at most."""
    known = runtime.materialize(points.groupBy("fp").agg(F.min("rep").alias("first"), F.count("*").alias("n")), "tree-points")
    found = runtime.materialize(links(known), "tree-links")
    one, two = known.select(F.col("fp").alias("a"), F.col("first").alias("one")), known.select(F.col("fp").alias("b"), F.col("first").alias("two"))
    near = found.join(one, "a").join(two, "b").select(F.col("one").alias("a"), F.col("two").alias("b"))
    same = points.join(known.where("n > 1"), "fp").where("rep <> first").select(F.col("rep").alias("a"), F.col("first").alias("b"))
    return near.unionByName(same)


def least_hashes(h: np.ndarray) -> list[int]:
    """The least of a short set's sorted hashes, one more than a similar set may lack; none of a longer or an empty set."""
    n = len(h) if len(h) <= SHORT_PARTNER else 0
    return h[: n - int(np.ceil(JACCARD * n - 1e-9)) + 1].view(np.int64).tolist() if n else []


def short_links(points: DataFrame) -> DataFrame:
    """(a, b): short texts that share one of their least hashes, each with the first of those; ``points(rep, least array<long>)``."""
    keys = points.select("rep", F.explode("least").alias("hash"))
    # Stored, so that both sides of the join are plain exchanges and a hash of very many texts can be split.
    first = runtime.materialize(keys.groupBy("hash").agg(F.min("rep").alias("first"), F.count("*").alias("n")).where("n > 1").select("hash", "first"), "least-hashes")
    return keys.join(first, "hash").where("rep <> first").select(F.col("rep").alias("a"), F.col("first").alias("b")).distinct()


def candidates(points: DataFrame) -> DataFrame:
    """(a, b) between the ``rep`` of ``points(rep long, sig binary)``: they group what shares a block and differs little."""
    spark = runtime.ship(points.sparkSession)
    blocks = WORDS * BLOCKS << WIDTH

    def matrix(column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(len(column), -1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(blocks, np.int64)
        for batch in batches:
            for first, value in _values(matrix(batch.column(0))):
                total[first : first + (1 << WIDTH)] += np.bincount(value, minlength=1 << WIDTH)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there])], names=["block", "n"])

    # At most one row for each block and value, 327,680 whatever the input.
    tiles = np.ones(blocks, np.int64)
    for r in points.select("sig").mapInArrow(count, "block int, n long").groupBy("block").agg(F.sum("n").alias("n")).where(F.col("n") > TILE).collect():
        tiles[r["block"]] = -(-r["n"] // TILE)
    shared = spark.sparkContext.broadcast(_Shares(tiles))

    parts = [f"s{w}" for w in range(COMPARED)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, sig = batch.column(0).to_numpy(), matrix(batch.column(1))
            for row, unit, side in shared.value.deal(sig, rep):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (unit, side, rep[row], *(sig[row, w].view(np.int64) for w in range(COMPARED)))], names=["unit", "side", "rep", *parts])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        n = 0

        def answer(stop: int | None) -> pa.RecordBatch:
            """The rows of whole units; those of the last, which may go on, are held back."""
            columns = [np.concatenate(c) for c in zip(*held)]
            cut = len(columns[0]) if stop is None else int(np.searchsorted(columns[0], columns[0][-1]))
            unit, side, rep, *sig = (c[:cut] for c in columns)
            held[:] = [[c[cut:] for c in columns]] if cut < len(columns[0]) else []
            a, b = _compare(unit, side, rep, np.stack(sig, axis=1).view(np.uint64)) if cut else (unit[:0], unit[:0])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            held.append([np.asarray(c.to_numpy(zero_copy_only=False)) for c in batch.columns])
            n += batch.num_rows
            if n >= 200_000:
                yield answer(0)
                n = sum(len(c[0]) for c in held)
        if any(len(c[0]) for c in held):
            yield answer(None)

    units = points.select("rep", "sig").mapInArrow(deal, ", ".join(["unit long, side byte, rep long", *(f"{p} long" for p in parts)]))
    return units.repartition(runtime.partitions(spark), "unit").sortWithinPartitions("unit", "side").mapInArrow(search, "a long, b long")


def _similar_sets(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have a similarity of JACCARD or more, in integers up to the one product; two empty ones are equal."""
    if min(len(a), len(b)) < JACCARD * max(len(a), len(b)):
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared >= JACCARD * (len(a) + len(b) - shared) - 1e-9


def _verify(texts: list[str], reps: np.ndarray, side: np.ndarray, width: int, joined: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links of a unit by exact similarity, as many as join the same components: side 0 meets itself or, where there is one, side 1, which is ``joined`` if links beyond the unit join it.

    Rows come by side.
    """
    sets = [shingle_set(x, width) for x in texts]
    sizes = np.array([len(x) for x in sets], np.int64)
    # Of any set's first hashes, one more than it may lack, a similar set has one among its own: candidates without loss.
    fronts = [x[: len(x) - int(np.ceil(JACCARD * len(x) - 1e-9)) + 1] for x in sets]
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in fronts])
    known = np.concatenate(fronts)
    order = np.argsort(known, kind="stable")
    known, owner = known[order], owner[order]
    flat, begin = np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)])
    group, out = np.arange(len(sets)), []
    half = int((side == 0).sum())
    if joined:
        group[half:] = half
    for i in range(half if half < len(sets) else 1, len(sets)):
        top = half if half < len(sets) else i
        at = np.searchsorted(known, fronts[i], side="left")
        near = np.unique(owner[tokens._ranges(at, np.searchsorted(known, fronts[i], side="right") - at)]) if sizes[i] else np.flatnonzero(sizes == 0)
        near = near[near < top]
        todo = near[np.minimum(sizes[near], sizes[i]) >= JACCARD * np.maximum(sizes[near], sizes[i])]
        while len(todo := todo[group[todo] != group[i]]):
            some, todo = todo[:SOME], todo[SOME:]
            shared = np.zeros(len(some), np.int64)
            if sizes[i]:
                held = flat[tokens._ranges(begin[some], sizes[some])]
                hit = sets[i][np.minimum(np.searchsorted(sets[i], held), sizes[i] - 1)] == held
                ends = np.cumsum(sizes[some])
                total = np.concatenate([[0], np.cumsum(hit)])
                shared = total[ends] - total[ends - sizes[some]]
            for j in some[shared >= JACCARD * (sizes[some] + sizes[i] - shared) - 1e-9].tolist():
                if group[j] != group[i]:
                    out.append((reps[i], reps[j]))
                    group[group == group[j]] = group[i]
    found = np.array(out, np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def verified(rows: DataFrame, groups: DataFrame, width: int) -> DataFrame:
    """(a, b): links by exact similarity within candidate groups; ``rows(row, text)``, ``groups(node, component)``.

    Every text meets the first of its group, which is one comparison each, however large the group is. Only those unlike it meet the others.
    """
    spark = runtime.ship(rows.sparkSession)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, top = None, np.empty(0, np.uint64)
        for batch in batches:
            like = []
            for lead, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if lead != last or last is None:
                    last, top = lead, shingle_set(lead or "", width)
                like.append(_similar_sets(top, shingle_set(text or "", width)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(like, pa.bool_())], names=["component", "rep", "like"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done() -> pa.RecordBatch:
            a, b = _verify([r[6] or "" for r in held], np.array([r[5] for r in held], np.int64), np.array([r[3] for r in held], np.int8), width, held[0][4])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for row in (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))):
            if held and row[:3] != held[0][:3]:
                yield done()
                held = []
            held.append(row)
        if held:
            yield done()

    texts = runtime.materialize(rows.join(groups, rows["row"] == groups["node"]).select("component", F.col("row").alias("rep"), "text"), "candidates")
    leads = texts.where("rep = component").select("component", F.col("text").alias("lead"))
    met = texts.where("rep <> component").join(leads, "component").select("component", "rep", "lead", "text")
    met = runtime.materialize(met.mapInArrow(first, "component long, rep long, like boolean"), "met")
    # Groups of two are settled; so are those where all are like the first.
    still = met.groupBy("component").agg(F.count("*").alias("n"), F.count_if(~F.col("like")).alias("unlike")).where("n > 1 and unlike > 0").select("component")
    rest = texts.join(met.drop("component"), "rep").join(still, "component", "left_semi").select("component", "rep", "like", "text", F.coalesce(F.length("text"), F.lit(0)).alias("chars"))
    rest = runtime.materialize(rest, "unlike")
    share = lambda on: F.ceil(F.greatest(F.count_if(on) / TILE, F.sum(F.when(on, F.col("chars")).otherwise(0)) / TILE_CHARS)).cast("int")
    tiles = rest.groupBy("component").agg(share(~F.col("like")).alias("t"), share(F.col("like")).alias("u"))
    cut = rest.join(tiles, "component").withColumn("lot", F.expr("cast(pmod(xxhash64(rep), if(like, u, t)) as int)"))
    # The unlike in t tiles meet each other, i with j, and the u tiles of the others, i with t + j.
    at = lambda i, j, side, across: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"), F.lit(across).alias("across"))
    lot, t, u = F.col("lot"), F.col("t"), F.col("u")
    own = F.transform(F.sequence(F.lit(0), t - 1), lambda o: at(F.least(lot, o), F.greatest(lot, o), F.when(lot > o, 1).otherwise(0), False))
    others = F.transform(F.sequence(F.lit(1), F.greatest(u, F.lit(1))), lambda o: at(lot, t + o - 1, F.lit(0), True))
    mine = F.transform(F.sequence(F.lit(0), t - 1), lambda o: at(o, t + lot, F.lit(1), True))
    units = F.when(F.col("like"), mine).when(u > 0, F.concat(own, others)).otherwise(own)
    unit = cut.withColumn("x", F.explode(units)).select("component", "x.i", "x.j", "x.side", "x.across", "rep", "text")
    found = unit.repartition(runtime.partitions(spark), "component", "i", "j").sortWithinPartitions("component", "i", "j", "side", "rep").mapInArrow(check, "a long, b long")
    return found.unionByName(met.where("like").select(F.col("rep").alias("a"), F.col("component").alias("b")))


def _similar(rows: DataFrame, width: int) -> DataFrame:
    """(row, doc_id, best): of ``rows(row, doc_id, text)``, whose ``row`` is distinct, each with the first row of its group by document id, then row."""
    runtime.ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, held in tokens.portions(batches, "text"):
            sets = [shingle_set(x, width) for x in held]
            sigs = [set_signature(x, WORDS) if len(x) > SHORT else None for x in sets]
            fps = np.frombuffer(b"".join((s or set_signature(x, 1))[:8] for s, x in zip(sigs, sets)), "<i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(set_digest, sets), pa.binary()), pa.array(fps, pa.int64()), pa.array(sigs, pa.binary()), pa.array(map(least_hashes, sets), pa.list_(pa.int64()))], names=["row", "doc_id", "key", "fp", "sig", "least"])

    marked = runtime.materialize(rows.select("row", "doc_id", "text").mapInArrow(run, "row long, doc_id long, key binary, fp long, sig binary, least array<long>"), "signatures")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    # Equal sets are one point, named by its first row.
    points = runtime.materialize(marked.groupBy("key").agg(F.min(order).alias("best"), F.first("fp").alias("fp"), F.first("sig").alias("sig"), F.first("least").alias("least")).select("key", "best", F.col("best.row").alias("rep"), "fp", "sig", "least"), "points")
    # What the trees find, and what lies beyond their distance.
    found = tree_links(points).unionByName(candidates(points.where("sig is not null"))).unionByName(short_links(points))
    groups = runtime.materialize(components(runtime.materialize(found, "links")), "groups")
    found = components(runtime.materialize(verified(rows, groups, width), "verified"))
    linked = runtime.materialize(found.join(points.select("rep", "best"), found["node"] == F.col("rep")).select("node", "component", "best"), "linked")
    named = linked.join(linked.groupBy("component").agg(F.min("best").alias("top")), "component").select("node", "top")
    every = points.join(named, points["rep"] == named["node"], "left").select("key", F.coalesce("top", "best").alias("best"))
    return marked.select("row", "doc_id", "key").join(every, "key").select("row", "doc_id", "best")


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows stored with a number for each, so that every later read sees the same numbers."""
    row = runtime.fresh("granary_row", docs)
    return runtime.materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def similar_documents(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id): groups of texts that are equal but for case and white space, or similar by 0.8 or more."""
    rows, row = _numbered(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    return _similar(rows.withColumnRenamed(row, "row"), width).select("doc_id", F.col("best.doc_id").alias("component_id"))


def distinct_documents(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The first row of each group of similar texts, by document id and then as the rows come, with all its columns."""
    rows, row = _numbered(docs)
    found = _similar(rows.select(F.col(row).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), width)
    loser = runtime.fresh("granary_loser", rows)
    losers = found.where("row <> best.row").select(F.col("row").alias(loser))
    return rows.join(losers, rows[row] == losers[loser], "left_anti").drop(row)
