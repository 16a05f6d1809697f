"""Spelling variants: words at a distance of one, found by joining a trie with itself.

The vocabulary is cut into tries. Two words at a distance of one differ at one place of the longer one, of length m: they share
what stands before it and what stands behind. A trie covers a range of such places: its words share a front of p and a back of s code
points, and only the m - p - s places between may differ. Words of each length enter two tries, one by their front half and one by their
back half, once with their own length as m and once with the next. A trie with more than ``LARGEST`` words is cut again, by half of its range,
until none is larger: a range of one place holds no more words than there are letters. So no task holds a common front or ending whole.

Within a trie active-node sets go down from the root: with each node those at a distance of at most one, found from the set of its
parent alone. Words that end at active nodes at a distance of exactly one are near. A pair counts in the trie whose range holds the first place at which
its words differ, so it is found once each way.

Defined results: a null text has no word, a null id reads as empty; ids and texts may repeat, each row counts; words of one length of thousands are words like others (a trie's depth
is that of its range, walked without recursion); of near words of equal count the smallest by code points is the form; an empty table gives no row; further columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary import runtime

#: Latin-1 bytes of no run end one; only A-Z go to lower case.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
#: Different words that a worker counts before it hands them on.
HELD = 200_000
#: Words of a trie. A range of one place holds 90 words of one length at most (26 letters and 64 beyond ASCII) and one of the length below.
LARGEST = 4096
#: A form is so many times as frequent as the word.
TIMES = 5


def variants(docs: DataFrame, shortest: int = 6, least: int = 5, every: int = 199) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of at least ``shortest`` code points and ``least`` occurrences; ``every`` deletes a letter where it divides the hash of id and run."""
    words = runtime.materialize(vocabulary(docs, shortest, least, every), "spelling-words")
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("form"))).alias("best"))
    rows = words.join(near, "word", "left")
    best_n = -F.col("best.n")
    formed = best_n >= TIMES * F.col("n")
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best.form")).alias("form"), F.when(formed, best_n).alias("form_n"))
    rows = runtime.materialize(rows, "spelling-forms")
    roots = _roots(rows.where("form is not null").select("word", F.col("form").alias("root")))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def vocabulary(docs: DataFrame, shortest: int = 6, least: int = 5, every: int = 199) -> DataFrame:
    """(word, n): runs of Latin letters with the letters that the hash deletes gone, of all documents."""
    part = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    counted = part.mapInArrow(_counter(shortest, every), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _counter(shortest: int, every: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out():
            words = pa.array([w.decode("latin-1") for w in held], pa.string())
            yield from pa.table([words, pa.array(held.values(), pa.int64())], ["word", "n"]).to_batches(max_chunksize=50_000)
            held.clear()

        for batch in batches:
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                # One byte a letter; what Latin-1 lacks is no letter here and becomes a question mark.
                found = Counter(text.as_py().encode("latin-1", "replace").translate(_FOLD).split())
                front = zlib.crc32(f"{id_}:".encode())
                for run, n in found.items():
                    if len(run) < shortest:
                        continue  # also without a letter it is too short
                    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), front)
                    if h % every == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < shortest:
                            continue
                    held[run] += n
                if len(held) > HELD:
                    yield from out()
        yield from out()

    return count


# --- tries -------------------------------------------------------------------------------------------


def near_words(words: DataFrame, most: int = LARGEST) -> DataFrame:
    """(word, near, near_n): each pair of words at a distance of one, both ways. ``words(word, n)``, each word once."""
    # m is the length of a pair's longer word, p and s the front and back that a trie's words share.
    length = F.length("word")
    entries = words.select("word", "n", F.explode(F.array(length, length + 1)).alias("m"))
    entries = _cut(entries.select("*", F.lit(0).alias("p"), F.lit(0).alias("s")))
    done, k = None, 0
    while True:
        entries = runtime.materialize(entries, f"spelling-tries-{k}")
        sizes = entries.groupBy("m", "p", "s", "front", "back").agg(F.count("*").alias("size"))
        large = runtime.materialize(sizes.where((F.col("size") > most) & (F.col("m") - F.col("p") - F.col("s") > 1)).drop("size"), "spelling-large")
        if large.isEmpty():
            done = entries if done is None else done.unionByName(entries)
            break
        keys = ["m", "p", "s", "front", "back"]
        small = entries.join(large, keys, "left_anti")
        done = small if done is None else done.unionByName(small)
        entries, k = _cut(entries.join(large, keys, "left_semi")), k + 1
    spark = words.sparkSession
    keyed = done.repartition(max(runtime.partitions(spark), 1), "m", "p", "s", "front", "back").sortWithinPartitions("m", "p", "s", "front", "back", "word")
    return keyed.select("m", "p", "s", "front", "back", "word", "n").mapInArrow(_join, "word string, near string, near_n long")


def _cut(entries: DataFrame) -> DataFrame:
    """Each trie cut in two: the later places of its range by a longer front, the earlier ones by a longer back."""
    between = F.col("m") - F.col("p") - F.col("s")
    half = F.floor(between / 2).cast("int")
    later = F.struct((F.col("p") + half).alias("p"), F.col("s").alias("s"))
    earlier = F.struct(F.col("p").alias("p"), (F.col("s") + between - half).alias("s"))
    rows = entries.select("word", "n", "m", F.explode(F.array(later, earlier)).alias("cut")).select("word", "n", "m", "cut.*").where("m - p - s > 0")
    return rows.select("*", F.substring("word", F.lit(1), F.col("p")).alias("front"), F.substring("word", F.length("word") - F.col("s") + 1, F.col("s")).alias("back"))


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs of the tries of a partition, which come sorted: one trie is held at a time."""
    found: list[tuple[str, str, int]] = []

    def out():
        rows = pa.table([pa.array([r[k] for r in found], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["word", "near", "near_n"])
        found.clear()
        return rows.to_batches(max_chunksize=50_000)

    key, held = None, []
    for batch in batches:
        for *here, word, n in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
            if here != key:
                if len(held) > 1:
                    found += _near(key, held)
                key, held = here, []
            held.append((word, n))
            if len(found) > 50_000:
                yield from out()
    if len(held) > 1:
        found += _near(key, held)
    yield from out()


def _near(key: list, held: list[tuple[str, int]]) -> Iterator[tuple[str, str, int]]:
    """The near pairs of one trie, each from both of its words."""
    m, p, s = key[:3]
    # The trie of what stands between front and back: children, and the word that ends, by node.
    children: list[dict[str, int]] = [{}]
    ends: list[tuple[str, int] | None] = [None]
    for word, n in held:
        at = 0
        for c in word[p : len(word) - s]:
            if c not in children[at]:
                children[at][c] = len(children)
                children.append({})
                ends.append(None)
            at = children[at][c]
        ends[at] = word, n
    # A node's active set: nodes whose strings are at a distance of at most one of its own, with the distance.
    active = {0: 0} | dict.fromkeys(children[0].values(), 1)
    stack = [(0, active)]
    while stack:
        node, active = stack.pop()
        if end := ends[node]:
            word = end[0]
            for other, d in active.items():
                if d == 1 and (to := ends[other]) and max(len(word), len(to[0])) == m and _first_unlike(word, to[0], p) < m - s:
                    yield word, *to
        for c, child in children[node].items():
            nearer: dict[int, int] = {}
            for other, d in active.items():
                below = children[other]
                same = below.get(c)
                if same is not None and nearer.get(same, 2) > d:
                    nearer[same] = d
                if d == 0:
                    nearer.setdefault(other, 1)  # c is one more than the other has
                    for e, x in below.items():
                        if e != c:
                            nearer.setdefault(x, 1)  # another letter stands for c
                    if same is not None:
                        for x in children[same].values():
                            nearer.setdefault(x, 1)  # the other has one more behind c
            stack.append((child, nearer))


def _first_unlike(a: str, b: str, k: int) -> int:
    """The first place, from k, at which two unlike words differ."""
    end = min(len(a), len(b))
    while k < end and a[k] == b[k]:
        k += 1
    return k


def _roots(links: DataFrame) -> DataFrame:
    """(word, root): where the forms of words lead. A form is five times as frequent as its word, so paths are short and without circles; each round doubles the step."""
    links = runtime.materialize(links, "spelling-roots")
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = links.join(on, "root", "left")
        step = runtime.materialize(moved.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if step.where("moved").isEmpty():
            return links
        links = step.drop("moved")
