"""Ordered folds over arrays, as native higher-order functions: state resets that no window expresses.

Each takes the ordered array of one document and gives the places, from 0, at which its groups begin. The
accumulator grows by one integer for each group, not for each element; the texts stay out of it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold(items: Column, start: list[tuple[str, Column]], step) -> Column:
    """Group starts from a fold whose state is ``start`` and whose step gives (opens a group, new state); ``n`` counts the elements before."""
    state = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("n"), *(v.alias(k) for k, v in start))

    def merge(acc: Column, x: Column) -> Column:
        opens, values = step(acc, x)
        out = F.when((acc["n"] == 0) | opens, F.concat(acc["out"], F.array(acc["n"]))).otherwise(acc["out"])
        return F.struct(out.alias("out"), (acc["n"] + 1).alias("n"), *(v.cast(c).alias(k) for (k, c), v in zip(((k, "int") for k, _ in start), values)))

    return F.aggregate(items, state, merge, lambda acc: acc["out"])


def greedy_groups(items: Column, threshold: int, max_images: int = 0) -> Column:
    """Greedy merge of ``array<struct<chars int, images int>>``: characters at most ``threshold`` and images at most ``max_images`` (0: any).

    The first element of a group is taken whatever its size; one above the threshold stands alone.
    """

    def step(acc: Column, x: Column):
        alone = x["chars"] > threshold
        images = (F.lit(max_images) > 0) & (acc["images"] + x["images"] > max_images)
        opens = (acc["alone"] == 1) | alone | images | (acc["chars"] + x["chars"] > threshold)
        fresh = (acc["n"] == 0) | opens
        # The very first element fills the buffer like any other, so a later small one may not join it if it is oversize.
        return opens, [F.when(fresh, x["chars"]).otherwise(acc["chars"] + x["chars"]), F.when(fresh, x["images"]).otherwise(acc["images"] + x["images"]), F.when((acc["n"] > 0) & alone, 1).otherwise(0)]

    return _fold(items, [("chars", F.lit(0)), ("images", F.lit(0)), ("alone", F.lit(0))], step)


def sized_groups(items: Column, size: int, max_images: int = 0, breaks: bool = False) -> Column:
    """Greedy grouping of atoms to ``size`` characters; with ``breaks``, an element whose ``brk`` is true opens a group."""

    def step(acc: Column, x: Column):
        images = (F.lit(max_images) > 0) & (acc["images"] + x["images"] > max_images)
        opens = (acc["chars"] + x["chars"] > size) | images
        opens = opens | x["brk"] if breaks else opens
        fresh = (acc["n"] == 0) | opens
        return opens, [F.when(fresh, x["chars"]).otherwise(acc["chars"] + x["chars"]), F.when(fresh, x["images"]).otherwise(acc["images"] + x["images"])]

    return _fold(items, [("chars", F.lit(0)), ("images", F.lit(0))], step)


def packed_groups(lengths: Column, target: int, overlap: int) -> Column:
    """Sentence packing of ``array<int>``: a new chunk begins when the next sentence does not fit; the tail of the last, at most ``overlap`` characters, counts towards it."""

    def step(acc: Column, n: Column):
        opens = acc["chars"] + n > target
        fresh = (acc["n"] == 0) | opens
        carried = F.when(acc["n"] == 0, 0).otherwise(F.least(F.lit(overlap), acc["own"]))
        return opens, [F.when(fresh, carried + n).otherwise(acc["chars"] + n), F.when(fresh, n).otherwise(acc["own"] + n)]

    return _fold(lengths, [("chars", F.lit(0)), ("own", F.lit(0))], step)


def merged_title(titles: Column) -> Column:
    """Title of merged groups: none, the one, two or three joined by `` ~ ``, or the first and last."""
    held = F.filter(titles, lambda t: t.isNotNull() & (t != ""))
    return F.when(F.size(held) <= 3, F.array_join(held, " ~ ")).otherwise(F.concat(F.element_at(held, 1), F.lit(" ~ ... ~ "), F.element_at(held, -1)))


def slices(items: Column, starts: Column) -> Column:
    """The items of each group as an array of arrays, from the groups' starts: no row leaves its partition for it."""
    cut = lambda b: F.transform(F.slice(b, F.lit(1), F.size(b) - 1), lambda s, k: F.slice(items, s + 1, F.get(b, k + 1) - s))
    # The bounds are computed once.
    return F.element_at(F.transform(F.array(F.concat(starts, F.array(F.size(items)))), cut), 1)
