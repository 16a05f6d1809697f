"""Connected components of links between integers, by alternating large and small stars.

Every round is two pairs of aggregate and join over the links that are left; no node's links are ever
gathered into one row or task, and nothing but two numbers a round reaches the driver. Each round's
tables are stored in the shared folder and deleted once the next has replaced them. At most ``few``
links, which one task holds in a few tens of megabytes, are finished there instead: their number is
counted first, and the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary import runtime

FEW = 1_000_000
SCHEMA = "node long, component long"


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links between integers, as many as join the same components: from each node to its least."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    least = np.arange(len(nodes))
    while len(i):
        was = least.copy()
        low = np.minimum(least[i], least[j])
        np.minimum.at(least, least[i], low)
        np.minimum.at(least, least[j], low)
        while (least != (up := least[least])).any():
            least = up
        if (was == least).all():
            break
    keep = np.flatnonzero(least != np.arange(len(nodes)))
    return nodes[keep], nodes[least[keep]]


def _at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [tuple(np.asarray(c.to_numpy(zero_copy_only=False), np.int64) for c in batch.columns) for batch in batches]
    if held:
        node, least = spanning(*(np.concatenate(x) for x in zip(*held)))
        top = np.unique(least)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([node, top])), pa.array(np.concatenate([least, top]))], names=["node", "component"])


def _round(now: DataFrame) -> DataFrame:
    """A large star and a small star; what they needed is deleted."""
    both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # Stored, so that the join gets an exchange of its own on either side and a node of very many links can be split.
    least = runtime.materialize(both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("m")), "stars")
    large = runtime.materialize(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "stars")
    lower = runtime.materialize(large.groupBy("a").agg(F.min("b").alias("m")), "stars")
    small = large.join(lower, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lower.select("a", F.col("m").alias("b")))
    out = runtime.materialize(small.distinct(), "stars")
    for table in (now, least, large, lower):
        runtime.forget(table)
    return out


def components(links: DataFrame, few: int | None = None) -> DataFrame:
    """(node, component) for every node in ``links(a, b)``; component is the least node reachable. A link of a node with itself is none."""
    runtime.ship(links.sparkSession)
    now = runtime.materialize(links.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).where("a <> b").distinct(), "stars")
    if now.count() <= (FEW if few is None else few):
        return now.repartition(1).mapInArrow(_at_once, SCHEMA)
    mark = None
    while True:  # each round shortens every path to its least node, so the links settle
        now = _round(now)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == mark:
            break
        mark = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
