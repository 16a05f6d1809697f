"""Documents too large for a row: blocks as rows, read in order by a table function that holds one chunk at a time.

The array path keeps a document's blocks in one row. A document of millions of blocks comes as ``rows(doc_id, ord, block_type, text, ...)``, one for
each block; Spark deals them out by document and sorts them (spilling where it must), and the function's state is a packer, which has the chunk that is open. A chunk leaves as soon as the next begins.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from granary import runtime
from granary.config import ChunkConfig
from granary.operators import chunking
from granary.operators import regions as R

#: Fields of a block; those that rows lack are null.
FIELDS = ["page_num", "block_type", "level", "text", "image_path", "image_caption", "table_html", "table_caption", "table_footnote", "table_image_path", "table_type"]
PARTS = "doc_id long, region_no int, part int, body string, char_count int, image_refs array<string>"


class PackRows:
    """Sentences of a document's blocks packed to a target: a part each time one is full, the last at the end."""

    def __init__(self):
        self.packer: chunking.Packer | None = None
        self.doc: tuple = (None, None)
        self.part = 0

    def _left(self, last: bool) -> Iterator[tuple]:
        if self.packer is None:
            return
        for held in self.packer.result() if last else self.packer.done:
            self.part += 1
            yield *self.doc, self.part, chunking.body(chunking.Draft("", "single", held)), sum(map(chunking.chars, held)), chunking.refs(held)
        self.packer.done.clear()

    def eval(self, row: Row, target: int, overlap: int, cap: int) -> Iterator[tuple]:
        if self.packer is None:
            self.packer, self.doc = chunking.Packer(target, overlap, cap), (row["doc_id"], row["region_no"])
        self.packer.add({f: row[f] for f in FIELDS})
        yield from self._left(False)

    def terminate(self) -> Iterator[tuple]:
        yield from self._left(True)


INTERVALS = "doc_id long, regions array<struct<region_no:int,kind:string,title:string,begin:long,end:long>>"
#: Fixed: the lines of contents, as ``regions.toc_like`` knows them.
_ENTRY = r"(?Us)[….·]{2,}", r"(?Us)\d+\)?\s*$"


def region_intervals(rows: DataFrame) -> DataFrame:
    """(doc_id, regions): what blocks, from begin to end, each region of a document has; ``ord`` counts a document's blocks from 0.

    Regions are set by titles and by lines of contents alone, so a document's outline, its titles and such lines with their places, is all that comes together in a row; other
    blocks are told by the gaps between. A region without its cover's titles has several intervals.
    """
    runtime.ship(rows.sparkSession)
    outlined = (F.col("block_type") == "title") | ((F.col("block_type") == "paragraph") & F.col("text").rlike(_ENTRY[0]) & F.col("text").rlike(_ENTRY[1]))
    line = F.when(outlined, F.struct(F.col("ord").cast("long").alias("ord"), "block_type", "level", "text"))
    level = F.col("level") if "level" in rows.columns else F.lit(None)
    outlines = rows.withColumn("level", level.cast("int")).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.array_sort(F.collect_list(line)).alias("lines"), (F.max("ord") + 1).cast("long").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("region_no", pa.int32()), ("kind", pa.string()), ("title", pa.string()), ("begin", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            found = [_intervals(lines, n) for lines, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "regions"])

    return outlines.select("doc_id", "lines", "n").mapInArrow(run, INTERVALS)


def _intervals(lines: list[dict], n: int) -> list[dict]:
    """Regions of an outline, in which one block stands for each run of others."""
    held, at = [], 0
    for x in [*lines, {"ord": n}]:
        if x["ord"] > at:
            held.append({"block_type": "run", "text": "", "level": None, "begin": at, "end": x["ord"]})
        if "block_type" in x:
            held.append(x | {"begin": x["ord"], "end": x["ord"] + 1})
        at = x["ord"] + 1
    out = []
    for number, region in enumerate(R.regions(held), 1):
        for b in region.blocks:
            if out and out[-1]["region_no"] == number and out[-1]["end"] == b["begin"]:
                out[-1]["end"] = b["end"]
            else:
                out.append({"region_no": number, "kind": region.kind, "title": region.title, "begin": b["begin"], "end": b["end"]})
    return out


def with_regions(rows: DataFrame, intervals: DataFrame) -> DataFrame:
    """Blocks with their region's number, kind and title; one row for each region that has the block, none for a block in a gap."""
    here = F.filter("regions", lambda r: (F.col("ord") >= r["begin"]) & (F.col("ord") < r["end"]))
    joined = rows.join(intervals, rows["doc_id"].eqNullSafe(intervals["doc_id"])).select(*(rows[c] for c in rows.columns), F.explode(here).alias("region"))
    return joined.select(*rows.columns, F.col("region.region_no").alias("region_no"), F.col("region.kind").alias("region_kind"), F.col("region.title").alias("region_title"))


def pack_rows(rows: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """doc_id, part, parts, body (its first line, the title, empty), char_count, image_refs: the sentence strategy over rows(doc_id, ord, block_type, text, ...), tables left out, as they are chunks of their own.

    Rows with a region_no are packed region by region, and the result has it too.

    A null text is empty; rows of one ``ord`` come in any order; blocks without a document id are one document.
    """
    runtime.ship(rows.sparkSession)
    known = [F.col(f) if f in rows.columns else F.lit(None).cast("int" if f in ("page_num", "level") else "string").alias(f) for f in FIELDS]
    by_region = "region_no" in rows.columns
    keys = ["doc_id", "region_no"] if by_region else ["doc_id"]
    number = F.col("region_no").cast("int") if by_region else F.lit(None).cast("int").alias("region_no")
    held = rows.where("block_type <> 'table'").select(F.col("doc_id").cast("long").alias("doc_id"), number, "ord", *known)
    pack = F.udtf(PackRows, returnType=PARTS)
    out = pack(held.asTable().partitionBy(*keys).orderBy("ord"), F.lit(config.split_target), F.lit(config.overlap), F.lit(config.max_images))
    # One number for each document; the bodies are not dealt out again.
    parts = out.select("*", F.max("part").over(Window.partitionBy(*keys)).alias("parts"))
    return parts.select(*keys, "part", "parts", "body", "char_count", "image_refs")
