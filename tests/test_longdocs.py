"""Documents as rows of blocks against the array path, and one of very many blocks."""

import random

from pyspark.sql import functions as F

from granary.config import ChunkConfig
from granary.operators import blocks as B
from granary.operators import chunking, longdocs
from granary.operators import regions as R

SMALL = ChunkConfig(split_target=120, overlap=20, max_images=2)


def exploded(docs):
    return docs.select("doc_id", F.posexplode("blocks").alias("ord", "b")).select("doc_id", "ord", "b.*").repartition(5)


def test_equal_to_the_array_path(spark, sf):
    text = F.regexp_replace("text", r"(?m)^[#\d].*$", "plain. line")
    docs = B.from_markdown(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", text.alias("text")))
    # Those of one region without titles: what is packed as a whole.
    docs = docs.where(~F.exists("blocks", lambda b: b["block_type"].isin("title", "table")))
    want = {(r["doc_id"], r["chunk_no"]): (r["char_count"], r["image_refs"], r["body"].split("\n", 1)[1].lstrip("\n")) for r in chunking.chunk_documents(docs, "sentence", SMALL).collect()}
    got = {(r["doc_id"], r["part"]): (r["char_count"], r["image_refs"], r["body"].split("\n", 1)[1].lstrip("\n")) for r in longdocs.pack_rows(exploded(docs), SMALL).collect()}
    assert len(want) > 300 and got == want


def test_regions_are_those_of_the_array_path(spark):
    rng = random.Random(7)
    lines = ["目录", "1 Scope ..... 1", "2 Terms …… 12)", "前言", "1 总则", "2 Terms", "附录 A 说明", "参考文献", "1.1 first", "plain text here.", "more text.", "中国工程建设标准化协会标准", "Abstract", "3"]
    docs = [(k, "\n".join(rng.choices(lines, k=rng.randint(1, 14)))) for k in range(400)]
    blocks = B.from_lines(spark.createDataFrame(docs, "doc_id long, text string"))
    want, kinds = {}, set()
    for r in blocks.collect():
        held = [b.asDict() | {"at": k} for k, b in enumerate(r["blocks"])]
        for n, region in enumerate(R.regions(held), 1):
            kinds.add(region.kind)
            for b in region.blocks:
                want.setdefault((r["doc_id"], b["at"]), set()).add((n, region.kind, region.title))
    rows = exploded(blocks)
    got = {}
    for r in longdocs.with_regions(rows, longdocs.region_intervals(rows)).collect():
        got.setdefault((r["doc_id"], r["ord"]), set()).add((r["region_no"], r["region_kind"], r["region_title"]))
    assert got == want and kinds >= {"cover", "toc", "preface", "body", "appendix", "reference", "single"}
    packed = longdocs.pack_rows(longdocs.with_regions(rows, longdocs.region_intervals(rows)), SMALL).collect()
    assert {(r["doc_id"], r["region_no"]) for r in packed} == {(d, n) for (d, _), regions in want.items() for n, _, _ in regions}


def test_odd_rows(spark):
    rows = [(1, 0, "paragraph", None, None), (1, 1, "image", "", "a.png"), (1, 2, "image", "", "b.png"), (1, 3, "image", "", "c.png"), (1, 4, "table", "", None), (2, 0, "paragraph", "x. " * 200, None), (None, 0, "paragraph", "no id.", None)]
    got = {}
    for r in longdocs.pack_rows(spark.createDataFrame(rows, "doc_id long, ord int, block_type string, text string, image_path string"), SMALL).collect():
        got.setdefault(r["doc_id"], []).append((r["part"], r["parts"], r["char_count"], r["image_refs"]))
    assert sorted(got[1]) == [(1, 2, 0, ["a.png", "b.png"]), (2, 2, 0, ["c.png"])] and len(got[2]) == got[2][0][1] > 4 and got[None] == [(1, 1, 6, [])]
    assert longdocs.pack_rows(spark.createDataFrame([], "doc_id long, ord int, block_type string, text string")).count() == 0


def test_a_document_of_very_many_blocks(spark):
    n = 300_000
    rows = spark.range(n).select(F.lit(1).alias("doc_id"), F.col("id").alias("ord"), F.lit("paragraph").alias("block_type"), F.format_string("Sentence %07d.", "id").alias("text")).repartition(8)
    out = longdocs.pack_rows(rows, ChunkConfig(split_target=1600, overlap=0))
    got = out.agg(F.count("*").alias("n"), F.sum("char_count").alias("chars"), F.max("parts").alias("parts"), F.max("char_count").alias("most"), F.min("body").alias("first")).first()
    assert got["chars"] == 17 * n and got["n"] == got["parts"] == -(-n // 94) and got["most"] <= 1600
