"""Blocks: from parser output, Markdown or plain text to one row for each block in order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.structure import let, promoted
from granary.functions.text import trimmed

RUNS = "array<struct<type:string,content:string,text:string>>"
PAGES = (
    "array<array<struct<type:string,content:struct<level:int,title_content:{r},paragraph_content:{r},image_source:struct<path:string>,image_caption:{r},html:string,table_body:string,"
    "table_type:string,table_caption:{r},table_footnote:{r},list_items:array<struct<item_content:{r}>>>>>>"
).format(r=RUNS)
FLAT = "array<struct<type:string,text:string,text_level:int,page_idx:int,img_path:string,img_caption:array<string>,table_body:string,table_caption:array<string>,table_footnote:array<string>>>"
#: One block, as an element of a document's array.
BLOCK = "struct<page_num:int,block_type:string,level:int,text:string,image_path:string,image_caption:string,table_html:string,table_caption:string,table_footnote:string,table_image_path:string,table_type:string>"


def runs_text(runs: Column) -> Column:
    """Runs joined; an inline equation stands between dollar signs."""
    one = lambda r: F.when(r["type"] == "equation_inline", F.concat(F.lit("$"), F.coalesce(r["content"], r["text"], F.lit("")), F.lit("$"))).otherwise(F.coalesce(r["content"], r["text"], F.lit("")))
    return F.array_join(F.transform(F.coalesce(runs, F.array().cast(RUNS)), one), "")


def _block(page: Column, kind: Column, **values: Column) -> Column:
    names = ["level", "text", "image_path", "image_caption", "table_html", "table_caption", "table_footnote", "table_image_path", "table_type"]
    kinds = {"level": "int"}
    return F.struct(page.cast("int").alias("page_num"), kind.alias("block_type"), *(values.get(n, F.lit(None)).cast(kinds.get(n, "string")).alias(n) for n in names))


def _paragraph(page: Column, text: Column) -> Column:
    made = lambda level: _block(page, F.when(level.isNotNull(), "title").otherwise("paragraph"), level=level, text=text)
    return let(trimmed(text), lambda t: let(promoted(t), made))


def from_pages(docs: DataFrame, json_col: str = "json", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, blocks) of parsed pages: headers, footers and page numbers go, list items become paragraphs."""
    def page_blocks(page: Column, items: Column) -> Column:
        def blocks(b: Column) -> Column:
            c = b["content"]
            lists = F.transform(F.coalesce(c["list_items"], F.array()), lambda i: _paragraph(page, runs_text(i["item_content"])))
            image = _block(page, F.lit("image"), text=F.lit(""), image_path=c["image_source"]["path"], image_caption=runs_text(c["image_caption"]))
            html = F.coalesce(F.nullif(c["html"], F.lit("")), F.nullif(c["table_body"], F.lit("")))
            table = _block(page, F.lit("table"), text=F.lit(""), table_html=html, table_caption=runs_text(c["table_caption"]), table_footnote=runs_text(c["table_footnote"]), table_image_path=F.when(html.isNull(), c["image_source"]["path"]), table_type=c["table_type"])
            title = _block(page, F.lit("title"), level=F.coalesce(c["level"], F.lit(1)), text=runs_text(c["title_content"]))
            none = F.array().cast(f"array<{BLOCK}>")
            return (
                F.when(b["type"].isin("header", "footer", "page_number", "page_footnote"), none).when(b["type"] == "title", F.array(title)).when(b["type"] == "paragraph", F.array(_paragraph(page, runs_text(c["paragraph_content"]))))
                .when(b["type"] == "image", F.array(image)).when(b["type"] == "table", F.array(table)).when(b["type"] == "list", lists).otherwise(none)
            )

        return F.flatten(F.transform(items, blocks))

    pages = F.from_json(json_col, PAGES)
    return docs.select(F.col(id_col).alias("doc_id"), F.flatten(F.transform(pages, lambda p, n: page_blocks(n + 1, p))).alias("blocks"))


def from_flat(docs: DataFrame, json_col: str = "json", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, blocks) of a flat list with page numbers; text with a level is a title."""

    def block(b: Column) -> Column:
        page = F.coalesce(b["page_idx"], F.lit(0)) + 1
        joined = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), " ")
        image = _block(page, F.lit("image"), text=F.lit(""), image_path=b["img_path"], image_caption=joined(b["img_caption"]))
        table = _block(page, F.lit("table"), text=F.lit(""), table_html=b["table_body"], table_caption=joined(b["table_caption"]), table_footnote=joined(b["table_footnote"]), table_image_path=F.when(F.coalesce(b["table_body"], F.lit("")) == "", b["img_path"]))
        title = _block(page, F.lit("title"), level=b["text_level"], text=b["text"])
        return F.when(b["type"] == "image", image).when(b["type"] == "table", table).when(F.coalesce(b["text_level"], F.lit(0)) > 0, title).otherwise(_paragraph(page, F.coalesce(b["text"], F.lit(""))))

    kept = F.filter(F.from_json(json_col, FLAT), lambda b: ~b["type"].isin("header", "footer", "page_number"))
    return docs.select(F.col(id_col).alias("doc_id"), F.transform(kept, block).alias("blocks"))


def from_markdown(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", separator: str = r"\n[ \t]*\n\s*") -> DataFrame:
    """(doc_id, blocks) of Markdown: parts between blank lines, images on their own, headings by their marks."""
    image = r"!\[[^\]]*\]\([^)]+\)"
    marked = F.regexp_replace(F.col(text_col), f"({image})", "\u0001$1\u0001")
    pieces = F.flatten(F.transform(F.split(marked, separator), lambda p: F.split(p, "\u0001")))
    kept = F.filter(F.transform(pieces, lambda p: F.btrim(p)), lambda p: F.length(F.regexp_replace(p, r"\s+", "")) > 0)

    def block(p: Column) -> Column:
        one = F.lit(1)
        heading = F.regexp_extract(p, r"^(#{1,6})\s+\S", 1)
        return (
            F.when(p.rlike(f"^{image}$"), _block(one, F.lit("image"), text=F.lit(""), image_path=F.regexp_extract(p, r"\]\(([^)]+)\)", 1)))
            .when((heading != "") & ~p.contains("\n"), _block(one, F.lit("title"), level=F.length(heading), text=F.regexp_replace(p, r"^#{1,6}\s+", ""))).otherwise(_paragraph(one, p))
        )

    return docs.select(F.col(id_col).alias("doc_id"), F.transform(kept, block).alias("blocks"))


def from_lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, blocks) of plain text: each line that is not blank is a block."""
    lines = F.filter(F.split(F.col(text_col), "\n"), lambda p: F.length(F.btrim(p)) > 0)
    return docs.select(F.col(id_col).alias("doc_id"), F.transform(lines, lambda p: _paragraph(F.lit(1), p)).alias("blocks"))


def from_every_line(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", level: Callable[[Column], Column] | None = None) -> DataFrame:
    """(doc_id, blocks) of plain text in which each line is a block as it stands, blank ones too: a paragraph, or a title where ``level`` of its place, from 0, is a number."""
    def block(p: Column, k: Column) -> Column:
        number = (F.lit(None) if level is None else level(k)).cast("int")
        return _block(F.lit(1), F.when(number.isNotNull(), "title").otherwise("paragraph"), level=number, text=p)

    return docs.select(F.col(id_col).alias("doc_id"), F.transform(F.split(F.col(text_col), "\n"), block).alias("blocks"))


def text_layer_block(page: Column, text: Column) -> Column:
    """A block of a page's text layer. The openings and endings that make it a title whatever else it says."""
    titled = (F.startswith(text, F.lit("第")) & (F.contains(text, F.lit("章")) | F.contains(text, F.lit("条")))) | F.endswith(text, F.lit("通知")) | F.startswith(text, F.lit("济政发"))
    return F.when(titled, _block(page, F.lit("title"), level=F.lit(1), text=text)).otherwise(_paragraph(page, text))


def from_text_layer(docs: DataFrame, pages_col: str = "pages", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, blocks) of text layers, ``pages array<array<string>>``: what a reader of the file found on each page, in order."""
    pages = F.transform(pages_col, lambda held, n: F.transform(F.coalesce(held, F.array().cast("array<string>")), lambda t: text_layer_block(n + 1, t)))
    return docs.select(F.col(id_col).alias("doc_id"), F.flatten(pages).alias("blocks"))


def exploded(docs: DataFrame) -> DataFrame:
    """One row for each block with its place in the document."""
    return docs.select("doc_id", F.posexplode("blocks").alias("ord", "b")).select("doc_id", "ord", "b.*")


def gathered(blocks: DataFrame) -> DataFrame:
    """(doc_id, blocks) from rows of blocks, in their order; a document's blocks fit one row by contract."""
    names = [p.split(":")[0] for p in BLOCK[len("struct<") : -1].split(",")]
    row = F.struct(F.col("ord"), F.struct(*names).cast(BLOCK).alias("b"))
    return blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("rows")).select("doc_id", F.transform("rows", lambda r: r["b"]).alias("blocks"))


def block_chars(b: Column) -> Column:
    """Characters that count towards a chunk: of titles and paragraphs, and what a table shows."""
    from granary.functions.text import strip_tags

    return F.when(b["block_type"].isin("title", "paragraph"), F.length(F.coalesce(b["text"], F.lit("")))).when(b["block_type"] == "table", F.length(strip_tags(b["table_html"]))).otherwise(0)


def block_images(b: Column) -> Column:
    return F.when((b["block_type"] == "image") & b["image_path"].isNotNull(), 1).otherwise(0)


def parse_statistics(blocks: DataFrame, file_col: str = "file") -> DataFrame:
    """Blocks, titles and paragraphs, and characters of each parsed file, and the best file of each document."""
    per_file = blocks.groupBy("doc_id", file_col).agg(F.count("*").alias("blocks"), F.count_if(F.col("block_type").isin("title", "paragraph")).alias("texts"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))
    rank = Window.partitionBy("doc_id").orderBy(F.desc("blocks"), F.desc("texts"), F.desc("chars"), file_col)
    return per_file.withColumn("best", F.row_number().over(rank) == 1)


def parse_is_trivial(blocks: Column, texts: Column, chars: Column) -> Column:
    """Why a parse is as good as empty, or null: fewer than 3 blocks, no title or paragraph, under 50 characters."""
    return F.when(blocks < 3, "few blocks").when(texts == 0, "no text blocks").when(chars < 50, "few characters")


def output_is_trivial(json_chars: Column, markdown_chars: Column) -> Column:
    """The parser's own test: under 100 characters in all its outputs together."""
    return F.coalesce(json_chars, F.lit(0)) + F.coalesce(markdown_chars, F.lit(0)) < 100
