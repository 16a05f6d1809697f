"""Segments: chunks prepared for a knowledge base, and their images' addresses."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from granary.config import ChunkConfig
from granary.operators import tables as T
from granary.operators.ledger import batches

# Types as objects: executors import this module without a session to read a type from text.
T_STRING, _STRINGS = StringType(), ArrayType(StringType())


@F.pandas_udf(_STRINGS)
def segment_pieces(content: pd.Series, limit: pd.Series) -> pd.Series:
    """An oversize text with its tables as Markdown, split; any other as it is."""
    made = [[] if c is None else [c] if len(c) <= n else T.split_oversize(T.tables_to_markdown(c), n) for c, n in zip(content, limit)]
    return pd.Series(made, dtype=object)


def table_parts(html: Column, most: int) -> Column:
    """Parts of at most ``most`` body rows, each with the opening tag and the head of the whole table, as ``tables.split_rows`` cuts them; none of a null."""
    head, opening = F.regexp_extract(html, r"(?is)<thead\b[^>]*>.*?</thead\s*>", 0), F.regexp_extract(html, r"(?i)<table\b[^>]*>", 0)
    rows = F.regexp_extract_all(F.regexp_replace(html, r"(?is)^(.*?)<thead\b[^>]*>.*?</thead\s*>", "$1"), F.lit(r"(?is)<tr[\s>/].*?</tr\s*>"), F.lit(0))
    start = F.concat(F.when(opening == "", "<table>").otherwise(opening), head)
    cut = lambda r: F.transform(F.sequence(F.lit(0), F.ceil(F.size(r) / most).cast("int") - 1), lambda i: F.concat(start, F.array_join(F.slice(r, i * most + 1, most), ""), F.lit("</table>")))
    # The rows are found once.
    parts = F.element_at(F.transform(F.array(rows), lambda r: F.when(F.size(r) <= most, F.array(html)).otherwise(cut(r))), 1)
    return F.when(html.isNull(), F.array().cast("array<string>")).otherwise(parts)


@F.pandas_udf(T_STRING)
def table_markdown(html: pd.Series) -> pd.Series:
    return html.map(lambda h: None if h is None else T.tables_to_markdown(h).strip())


def prepare(segments: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Payload rows: doc_id, ord, piece_no, content, answer, keywords, attachment_ids, batch_no. What is said of a segment goes with its first piece only."""
    # Only oversize texts leave the JVM.
    size, most = F.length("content"), config.segment_chars
    pieces = F.when(size <= most, F.array("content")).otherwise(segment_pieces(F.when(size > most, F.col("content")), F.lit(most)))
    cut = segments.withColumn("p", pieces).select("*", F.posexplode("p").alias("piece_no", "piece"))
    first = lambda c: F.when(F.col("piece_no") == 0, F.col(c))
    rows = cut.select("doc_id", "ord", "piece_no", F.col("piece").alias("content"), first("answer").alias("answer"), first("keywords").alias("keywords"), first("attachment_ids").alias("attachment_ids"))
    return batches(rows, ["ord", "piece_no"], config.segment_batch, "doc_id")


def retried(payload: DataFrame, refused: DataFrame, most: int = 10) -> DataFrame:
    """The rows of batches that were refused, ``refused(doc_id, batch_no)``, with at most ``most`` attachments each for another try."""
    again = payload.join(refused.select("doc_id", "batch_no").distinct(), ["doc_id", "batch_no"], "left_semi")
    return again.withColumn("attachment_ids", F.slice("attachment_ids", 1, most))


def keywords(chunk_type: Column, table_name: Column) -> Column:
    """Keywords of a table's chunk: that it is one, and its name."""
    return F.when(chunk_type == "table", F.filter(F.array(F.lit("table"), table_name), lambda k: k.isNotNull() & (k != "")))


def image_address(stored: Column, public: Column, uploaded: Column, relative: Column) -> Column:
    """Where an image is found: object store, public host, upload, else its relative path."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in (stored, public, uploaded)), relative)


def missing_images(chunks: DataFrame, images: DataFrame) -> DataFrame:
    """References of chunks without an image file, by path or, failing that, by name."""
    refs = chunks.select("doc_id", F.explode("image_refs").alias("path")).distinct().withColumn("name", F.element_at(F.split("path", "/"), -1))
    return refs.join(images.select("doc_id", "path"), ["doc_id", "path"], "left_anti").join(images.select("doc_id", F.element_at(F.split("path", "/"), -1).alias("name")), ["doc_id", "name"], "left_anti").select("doc_id", "path")


def zipped(chunks: DataFrame, created: DataFrame) -> DataFrame:
    """Chunks with the segments made of them, by their places; never by partition order."""
    return chunks.join(created, ["doc_id", "ord"], "left")
