"""Sinks: chunks, images and requests as files, segment payloads, image listings, log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.sources import datasource


def chunk_files(chunks: DataFrame, path: str) -> None:
    """Each chunk as a Markdown file in its document's folder."""
    datasource.write_files(chunks.select(F.concat_ws("/", F.col("doc_id").cast("string"), "file_name").alias("path"), F.col("body").cast("binary").alias("content")), path)


def metadata_files(metadata: DataFrame, path: str) -> None:
    """metadata(doc_id, metadata): the list of a document's chunks as a file beside them."""
    datasource.write_files(metadata.select(F.concat(F.col("doc_id").cast("string"), F.lit("/metadata.json")).alias("path"), F.col("metadata").cast("binary").alias("content")), path)


def copied_images(refs: DataFrame, images: DataFrame, path: str) -> None:
    """Images that refs(doc_id, ref) name, of images(doc_id, path, content), copied to ``images`` in the document's folder; each once, by path or, failing that, by name."""
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    asked = refs.select("doc_id", F.replace(F.col("ref"), F.lit("\\"), F.lit("/")).alias("ref")).where("ref <> ''").distinct().withColumn("name", name("ref"))
    there = images.select("doc_id", name("path").alias("name"), F.col("path").alias("there"), "content")
    # A name of a document has one place to go, so of several images with it one is copied: that at the path asked for, else the first.
    exact = F.exists("refs", lambda r: F.endswith(F.col("there"), r))
    held = asked.groupBy("doc_id", "name").agg(F.collect_set("ref").alias("refs")).join(there, ["doc_id", "name"])
    best = held.groupBy("doc_id", "name").agg(F.min_by("content", F.struct(~exact, "there")).alias("content"))
    datasource.write_files(best.select(F.concat(F.col("doc_id").cast("string"), F.lit("/images/"), "name").alias("path"), "content"), path)


def request_files(requests: DataFrame, path: str) -> None:
    """requests(doc_id, batch_no, request), for a client that posts them, as a file each."""
    datasource.write_files(requests.select(F.format_string("%s/batch_%05d.json", F.col("doc_id").cast("string"), "batch_no").alias("path"), F.col("request").cast("binary").alias("content")), path)


def segment_requests(payload: DataFrame) -> DataFrame:
    """One request for each batch of a document: a bounded list of segments in their order."""
    row = F.struct("ord", "piece_no", "content", "answer", "keywords", "attachment_ids")
    held = payload.groupBy("doc_id", "batch_no").agg(F.array_sort(F.collect_list(row)).alias("segments"))
    return held.select("doc_id", "batch_no", F.to_json(F.struct(F.transform("segments", lambda s: F.struct(s["content"].alias("content"), s["answer"].alias("answer"), s["keywords"].alias("keywords"), s["attachment_ids"].alias("attachment_ids"))).alias("segments"))).alias("request"))


def new_objects(images: DataFrame, stored: DataFrame, key: str = "key") -> DataFrame:
    """Images that the store does not have yet."""
    return images.join(stored.select(key), key, "left_anti")


def log_lines(events: DataFrame, level: str = "INFO") -> DataFrame:
    """Structured log lines of events."""
    return events.select(F.to_json(F.struct(F.lit(level).alias("level"), *[F.col(c) for c in events.columns])).alias("line"))
