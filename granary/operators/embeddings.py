"""The contract with an embedding service: texts go out in batches, answers come in two shapes, and a document has all its vectors or none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VECTORS = "array<array<float>>"


def requests(texts: DataFrame, size: int = 20) -> DataFrame:
    """``texts(doc_id, ord, text)`` in batches of ``size`` in their order: doc_id, batch_no, texts, request (JSON)."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")) - 1
    rows = texts.select("doc_id", "ord", "text", F.floor(place / size).cast("int").alias("batch_no")).groupBy("doc_id", "batch_no").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("held"))
    named = rows.select("doc_id", "batch_no", F.col("held.text").alias("texts"))
    return named.withColumn("request", F.to_json(F.struct("texts", F.lit("document").alias("text_type"))))


def answered(response: Column) -> Column:
    """Vectors of an answer of either shape, ``{"data": [{"embedding": ...}]}`` or ``{"embeddings": [...]}``; null if it has none."""
    listed = F.from_json(response, "struct<data:array<struct<embedding:array<float>>>>")["data"]
    plain = F.from_json(response, f"struct<embeddings:{VECTORS}>")["embeddings"]
    found = F.coalesce(F.transform(listed, lambda d: d["embedding"]), plain)
    return F.when(F.size(found) > 0, found)


def complete(batches: DataFrame, responses: DataFrame) -> DataFrame:
    """(doc_id, texts, vectors) of the documents whose every text has a vector; the others have no row, and fall back to a strategy without vectors.

    ``batches(doc_id, batch_no, texts)``, ``responses(doc_id, batch_no, response)``.
    """
    rows = batches.join(responses, ["doc_id", "batch_no"], "left").select("doc_id", "batch_no", "texts", answered(F.col("response")).alias("vectors"))
    right = F.coalesce(F.size("texts") == F.size("vectors"), F.lit(False))
    held = rows.groupBy("doc_id").agg(F.bool_and(right).alias("all"), F.array_sort(F.collect_list(F.struct("batch_no", "texts", "vectors"))).alias("b")).where("all")
    return held.select("doc_id", F.flatten("b.texts").alias("texts"), F.flatten("b.vectors").alias("vectors"))


def sentence_vectors(found: DataFrame) -> DataFrame:
    """(doc_id, sentence_vectors): as the strategies that compare vectors take them; of equal texts the first vector counts."""
    pairs = F.arrays_zip(F.col("texts").alias("t"), F.col("vectors").alias("v"))
    firsts = F.filter(pairs, lambda p, k: F.array_position(F.col("texts"), p["t"]) == k + 1)
    return found.select("doc_id", F.map_from_entries(F.transform(firsts, lambda p: F.struct(p["t"], p["v"]))).alias("sentence_vectors"))
