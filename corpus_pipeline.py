"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Defined results of every stage: a null or empty text is rejected by the first; a null document id is kept as any other and ranks last
where documents are compared; repeated rows are documents of their own, of which the second stage keeps one; an empty table gives no
row; further columns, whatever their names, are passed on by all stages but the last, which returns its own.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary import runtime
from granary.llm import decontam, langid, packing, simhash, tokens, unitdedup
from granary.llm.queries import HELD_OUT


def _begin(spark: SparkSession) -> None:
    """What the stage before left in scratch tables is not needed once its result is written."""
    runtime.release(runtime.ship(spark))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the corpus teaches; those without a letter, or foreign to all, go."""
    _begin(spark)
    docs = runtime.spread(docs)
    return langid.accepted(docs, langid.fit(docs.where(f"not ({HELD_OUT})")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (similar by 0.8 or more): that with the smallest id, one without an id last; of equal ids one row."""
    _begin(spark)
    return simhash.distinct_documents(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has; a document left without text goes."""
    _begin(spark)
    cut = unitdedup.dedup(docs).where("text is not null and length(trim(text)) > 0")
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    _begin(spark)
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences of 1024 ids, with their ids."""
    _begin(spark)
    return packing.pack(docs, tokens.definition(public_tokenizers.path("byte_bpe_50k.json")), size=1024, end_id=0)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("packing", packed),
]

#: No stage can be expressed in SQL alone; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; every result but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root, path = f"{runtime.scratch_root(spark)}/granary-pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            # Stored where ``runtime.release`` finds it, so that nothing of the stages before is needed or left.
            out = runtime.materialize(out, "pipeline")
            runtime.delete(spark, root)
            return out
        written = f"{root}/{k}-{name}"
        out.write.parquet(written)
        if path:
            runtime.delete(spark, path)
        path, docs = written, spark.read.parquet(written)
