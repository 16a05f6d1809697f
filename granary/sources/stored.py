"""A stored ledger: a table in buckets of its keys, whose changes rewrite only the buckets they touch.

A change reads the touched buckets alone (the scan is pruned to their folders), merges them, stores the result, and then replaces those folders by a
dynamic partition overwrite; a bucket that ends without rows is deleted. Each bucket is replaced as a whole, and a change that is
run again gives the same table, so what a lost driver left half done is mended by running it again. There is one writer at a time, as
in any table without a transaction log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from granary import runtime
from granary.operators import ledger

BUCKET = "granary_bucket"


class StoredLedger:
    """``path`` holds rows of ``schema`` (names and types), one for each value of ``keys``, which are never null."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], buckets: int = 256):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self.schema = StructType(list(schema.fields))
        self.columns = [f.name for f in schema.fields]

    def bucket(self) -> Column:
        """The bucket of a row: from the MD5 of its keys, so that it is the same in every version and engine."""
        return (F.conv(F.substring(F.md5(F.concat_ws("\x1f", *(F.col(k).cast("string") for k in self.keys)).cast("binary")), 1, 6), 16, 10).cast("int") % self.buckets).alias(BUCKET)

    def rows(self) -> DataFrame:
        """The table, with the bucket of each row."""
        return self.spark.read.schema(StructType([*self.schema.fields, StructField(BUCKET, IntegerType())])).parquet(self.path)

    def read(self) -> DataFrame:
        return self.rows().select(*self.columns)

    def create(self, rows: DataFrame) -> None:
        """The first version, written to a new path."""
        self._dealt(rows).write.partitionBy(BUCKET).parquet(self.path)

    def upsert(self, updates: DataFrame, preserved: list[str] | None = None, order: str | None = None) -> list[int]:
        """Write rows by key; ``preserved`` columns keep what they have, of several rows of a key that with the greatest ``order`` wins. Returns the buckets rewritten."""
        updates = ledger.last_write(updates, self.keys, order) if order else updates
        updates = updates.select(*self.columns)
        merge = (lambda old: ledger.upsert_preserving(old, updates, self.keys, preserved)) if preserved else (lambda old: ledger.upsert(old, updates, self.keys))
        return self._changed(updates, merge)

    def update(self, updates: DataFrame) -> list[int]:
        """Values that are neither null nor blank go into the rows there are."""
        return self._changed(updates, lambda old: ledger.update_present(old, updates, self.keys))

    def delete(self, keys: DataFrame) -> list[int]:
        return self._changed(keys, lambda old: ledger.delete(old, keys.select(*self.keys), self.keys))

    def files(self) -> DataFrame:
        """(bucket, file): what the table consists of, to see what a change has replaced."""
        return self.rows().select(BUCKET, F.col("_metadata.file_name").alias("file")).distinct()

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.select(*self.columns, self.bucket()).repartition(BUCKET)

    def _changed(self, changes: DataFrame, merge) -> list[int]:
        touched = sorted(r[0] for r in changes.select(self.bucket()).distinct().collect())  # one number for each bucket at most
        if not touched:
            return []
        old = self.rows().where(F.col(BUCKET).isin(touched)).select(*self.columns)
        merged = runtime.materialize(self._dealt(merge(old)), "ledger")
        left = {r[0] for r in merged.select(BUCKET).distinct().collect()}
        merged.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)
        for gone in set(touched) - left:
            runtime.delete(self.spark, f"{self.path}/{BUCKET}={gone}")
        runtime.forget(merged)
        return touched
