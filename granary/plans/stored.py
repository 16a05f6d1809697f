"""Queries that write and read back: the stored ledger, streams into it, files one for each row, workbooks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary import runtime
from granary.operators import blocks as B
from granary.operators import chunking
from granary.plans.documents import table
from granary.sources import datasource, files, sinks, stored
from granary.streaming import tasks


def stored_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a stored ledger of 64 buckets; a few are upserted, a few added, some deleted: rows and states of each bucket, and whether its files are others than before."""
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("t"), (F.col("o_custkey") % 5).cast("string")).alias("tenant_id"), F.col("o_orderkey").cast("string").alias("filename"), F.col("o_orderstatus").alias("status"), F.lit("first").alias("create_time"))
    ledger = stored.StoredLedger(spark, runtime.scratch_path(spark, "stored"), rows.schema, ["tenant_id", "filename"], 64)
    ledger.create(rows)
    before = runtime.materialize(ledger.files(), "files")
    k = F.col("filename").cast("long")
    again = rows.where(k % 997 == 5)
    new = again.withColumn("status", F.lit("NEW")).withColumn("create_time", F.lit("second"))
    ledger.upsert(new.unionByName(new.withColumn("filename", F.concat("filename", F.lit("x")))), preserved=["create_time"])
    ledger.delete(rows.where(k % 997 == 6))
    same = ledger.files().join(before, [stored.BUCKET, "file"]).groupBy(stored.BUCKET).agg(F.count("*").alias("same"))
    found = ledger.rows().groupBy(stored.BUCKET).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "NEW").alias("fresh"), F.count_if(F.col("create_time") == "second").alias("second"))
    return found.join(same, stored.BUCKET, "left").select(F.col(stored.BUCKET).alias("bucket"), "n", "fresh", "second", F.col("same").isNull().alias("rewritten"))


STORED_SQL = """
with o as (select 't' || (o_custkey % 5) as t, cast(o_orderkey as varchar) as f, o_orderkey as k, 'first' as c from orders),
n as (select * from o union all select t, f || 'x', k, 'second' from o where k % 997 = 5),
b as (select *, cast(cast('0x' || left(md5(t || chr(31) || f), 6) as integer) % 64 as integer) as bucket from n),
w as (select bucket, bool_or(k % 997 in (5, 6)) as rewritten from b group by bucket)
select b.bucket, count(*) as n, count(*) filter (where k % 997 = 5) as fresh, count(*) filter (where c = 'second') as second, any_value(rewritten) as rewritten
from b join w using (bucket) where k % 997 <> 6 group by b.bucket
"""


def task_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of tasks, one for each user and day, kept in a stored table; purchases end a task, which expires after a day."""
    events = table(spark, sf_dir, "events")
    task = F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd"))
    rows = events.select(task.alias("task_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("int").alias("progress"), F.col("event_type").alias("msg"), F.when(F.col("event_type") == "purchase", "done").otherwise("parsing").alias("status"))
    source = runtime.scratch_path(spark, "events")
    seen = tasks.table(spark, runtime.scratch_path(spark, "tasks"), 16)
    seen.create(spark.createDataFrame([], seen.schema))
    checkpoint = runtime.scratch_path(spark, "stream")
    # The second run sees the watermark of the first, so that timers fire; its one event has the time of the last.
    for k, part in enumerate((rows, rows.agg(F.max("ts").alias("ts")).select(F.lit("tick").alias("task_id"), "ts", F.lit(0).alias("progress"), F.lit("").alias("msg"), F.lit("parsing").alias("status")))):
        part.write.parquet(f"{source}/part={k}")
        stream = spark.readStream.schema(tasks.EVENT).option("recursiveFileLookup", "true").parquet(source)
        tasks.follow(stream, seen, checkpoint, keep=86_400, late="1 hour").awaitTermination()
    return seen.read().where("task_id <> 'tick'").select("task_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "progress", "status", "updates")


TASKS_SQL = """
with e as (select user_id || '-' || strftime(ts, '%Y%m%d') as task_id, ts, cast(event_id as integer) as progress, case when event_type = 'purchase' then 'done' else 'parsing' end as status from events),
l as (select task_id, max(ts) as ts, arg_max(progress, (ts, progress)) as progress, arg_max(status, (ts, progress)) as status, count(*) as updates from e group by task_id)
select * from l where status <> 'done' or ts + interval 1 day > (select max(ts) from e) - interval 1 hour
"""


def chunk_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all documents as files, one each, in folders by document; read back from the store."""
    text = F.concat_ws("\n", F.lit("1 Alpha"), F.concat(F.lit("w0 "), F.md5(F.col("text").cast("binary"))), F.lit("2 Beta: x/y"), F.concat(F.lit("w1 "), F.sha1(F.col("text").cast("binary"))))
    docs = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    chunks = chunking.chunk_documents(B.from_lines(docs), "structure")
    path = runtime.scratch_path(spark, "chunks")
    sinks.chunk_files(chunks, path)
    parts = F.split("path", "/")
    return datasource.read_files(spark, path).select(F.element_at(parts, -2).cast("long").alias("doc_id"), F.element_at(parts, -1).alias("file_name"), F.md5("content").alias("body_md5"))


FOLDERS_SQL = """
select doc_id, 'chunk_001_1_Alpha.md' as file_name, md5('1 Alpha' || chr(10) || 'w0 ' || md5(text) || chr(10)) as body_md5 from documents
union all select doc_id, 'chunk_002_2_Beta__x_y.md', md5('2 Beta: x/y' || chr(10) || 'w1 ' || sha1(text) || chr(10)) from documents
"""


def copied_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images that parts refer to, by path or by name only, copied beside each part's chunks and read back; twice named is copied once."""
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part").select(k.alias("doc_id"), F.col("p_name").alias("name"))
    listing = part.select("doc_id", F.format_string("images/deep/i%d.jpg", F.col("doc_id")).alias("path"), F.concat("name", F.lit("!")).cast("binary").alias("content"))
    id_ = F.col("doc_id")
    refs = part.select("doc_id", F.explode(F.array(F.when(id_ % 2 == 0, F.format_string("images/deep/i%d.jpg", id_)).otherwise(F.format_string("./i%d.jpg", id_)), F.when(id_ % 3 == 0, F.format_string("images\\deep\\i%d.jpg", id_)), F.format_string("none%d.png", id_))).alias("ref")).where("ref is not null")
    path = runtime.scratch_path(spark, "images")
    sinks.copied_images(refs, listing, path)
    parts = F.split("path", "/")
    return datasource.read_files(spark, path).select(F.element_at(parts, -3).cast("long").alias("doc_id"), F.element_at(parts, -1).alias("file_name"), F.length("content").alias("size"), F.md5("content").alias("md5"))


IMAGES_SQL = "select p_partkey as doc_id, 'i' || p_partkey || '.jpg' as file_name, cast(length(p_name) + 1 as integer) as size, md5(p_name || '!') as md5 from part"


def workbook_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as workbooks of 500, two sheets each, written as files and read back sheet by sheet."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.expr("c_custkey div 500").alias("book"))
    path = runtime.scratch_path(spark, "books")
    made = rows.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))).alias("rows"))  # at most 500 rows
    books = made.select(F.format_string("b%05d.xlsx", "book").alias("path"), files.workbook_bytes(F.transform("rows", lambda r: F.struct(F.when(r["c_custkey"] % 2 == 0, "even").otherwise("odd").alias("sheet"), F.array(r["c_custkey"].cast("string"), F.lit(None).cast("string"), r["c_name"]).alias("cells")))).alias("content"))
    datasource.write_files(books, path)
    cells = datasource.read_workbooks(spark, path)
    return cells.select("file", "sheet", F.col("cells")[0].cast("long").alias("key"), F.col("cells")[2].alias("name"), F.size("cells").alias("width"), "row_no")


CELLS_SQL = """
select printf('b%05d.xlsx', c_custkey // 500) as file, case when c_custkey % 2 = 0 then 'even' else 'odd' end as sheet, c_custkey as key, trim(c_name) as name, 3 as width,
  cast(row_number() over (partition by c_custkey // 500, c_custkey % 2 order by c_custkey) as integer) as row_no from customer
"""


def delimited_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The preview of orders as delimited text: how many rows and columns it shows, and how many rows there are."""
    path = runtime.scratch_path(spark, "csv")
    table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.concat(F.lit("a,\""), F.col("o_orderkey").cast("string")).alias("quoted")).write.option("header", "true").csv(path)
    shown, total = files.delimited_preview(spark, path, rows=1000, columns=2)
    return shown.agg(F.count("*").alias("shown"), F.count_if(F.col("o_orderkey").cast("long").isNotNull() & (F.length("o_orderstatus") == 1)).alias("good")).select("shown", "good", F.lit(len(shown.columns)).alias("columns"), F.lit(total).cast("long").alias("total"))


PREVIEW_SQL = "select least(1000, count(*)) as shown, least(1000, count(*)) as good, 2 as columns, count(*) as total from orders"


def queries() -> dict:
    return {f.__name__: f for f in (stored_upserts, task_stream, chunk_folders, copied_images, workbook_cells, delimited_previews)}


def oracle_sql() -> dict[str, str]:
    return {"stored_upserts": STORED_SQL, "task_stream": TASKS_SQL, "chunk_folders": FOLDERS_SQL, "copied_images": IMAGES_SQL, "workbook_cells": CELLS_SQL, "delimited_previews": PREVIEW_SQL}
