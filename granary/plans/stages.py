"""Queries over the pipeline's stages and the smaller ledger operations, on orders, parts, customers and suppliers."""

from __future__ import annotations

import io
import zipfile
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary import runtime
from granary.config import ChunkConfig
from granary.functions import text as X
from granary.operators import ledger as L
from granary.operators import profiles as PR
from granary.operators import segments as G
from granary.plans import pipeline as P
from granary.plans.documents import table
from granary.sources import files, sinks
from granary.streaming.progress import latest_progress

NOW = "2025-01-01 00:00:00"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as ledger rows at all stages of their way."""
    k = F.col("o_orderkey")
    text = lambda on, value: F.when(on, value).otherwise(F.lit(""))
    return table(spark, sf_dir, "orders").select(
        k.alias("seq"), F.concat(F.lit("doc_"), k.cast("string")).alias("stem"), F.concat(F.lit("doc_"), k.cast("string"), F.lit(".pdf")).alias("filename"), F.when(k % 3 == 0, "default").otherwise(F.concat(F.lit("t"), (k % 4).cast("string"))).alias("tenant_id"),
        text(k % 5 < 2, F.concat(F.lit("parsed/"), k.cast("string"))).alias("parse"), text(k % 7 < 3, F.concat(F.lit("chunks/doc_"), k.cast("string"))).alias("chunks"), text(k % 11 == 0, F.lit("r")).alias("remote_id"),
        F.when(k % 13 == 0, "error").otherwise("pending").alias("status"), F.when(k % 13 == 0, "boom").otherwise("").alias("error_msg"), F.lit("2024-01-01 00:00:00").alias("update_time"),
    )


_ROWS = """
r as (
  select o_orderkey as seq, 'doc_' || o_orderkey as stem, 'doc_' || o_orderkey || '.pdf' as filename, case when o_orderkey % 3 = 0 then 'default' else 't' || (o_orderkey % 4) end as tenant_id,
    o_orderkey % 5 < 2 as parsed, o_orderkey % 7 < 3 as chunked, o_orderkey % 11 = 0 as uploaded, case when o_orderkey % 13 = 0 then 'error' else 'pending' end as status, case when o_orderkey % 13 = 0 then 'boom' else '' end as error_msg from orders)
"""


def _pending(rows: DataFrame) -> DataFrame:
    return rows.where("seq % 4 <> 1").select("filename", (F.col("seq") % 30).cast("int").alias("pages"))


def _parsed(rows: DataFrame) -> DataFrame:
    return rows.select("stem", (F.col("seq") % 6 != 0).alias("found"), (F.col("seq") % 9 == 0).alias("trivial"))


def _routes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("default", None), ("t0", "d0"), ("t1", "d1"), ("t2", " ")], "tenant_id string, dataset_id string")


def parse_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the parse stage does with each row, and by which backend."""
    rows = _rows(spark, sf_dir)
    return P.parse_actions(rows, _pending(rows)).select("seq", "action", "backend")


PARSE_SQL = f"""
with {_ROWS}, a as (select seq, case when seq % 4 = 1 then 'NO_FILE' when parsed then 'SKIPPED_DONE' else 'PARSE' end as action from r)
select seq, action, case when action = 'PARSE' then case when seq % 30 >= 15 then 'vlm' else 'pipeline' end end as backend from a
"""


def chunk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the chunk stage does with each row, once as it is, once by force, once as a dry run."""
    rows = _rows(spark, sf_dir)
    run = lambda name, **how: P.chunk_actions(rows, _parsed(rows), **how).select("seq", F.lit(name).alias("run"), "action")
    return run("plain").unionByName(run("force", force=True)).unionByName(run("dry", dry_run=True))


CHUNK_SQL = f"""
with {_ROWS}, m as (select unnest(['plain', 'force', 'dry']) as run)
select seq, run, case when not parsed then 'NO_PARSED' when chunked and run <> 'force' then 'SKIPPED_DONE' when seq % 6 = 0 then 'CHUNK_FAILED' when run = 'dry' then 'DRY_RUN' when seq % 9 = 0 then 'CHUNK_FAILED' else 'CHUNKED' end as action from r, m
"""


def upload_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the upload stage does with each row: a named tenant without a dataset fails."""
    return P.upload_actions(_rows(spark, sf_dir), _routes(spark)).select("seq", "action")


_UPLOAD = "case when not chunked then 'NO_CHUNKS' when uploaded then 'SKIPPED_DONE' when tenant_id in ('t2', 't3') then 'NO_DATASET' else 'UPLOAD' end"
UPLOAD_SQL = f"with {_ROWS} select seq, {_UPLOAD} as action from r"


def stage_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger after errors are reset and the upload stage has run."""
    rows = P.after_stage(P.upload_actions(P.reset_errors(_rows(spark, sf_dir)), _routes(spark)), "upload", NOW)
    return rows.select("seq", "status", "error_msg", "update_time")


STAGE_LEDGER_SQL = f"""
with {_ROWS}, a as (select *, {_UPLOAD} as action from r)
select seq, case action when 'UPLOAD' then 'done' when 'NO_DATASET' then 'error' else 'pending' end as status, case when action = 'NO_DATASET' then action else '' end as error_msg,
  case when action in ('UPLOAD', 'NO_DATASET') then '{NOW}' else '2024-01-01 00:00:00' end as update_time from a
"""


def pipeline_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of a run of three stages and one that is off: actions by stage, the stages' states and the run's."""
    rows = _rows(spark, sf_dir)
    steps = [
        P.Step("scan", lambda d: d, enabled=False), P.Step("parse", lambda d: P.after_stage(P.parse_actions(d, _pending(rows)), "parse", NOW)),
        P.Step("chunk", lambda d: P.after_stage(P.chunk_actions(d, _parsed(rows)), "chunk", NOW)), P.Step("upload", lambda d: P.after_stage(P.upload_actions(d, _routes(spark)), "upload", NOW)),
    ]
    _, reports = P.run_steps(rows, steps)
    return P.report_rows(reports, spark).withColumn("run", F.lit(P.overall(reports)))


RUN_SQL = f"""
with {_ROWS},
a as (
  select 'parse' as stage, case when seq % 4 = 1 then 'NO_FILE' when parsed then 'SKIPPED_DONE' else 'PARSE' end as action from r
  union all select 'chunk', case when not parsed then 'NO_PARSED' when chunked then 'SKIPPED_DONE' when seq % 6 = 0 or seq % 9 = 0 then 'CHUNK_FAILED' else 'CHUNKED' end from r
  union all select 'upload', {_UPLOAD} from r)
select stage, 'partial' as status, action, count(*) as n, 'partial' as run from a group by stage, action union all select 'scan', 'skipped', null, null, 'partial'
"""


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles over a base: known keys that have a value, what an update sends, the active profile, settings within their bounds, the strategy by its name."""
    s = F.col("s_suppkey")
    base = F.create_map(F.lit("size"), F.lit("800"), F.lit("mode"), F.lit("fixed"))
    own = F.create_map(F.lit("mode"), F.when(s % 3 != 0, F.concat(F.lit("m"), s.cast("string"))), F.lit("junk"), F.lit("x"))
    sent = P.partial_update(F.create_map(F.lit("answer"), F.when(s % 2 == 0, F.lit("")), F.lit("content"), F.lit("c")))
    active = F.when(s % 4 == 0, F.create_map(F.lit("upload"), F.lit("new"))).otherwise(F.create_map(F.lit("crawl"), F.lit("other")))
    flat = lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";")
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", flat(P.merged_profile(base, own, ["size", "mode"])).alias("profile"), flat(sent).alias("sent"), X.active_profile(active, F.lit("upload"), F.lit("old")).alias("active"), X.clamp(F.concat(s.cast("string"), F.when(s % 5 == 0, "x").otherwise("")), 1, 60, 20).alias("pages"),
        P.canonical_status(F.element_at(F.array(*map(F.lit, ("Parsing_Done", " completed ", "failed", "chunking", "other"))), (s % 5 + 1).cast("int"))).alias("status"),
    )


PROFILES_SQL = """
select s_suppkey, case when s_suppkey % 3 <> 0 then 'mode=m' || s_suppkey else 'mode=fixed' end || ';size=800' as profile, case when s_suppkey % 2 = 0 then 'answer=;' else '' end || 'content=c' as sent, case when s_suppkey % 4 = 0 then 'new' else 'old' end as active,
  cast(case when s_suppkey % 5 = 0 then 20 else greatest(1, least(60, s_suppkey)) end as integer) as pages, [ 'parsed', 'done', 'error', 'chunking', null ][s_suppkey % 5 + 1] as status from supplier
"""


_FIELDS = [PR.Field("mode", "auto"), PR.Field("dataset", "", ("upload",)), PR.Field("depth", "2", ("crawl",))]


def profile_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as profiles of two types: created, updated, one activated, some deleted; with what is active then."""
    k, s = F.col("s_suppkey"), table(spark, sf_dir, "supplier")
    name = F.when(k % 4 == 0, " ").otherwise(F.concat(F.lit(" p"), k.cast("string")))
    kind = F.when(k % 5 == 0, "none").when(k % 2 == 0, "upload").otherwise("crawl")
    wanted = s.select(k.cast("string").alias("profile_id"), name.alias("name"), kind.alias("type"), F.create_map(F.lit("dataset"), F.lit("d"), F.lit("junk"), F.lit("x"), F.lit("depth"), k.cast("string")).alias("config"), k.alias("ord"))
    none = wanted.limit(0).withColumn("update_time", F.lit(NOW))
    rows, active, denied = PR.created(none, none.select("type", "profile_id"), wanted, _FIELDS, ["upload", "crawl"], "then")
    changes = rows.where("ord % 3 = 0").select("profile_id", F.when(F.col("ord") % 6 == 0, "new").alias("name"), F.create_map(F.lit("mode"), F.lit("fast")).alias("config"))
    rows = PR.updated(rows, changes, _FIELDS, "now")
    active = PR.activated(rows, active, wanted.where("ord = 7").select("profile_id", "ord"))
    rows, active = PR.deleted(rows, active, wanted.where("ord % 7 <= 2").select("profile_id"))
    flat = F.array_join(F.array_sort(F.transform(F.map_entries("config"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";")
    out = rows.join(active.select("profile_id", F.lit(True).alias("is_active")), "profile_id", "left").select("profile_id", "name", "type", flat.alias("config"), "update_time", F.coalesce("is_active", F.lit(False)).alias("is_active"))
    return out.unionByName(denied.select("profile_id", F.lit(None).cast("string").alias("name"), F.col("denied").alias("type"), F.lit(None).cast("string").alias("config"), F.lit(None).cast("string").alias("update_time"), F.lit(False).alias("is_active")))


STORE_SQL = """
with w as (select s_suppkey as k, case when s_suppkey % 4 = 0 then 'profile then' else 'p' || s_suppkey end as name, case when s_suppkey % 5 = 0 then 'none' when s_suppkey % 2 = 0 then 'upload' else 'crawl' end as type from supplier),
r as (select *, case when k % 6 = 0 then 'new' else name end as new_name, 'dataset=' || case when type = 'upload' then 'd' else '' end || ';depth=' || case when type = 'crawl' then cast(k as varchar) else '2' end || ';mode=' || case when k % 3 = 0 then 'fast' else 'auto' end as config from w where type <> 'none'),
l as (select * from r where k % 7 > 2)
select cast(k as varchar) as profile_id, new_name as name, type, config, case when k % 3 = 0 then 'now' else 'then' end as update_time, k = min(k) over (partition by type) as is_active from l
union all select cast(k as varchar), null, 'unknown type', null, null, false from w where type = 'none'
"""


def run_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of each customer's runs: changes checked by name, bound and kind, then one run's override, which leaves the settings as they are."""
    k = F.col("c_custkey")
    pick = lambda *values: F.element_at(F.array(*(F.lit(v) if isinstance(v, str) else v for v in values)), (k % len(values) + 1).cast("int"))
    changes = F.create_map(F.lit("fixed_size"), pick("20", "900", "much"), F.lit("strategy"), pick("fixed", "magic"), F.lit("colour"), F.lit("red"), F.lit("semantic_threshold"), pick("0.5", "x", "0.25", "1"))
    checked = PR.validated(changes)
    override = F.create_map(F.lit("fixed_size"), k.cast("string"), F.lit("other"), F.lit("y"), F.lit("overlap"), F.lit(None).cast("string"))
    rows = runtime.spread(table(spark, sf_dir, "customer").select("c_custkey")).select("c_custkey", checked.alias("c")).withColumn("run", PR.scoped(F.col("c.settings"), override))
    names = ("fixed_size", "strategy", "semantic_threshold", "overlap")
    return rows.select("c_custkey", *(F.col("c.settings")[n].alias(n) for n in names), F.array_join("c.denied", ",").alias("denied"), F.col("run")["fixed_size"].alias("run_size"), F.col("run")["overlap"].alias("run_overlap"), F.size("run").alias("n"))


SETTINGS_SQL = f"""
select c_custkey, case c_custkey % 3 when 0 then '50' when 1 then '900' else '800' end as fixed_size, case when c_custkey % 2 = 0 then 'fixed' else 'structure' end as strategy,
  case c_custkey % 4 when 0 then '0.5' when 1 then '0.78' when 2 then '0.25' else '1.0' end as semantic_threshold, '100' as overlap,
  'colour' || case when c_custkey % 3 = 2 then ',fixed_size' else '' end || case when c_custkey % 4 = 1 then ',semantic_threshold' else '' end || case when c_custkey % 2 = 1 then ',strategy' else '' end as denied,
  cast(c_custkey as varchar) as run_size, '100' as run_overlap, {len(fields(ChunkConfig))} as n from customer
"""


def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs by customer and status appended to a log twice, read back with the times at which they were written."""
    path = runtime.scratch_path(spark, "runs")
    runs = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.count("*").alias("n"))
    for half in (0, 1):
        P.append_runs(runs.where(F.col("o_custkey") % 2 == half).withColumn("created_at", X.now_text()), path)
    read = spark.read.parquet(path)
    fresh = F.col("created_at").rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$") & (F.unix_timestamp() - F.unix_timestamp("created_at") < 3600)
    return read.select("o_custkey", "open", "n", fresh.alias("fresh"))


HISTORY_SQL = "select o_custkey, count(*) filter (where o_orderstatus = 'O') as open, count(*) as n, true as fresh from orders group by o_custkey"


def image_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where images are found: in the object store, on the public host, uploaded, else by their relative path."""
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part").select(k, F.format_string("images/i%d.jpg", k).alias("path"))
    of = lambda name, n: part.where(k % n == 0).select("path", F.when(k % (n * 4) == 0, "").otherwise(F.concat(F.lit(f"{name}/"), k.cast("string"))).alias(name))
    joined = part.join(of("stored", 2), "path", "left").join(of("public", 3), "path", "left").join(of("uploaded", 5), "path", "left")
    return joined.select("p_partkey", G.image_address(F.col("stored"), F.col("public"), F.col("uploaded"), F.col("path")).alias("address"))


ADDRESS_SQL = """
select p_partkey, case when p_partkey % 2 = 0 and p_partkey % 8 <> 0 then 'stored/' || p_partkey when p_partkey % 3 = 0 and p_partkey % 12 <> 0 then 'public/' || p_partkey
  when p_partkey % 5 = 0 and p_partkey % 20 <> 0 then 'uploaded/' || p_partkey else 'images/i' || p_partkey || '.jpg' end as address from part
"""


def tenant_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tenants that are added, changed, given a new key, removed; each with what became of its wish."""
    k = F.col("s_suppkey")
    base = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.concat(F.lit("t"), k.cast("string")).alias("tenant_id"), F.col("s_name").alias("name"), F.lit("d").alias("dataset_id"), F.sha2(F.concat(F.lit("k"), k.cast("string")), 256).alias("api_key_hash"), F.lit("active").alias("status"), F.lit("then").alias("create_time"), F.lit("then").alias("update_time"))
    wanted = table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select(F.when(k % 15 == 0, "_bad").when(k % 9 == 0, "DEFAULT").otherwise(F.concat(F.lit(" T"), k.cast("string"))).alias("tenant_id"), F.lit("new").alias("name"), F.when(k % 21 == 0, " ").otherwise(" d2 ").alias("dataset_id"), F.lit("secret").alias("api_key"))
    made = L.created_tenants(base, wanted, NOW)
    rows = base.unionByName(made.where("denied is null").drop("denied"))
    changes = base.where("tenant_id like '%0'").select("tenant_id", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("dataset_id"), F.lit("off").alias("status"), F.lit("fresh").alias("api_key"))
    kept = L.removed_tenants(L.updated_tenants(rows, changes, NOW), base.where("tenant_id like '%2'").select("tenant_id"))
    return kept.select("tenant_id", "name", "dataset_id", F.substring("api_key_hash", 1, 8).alias("key"), "status", "create_time", "update_time", F.lit(None).cast("string").alias("denied")).unionByName(made.where("denied is not null").groupBy("denied").agg(F.count("*").alias("n")).select(F.lit("").alias("tenant_id"), F.col("n").cast("string").alias("name"), *(F.lit(None).cast("string").alias(c) for c in ("dataset_id", "key", "status", "create_time", "update_time")), "denied"))


TENANTS_SQL = f"""
with w as (select s_suppkey as k, case when s_suppkey % 15 = 0 then 'malformed' when s_suppkey % 9 = 0 then 'built in' when s_suppkey % 21 = 0 then 'no dataset' when s_suppkey % 2 = 0 then 'exists' end as denied from supplier where s_suppkey % 3 = 0),
b as (select 't' || s_suppkey as tenant_id, s_name as name, s_suppkey as k from supplier where s_suppkey % 2 = 0 and s_suppkey % 10 <> 2)
select tenant_id, name, 'd' as dataset_id, left(case when k % 10 = 0 then sha256('fresh') else sha256('k' || k) end, 8) as key, case when k % 10 = 0 then 'off' else 'active' end as status, 'then' as create_time, case when k % 10 = 0 then '{NOW}' else 'then' end as update_time, null as denied from b
union all select 't' || k, 'new', 'd2', left(sha256('secret'), 8), 'active', '{NOW}', '{NOW}', null from w where denied is null
union all select '', cast(count(*) as varchar), null, null, null, null, null, denied from w where denied is not null group by denied
"""


def reused_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents made anew or taken again by name, with how many segments they keep."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k, F.concat(F.lit("n"), (k % 700).cast("string")).alias("name"))
    documents = rows.where("c_custkey % 3 = 0").select(k.cast("string").alias("document_id"), "name", F.when(k % 2 == 0, "completed").otherwise("waiting").alias("indexing_status"), k.alias("ord"))
    found = L.reused_documents(rows.select("name").distinct(), documents)
    segments = documents.select("document_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("n"))
    left = L.cleared_segments(segments, found).groupBy("document_id").agg(F.count("*").alias("segments"))
    return found.join(left, "document_id", "left").select("name", "action", "clear", "document_id", F.coalesce("segments", F.lit(0)).alias("segments"))


REUSED_SQL = """
with d as (select c_custkey % 700 as n, min(c_custkey) as k from customer where c_custkey % 3 = 0 group by 1)
select 'n' || c.n as name, case when d.k is null then 'CREATE' else 'REUSE' end as action, coalesce(d.k % 2 = 0, false) as clear, cast(d.k as varchar) as document_id, cast(case when d.k is null or d.k % 2 = 0 then 0 else 3 end as bigint) as segments
from (select distinct c_custkey % 700 as n from customer) c left join d on d.n = c.n
"""


def staged_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk folders copied before an upload, and what is deleted and kept after it."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(F.lit("default").alias("tenant_id"), F.concat(F.lit("s"), k.cast("string")).alias("stem"), F.when(k % 5 == 0, "output").otherwise("chunks").alias("root"), "p_partkey")
    staged = L.staged_output(rows.drop("p_partkey"), rows.where("p_partkey % 7 = 0").select("tenant_id", "stem"))
    results = rows.where("p_partkey % 11 <> 0").select("tenant_id", "stem", (k % 3 != 0).alias("ok"))
    return L.cleaned_output(staged, results).select("stem", "copied", "chunks", "deleted")


STAGED_SQL = """
with p as (select p_partkey as k, 's' || p_partkey as stem, case when p_partkey % 5 = 0 then 'output' else 'chunks' end as root, p_partkey % 5 <> 0 and p_partkey % 7 <> 0 as copied, p_partkey % 11 <> 0 and p_partkey % 3 <> 0 as ok from part)
select stem, copied, case when copied and ok then 'output' else root end || '/' || stem as chunks, case when copied and ok then root || '/' || stem when copied then 'output/' || stem end as deleted from p
"""


def crawl_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmed items of a crawl by profile and dataset, or why they stay out."""
    k = F.col("page_id")
    items = table(spark, sf_dir, "pages").select("url", (k % 13 != 0).alias("ok"), (k % 11 != 0).alias("confirmed"), F.when(k % 7 != 0, "s").alias("stem"), F.when(k % 5 == 0, "ok").alias("ingest_status"), F.concat(F.lit("p"), (k % 3).cast("string")).alias("profile_id"), F.when(k % 17 != 0, F.concat(F.lit("d"), (k % 2).cast("string"))).alias("dataset_id"))
    return L.crawl_groups(items)


GROUPS_SQL = """
with i as (select url, 'p' || (page_id % 3) as profile_id, case when page_id % 17 <> 0 then 'd' || (page_id % 2) end as dataset_id,
  case when page_id % 13 = 0 then 'not fetched' when page_id % 11 = 0 or page_id % 7 = 0 then 'not confirmed' when page_id % 5 = 0 then 'already in' when page_id % 17 = 0 then 'no target' end as denied from pages)
select url, profile_id, dataset_id, case when denied is null then count(*) filter (denied is null) over (partition by profile_id, dataset_id) end as group_size, denied from i
"""


def env_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of settings: keys, exported keys, comments and others."""
    k, name = F.col("n_nationkey"), F.col("n_name")
    line = F.when(k % 5 == 0, F.concat(F.lit("# "), name, F.lit("=1"))).when(k % 5 == 1, F.concat(F.lit(" export "), name, F.lit(" = a b"))).when(k % 5 == 2, F.lit("  ")).when(k % 5 == 3, F.concat(F.lit("9"), name, F.lit("=1"))).otherwise(F.concat(name, F.lit("=x#y")))
    return table(spark, sf_dir, "nation").select("n_nationkey", X.env_entry(line).alias("e")).select("n_nationkey", "e.key", "e.exported")


ENV_SQL = "select n_nationkey, case when n_nationkey % 5 in (1, 4) then n_name end as key, case n_nationkey % 5 when 1 then true when 4 then false end as exported from nation"


def unpacked_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parser's answers as archives and as JSON: files under the names that later stages look for, of the kinds they have, and images."""
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for name in ("top/", "top/full.md", "top/layout.json", "top/x_content_list.json", "top/x_model.json", "top/images/a.jpg", "notes.txt"):
            z.writestr(zipfile.ZipInfo(name), b"" if name.endswith("/") else name.encode())
    k = F.col("n_nationkey")
    data = F.when(k % 4 == 0, F.lit(b"broken")).otherwise(F.lit(held.getvalue()))
    entries = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.explode_outer(files.unzipped(data)).alias("f"))
    zipped = entries.select("n_nationkey", files.canonical_name(F.col("f.path"), F.col("n_name")).alias("path"), F.length("f.data").cast("long").alias("bytes"))
    answer = F.to_json(F.struct(F.lit("# m").alias("md_content"), F.create_map(F.lit("i/1.png"), F.concat(F.lit("data:image/png;base64,"), F.base64(F.encode("n_name", "utf-8")))).alias("images")))
    answers = table(spark, sf_dir, "nation").select(k.alias("doc_id"), files.parser_result(answer).alias("result"))
    images = files.result_images(answers).select(F.col("doc_id").alias("n_nationkey"), "path", F.length("data").cast("long").alias("bytes"))
    return zipped.unionByName(images).withColumn("kind", files.output_kind(F.col("path")))


UNPACKED_SQL = """
with f as (select unnest([['.md', '11', 'markdown', '1'], ['_middle.json', '15', 'json', '1'], ['_content_list_v2.json', '23', 'blocks_v2', '1'], ['_model.json', '16', 'json', '1'], ['images/a.jpg', '16', 'image', '0'], ['notes.txt', '9', 'other', '0']]) as f)
select n_nationkey, case when f[4] = '1' then n_name else '' end || f[1] as path, cast(f[2] as bigint) as bytes, f[3] as kind from nation, f where n_nationkey % 4 <> 0
union all select n_nationkey, null, null, 'other' from nation where n_nationkey % 4 = 0
union all select n_nationkey, 'i/1.png', length(n_name), 'image' from nation
"""


def task_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is seen of the users' progress at noon of a day: the latest state of those heard of within two hours."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), "ts", F.concat_ws(":", F.col("event_type"), F.col("event_id").cast("string")).alias("state"))
    return latest_progress(rows, F.lit("2024-01-15 12:00:00").cast("timestamp_ntz"), expiry="2 hours")


PROGRESS_SQL = """
select user_id as task_id, arg_max(event_type || ':' || event_id, ts) as state, max(ts) as last_seen, count(*) as updates from events where ts <= timestamp '2024-01-15 12:00:00' group by 1 having max(ts) >= timestamp '2024-01-15 10:00:00'
"""

# --- smaller ledger operations ---------------------------------------------------------------------


def record_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawl records with the state that the ledger gives them."""
    rows = _rows(spark, sf_dir)
    records = rows.select("seq", "stem", F.lit("found").alias("status"))
    manifest = rows.where("seq % 2 = 0").select("stem", "status", "remote_id", "parse")
    return L.record_status(records, manifest).select("seq", "status")


RECORDS_SQL = f"with {_ROWS} select seq, case when seq % 2 = 1 then 'found' when status = 'error' then 'error' when uploaded then 'ingested' when parsed then 'parsed' else 'landed' end as status from r"


def ledger_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file's row: that of the default tenant first, or that of the tenant asked for; and how many rows each tenant sees."""
    base = _rows(spark, sf_dir).withColumn("filename", F.concat(F.lit("f"), (F.col("seq") % 50).cast("string"))).withColumn("seq", F.col("seq") % 50)
    base = base.groupBy("tenant_id", "filename").agg(F.min("seq").alias("seq"))
    one = lambda tenant: L.fetch(base, "f7", tenant).select("tenant_id", "filename", F.lit(tenant or "any").alias("asked"), F.lit(1).cast("long").alias("n"))
    seen = lambda tenant: L.visible_rows(base, tenant).groupBy().agg(F.count("*").alias("n")).select(F.lit(tenant).alias("tenant_id"), F.lit("").alias("filename"), F.lit("seen").alias("asked"), "n")
    return one(None).unionByName(one("t1")).unionByName(seen("default")).unionByName(seen("t1"))


LOOKUP_SQL = f"""
with {_ROWS}, b as (select distinct tenant_id, 'f' || (seq % 50) as filename from r),
a as (select *, 'any' as asked, 1 as n from b where filename = 'f7' order by tenant_id = 'default' desc, tenant_id limit 1)
select * from a union all select *, 't1', 1 from b where filename = 'f7' and tenant_id = 't1' union all select 'default', '', 'seen', count(*) from b union all select 't1', '', 'seen', count(*) from b where tenant_id = 't1'
"""


def listed_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders of two listings, each path once, of the stems that are wanted."""
    rows = _rows(spark, sf_dir)
    chunks = rows.where("seq % 2 = 0").select("stem", F.concat(F.lit("out/"), "stem").alias("path"))
    output = rows.where("seq % 3 = 0").select("stem", F.concat(F.lit("out/"), "stem").alias("path"))
    return L.listed_directories(chunks, output, rows.where("seq % 5 <> 0").select("stem"))


FOLDERS_SQL = f"with {_ROWS} select stem, 'out/' || stem as path from r where (seq % 2 = 0 or seq % 3 = 0) and seq % 5 <> 0"


def missing_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images that documents refer to and no file has, by path or by name; and those that a store has not yet."""
    k = F.col("doc_id")
    chunks = table(spark, sf_dir, "documents").select("doc_id", F.transform(F.sequence(F.lit(0), (k % 6).cast("int")), lambda i: F.concat(F.lit("img/"), i.cast("string"), F.lit(".png"))).alias("image_refs"))
    refs = chunks.select("doc_id", F.explode("image_refs").alias("path"))
    n = F.regexp_extract("path", r"(\d+)", 1).cast("int")
    images = refs.where(n % 3 == 0).unionByName(refs.where(n % 3 == 1).select("doc_id", F.regexp_replace("path", "^img/", "other/").alias("path")))
    gone = G.missing_images(chunks, images).withColumn("what", F.lit("missing"))
    new = sinks.new_objects(images.select("doc_id", "path", F.concat_ws("/", F.col("doc_id").cast("string"), "path").alias("key")), images.where(n % 2 == 0).select(F.concat_ws("/", F.col("doc_id").cast("string"), "path").alias("key"))).select("doc_id", "path", F.lit("new").alias("what"))
    return gone.unionByName(new)


IMAGES_SQL = """
with r as (select doc_id, unnest(range(doc_id % 6 + 1)) as n from documents)
select doc_id, 'img/' || n || '.png' as path, 'missing' as what from r where n % 3 = 2
union all select doc_id, case when n % 3 = 0 then 'img/' else 'other/' end || n || '.png', 'new' from r where n % 3 < 2 and n % 2 = 1
"""


def zipped_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with the segments made of them, by their places; and those that did not last."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), F.length("text").alias("chars"))
    created = turns.where("ord % 4 <> 3").select("doc_id", "ord", F.concat_ws("-", F.col("doc_id").cast("string"), F.col("ord").cast("string")).alias("segment_id"))
    lost = L.not_persisted(created, created.where("ord % 2 = 0").select("segment_id")).select("segment_id", F.lit(True).alias("lost"))
    return G.zipped(turns, created).join(lost, "segment_id", "left").select("doc_id", "ord", "chars", "segment_id", F.coalesce("lost", F.lit(False)).alias("lost"))


ZIPPED_SQL = """
select conv_id as doc_id, turn as ord, cast(length(text) as integer) as chars, case when turn % 4 <> 3 then conv_id || '-' || turn end as segment_id, turn % 4 <> 3 and turn % 2 = 1 as lost from conversations
"""


def required_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that are required and not there yet; reference lists united in their order."""
    there = table(spark, sf_dir, "nation").where("n_nationkey % 3 = 0").select(F.col("n_name").alias("segment_id"))
    wanted = table(spark, sf_dir, "nation").select(F.col("n_name").alias("segment_id"), "n_nationkey")
    both = F.array_distinct(F.concat(F.array(F.lit("a"), F.col("segment_id"), F.lit("a")), F.array(F.lit("b"), F.col("segment_id"))))
    return L.not_persisted(wanted, there).select("n_nationkey", F.col("segment_id").alias("field"), F.array_join(both, ",").alias("refs"))


FIELDS_SQL = "select n_nationkey, n_name as field, 'a,' || n_name || ',b' as refs from nation where n_nationkey % 3 <> 0"


def metadata_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of documents from the ledger and from rows of their own, as operations."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k, F.col("c_mktsegment").alias("department"), F.concat(F.lit("c"), k.cast("string"), F.lit(".pdf")).alias("filename"), F.concat(F.lit("out/x"), k.cast("string")).alias("chunks"))
    manifest = rows.where("c_custkey % 7 <> 0").select("filename", "chunks", "department", F.when(k % 5 == 0, " ").otherwise("2024").alias("year"))
    own = rows.where("c_custkey % 4 = 0").select("filename", F.lit("").alias("department"), F.lit("2025").alias("year"))
    documents = rows.select(k.alias("document_id"), F.when(k % 2 == 0, F.concat(F.lit("c"), k.cast("string"))).otherwise(F.concat(F.lit("x"), k.cast("string"))).alias("name"))
    fields = spark.createDataFrame([("department", "f1"), ("year", "f2")], "name string, field_id string")
    ops = L.metadata_sync(documents, manifest, own, fields, ["department", "year"])
    return ops.select("document_id", F.array_join(F.transform("operations", lambda o: F.concat_ws("=", o["id"], o["value"])), ";").alias("operations"), (F.col("batch_no") >= 0).alias("batched"))


SYNC_SQL = """
select c_custkey as document_id, 'f1=' || c_mktsegment || case when c_custkey % 4 = 0 then ';f2=2025' when c_custkey % 5 = 0 then '' else ';f2=2024' end as operations, true as batched from customer where c_custkey % 7 <> 0
"""


def metadata_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for orders, with the number of each document's batch of 50."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k, F.col("o_orderpriority").alias("priority"), F.concat(F.lit("o"), k.cast("string"), F.lit(".pdf")).alias("filename"), F.concat(F.lit("out/x"), k.cast("string")).alias("chunks"))
    manifest = rows.where("o_orderkey % 7 <> 0").select("filename", "chunks", "priority")
    own = rows.where("o_orderkey % 4 = 0").select("filename", F.lit("own").alias("priority"))
    documents = rows.select(k.alias("document_id"), F.concat(F.when(k % 2 == 0, "o").otherwise("x"), k.cast("string")).alias("name"))
    ops = L.metadata_sync(documents, manifest, own, spark.createDataFrame([("priority", "f1")], "name string, field_id string"), ["priority"])
    return ops.select("document_id", F.element_at("operations", 1)["value"].alias("value"), "batch_no")


BATCHES_SQL = """
select o_orderkey as document_id, case when o_orderkey % 4 = 0 then 'own' else o_orderpriority end as value, cast((row_number() over (order by o_orderkey) - 1) // 50 as integer) as batch_no from orders where o_orderkey % 7 <> 0
"""


def pending_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger names to files of the same tenant: exact, else by the rank of extensions."""
    k = F.col("p_partkey")
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("t"), (k % 2).cast("string")).alias("tenant_id"), k.cast("string").alias("k"), "p_partkey")
    made = lambda rows, ext: rows.select("tenant_id", F.concat("k", F.lit(ext)).alias("name"))
    stored = made(parts.where("p_partkey % 4 = 0"), ".pdf").unionByName(made(parts.where("p_partkey % 3 = 0"), ".MD")).unionByName(made(parts.where("p_partkey % 2 = 0"), ".docx")).unionByName(made(parts.withColumn("tenant_id", F.lit("t9")), ".pdf"))
    return L.by_extension(made(parts, ".pdf"), stored, [".pdf", ".docx", ".md"], within=("tenant_id",))


PENDING_SQL = """
select 't' || (p_partkey % 2) as tenant_id, p_partkey || '.pdf' as wanted, p_partkey || case when p_partkey % 4 = 0 then '.pdf' when p_partkey % 2 = 0 then '.docx' else '.MD' end as file from part where p_partkey % 4 = 0 or p_partkey % 3 = 0 or p_partkey % 2 = 0
"""


def input_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with their hash and state in the ledger."""
    rows = _rows(spark, sf_dir)
    return L.listing(rows.select(F.col("filename").alias("name")), rows.where("seq % 2 = 0").select("filename", F.md5(F.col("stem").cast("binary")).alias("md5"), "status"))


LISTING_SQL = f"with {_ROWS} select filename as name, case when seq % 2 = 0 then md5(stem) end as md5, case when seq % 2 = 0 then status end as status from r"


def missing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names without a file in staging, exact or by containment."""
    k = F.col("c_custkey")
    names = table(spark, sf_dir, "customer").select(F.concat(F.lit("file-"), F.lpad(k.cast("string"), 7, "0")).alias("name"), k)
    staged = names.where("c_custkey % 3 = 0").select("name").unionByName(names.where("c_custkey % 3 = 1").select(F.concat("name", F.lit(" (final)")).alias("name")))
    return L.missing_files(names.select("name"), staged)


MISSING_SQL = "select 'file-' || lpad(cast(c_custkey as varchar), 7, '0') as wanted from customer where c_custkey % 3 = 2"


def missing_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for orders as reports, whose names all begin alike, with a staged name that most of them hold."""
    k = F.col("o_orderkey")
    names = table(spark, sf_dir, "orders").select(F.concat(F.lit("Quarterly report "), F.lpad(k.cast("string"), 9, "0"), F.when(k % 5 == 0, "").otherwise(" of sales")).alias("name"), k)
    staged = names.where("o_orderkey % 3 = 0").select("name").unionByName(names.where("o_orderkey % 3 = 1").select(F.concat(F.lit("copy of "), F.lower("name"), F.lit(" (2)")).alias("name"))).unionByName(spark.createDataFrame([("OF_SALES",)], "name string"))
    return L.missing_files(names.select("name"), staged)


REPORTS_SQL = "select 'Quarterly report ' || lpad(cast(o_orderkey as varchar), 9, '0') as wanted from orders where o_orderkey % 3 = 2 and o_orderkey % 5 = 0"


def segment_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of segments by batch, and log lines of them."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("ord"), F.col("text").alias("content"), F.lit(None).cast("string").alias("answer"), F.array(F.col("role")).alias("keywords"), F.lit(None).cast("array<string>").alias("attachment_ids"))
    payload = G.prepare(turns, ChunkConfig(segment_batch=2))
    sent = sinks.segment_requests(payload).select("doc_id", "batch_no", F.json_array_length(F.get_json_object("request", "$.segments")).alias("segments"), F.get_json_object("request", "$.segments[0].keywords[0]").alias("role"))
    return sinks.log_lines(sent).select(*(F.get_json_object("line", f"$.{c}").alias(c) for c in ("level", "doc_id", "batch_no", "segments", "role")))


REQUESTS_SQL = """
with t as (select conv_id, role, row_number() over (partition by conv_id order by turn) - 1 as n from conversations)
select 'INFO' as level, cast(conv_id as varchar) as doc_id, cast(n // 2 as varchar) as batch_no, cast(count(*) as varchar) as segments, arg_min(role, n) as role from t group by conv_id, n // 2
"""


def queries() -> dict:
    found = (
        parse_plan, chunk_plan, upload_plan, stage_ledger, pipeline_run, profiles, tenant_changes, reused_documents, staged_output, crawl_groups, env_lines, unpacked_results, task_progress, profile_store, run_settings, run_history, image_addresses,
        record_states, ledger_lookup, listed_folders, missing_images, zipped_segments, required_fields, metadata_sync, metadata_batches, missing_reports, pending_files, input_listing, missing_files, segment_requests,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "parse_plan": PARSE_SQL, "chunk_plan": CHUNK_SQL, "upload_plan": UPLOAD_SQL, "stage_ledger": STAGE_LEDGER_SQL, "pipeline_run": RUN_SQL, "profiles": PROFILES_SQL, "tenant_changes": TENANTS_SQL, "reused_documents": REUSED_SQL, "staged_output": STAGED_SQL,
        "crawl_groups": GROUPS_SQL, "env_lines": ENV_SQL, "profile_store": STORE_SQL, "run_settings": SETTINGS_SQL, "run_history": HISTORY_SQL, "image_addresses": ADDRESS_SQL, "unpacked_results": UNPACKED_SQL, "task_progress": PROGRESS_SQL, "record_states": RECORDS_SQL, "ledger_lookup": LOOKUP_SQL, "listed_folders": FOLDERS_SQL, "missing_images": IMAGES_SQL,
        "zipped_segments": ZIPPED_SQL, "required_fields": FIELDS_SQL, "metadata_sync": SYNC_SQL, "metadata_batches": BATCHES_SQL, "missing_reports": REPORTS_SQL, "pending_files": PENDING_SQL, "input_listing": LISTING_SQL, "missing_files": MISSING_SQL, "segment_requests": REQUESTS_SQL,
    }
