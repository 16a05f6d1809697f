"""The ingestion pipeline as action columns: what each stage does with each ledger row, and the roll-up of a run."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from granary import runtime
from granary.functions import text as X

#: What the stages do with a row.
ACTIONS = ("NO_FILE", "SKIPPED_DONE", "DRY_RUN", "PARSE", "NO_PARSED", "CHUNK_FAILED", "CHUNKED", "NO_CHUNKS", "NO_DATASET", "UPLOAD")

# Canonical states, and what older rows call them.
STATUS = ["pending", "staged", "parsing", "parsed", "chunking", "chunked", "uploading", "done", "error", "missing"]
ALIASES = {"parsing_done": "parsed", "chunk_done": "chunked", "completed": "done", "failed": "error"}


def canonical_status(c: Column) -> Column:
    low = F.lower(F.btrim(c))
    pairs = [F.lit(x) for kv in ALIASES.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), low), F.when(low.isin(STATUS), low))


def filled(c: Column) -> Column:
    return F.length(F.btrim(F.coalesce(c, F.lit("")))) > 0


def _fresh(ledger: DataFrame) -> DataFrame:
    """Rows without what an earlier stage said of them."""
    return ledger.drop("action", "backend", "pages", "dataset_id", "found", "trivial")


def parse_actions(ledger: DataFrame, pending: DataFrame, dry_run: bool = False, force: bool = False) -> DataFrame:
    """NO_FILE, SKIPPED_DONE, DRY_RUN or PARSE for each ledger row; pages decide the backend."""
    p = pending.select("filename", F.col("pages").alias("pages"), F.lit(True).alias("there"))
    action = F.when(F.col("there").isNull(), "NO_FILE").when(filled(F.col("parse")) & F.lit(not force), "SKIPPED_DONE").when(F.lit(dry_run), "DRY_RUN").otherwise("PARSE")
    return _fresh(ledger).join(p, "filename", "left").withColumn("action", action).withColumn("backend", F.when(F.col("action") == "PARSE", F.when(F.coalesce(F.col("pages"), F.lit(0)) >= 15, "vlm").otherwise("pipeline"))).drop("there")


def chunk_actions(ledger: DataFrame, parsed: DataFrame, dry_run: bool = False, force: bool = False) -> DataFrame:
    """NO_PARSED, SKIPPED_DONE, CHUNK_FAILED, DRY_RUN or CHUNKED, the first that holds. ``parsed(stem, found, trivial)``."""
    action = (
        F.when(~filled(F.col("parse")), "NO_PARSED").when(filled(F.col("chunks")) & F.lit(not force), "SKIPPED_DONE").when(~F.coalesce(F.col("found"), F.lit(False)), "CHUNK_FAILED")
        .when(F.lit(dry_run), "DRY_RUN").when(F.coalesce(F.col("trivial"), F.lit(False)), "CHUNK_FAILED").otherwise("CHUNKED")
    )
    return _fresh(ledger).join(parsed, "stem", "left").withColumn("action", action)


def upload_actions(ledger: DataFrame, routes: DataFrame, force: bool = False) -> DataFrame:
    """NO_CHUNKS, SKIPPED_DONE, NO_DATASET or UPLOAD. A named tenant without a dataset fails; the default has one. ``routes(tenant_id, dataset_id)``."""
    joined = _fresh(ledger).join(routes.select("tenant_id", "dataset_id"), "tenant_id", "left")
    action = F.when(~filled(F.col("chunks")), "NO_CHUNKS").when(filled(F.col("remote_id")) & F.lit(not force), "SKIPPED_DONE").when((F.col("tenant_id") != "default") & ~filled(F.col("dataset_id")), "NO_DATASET").otherwise("UPLOAD")
    return joined.withColumn("action", action)


def after_stage(rows: DataFrame, stage: str, now: str) -> DataFrame:
    """Ledger rows after a stage: state, what was made, the error, the time."""
    done = {"parse": ("PARSE", "parsed", "parse"), "chunk": ("CHUNKED", "chunked", "chunks"), "upload": ("UPLOAD", "done", "remote_id")}[stage]
    failed = F.col("action").isin("CHUNK_FAILED", "NO_DATASET", "NO_FILE")
    ok = F.col("action") == done[0]
    return rows.withColumn("status", F.when(ok, done[1]).when(failed, "error").otherwise(F.col("status"))).withColumn("error_msg", F.when(failed, F.col("action")).when(ok, F.lit("")).otherwise(F.col("error_msg"))).withColumn("update_time", F.when(ok | failed, now).otherwise(F.col("update_time")))


def reset_errors(ledger: DataFrame) -> DataFrame:
    bad = F.col("status") == "error"
    return ledger.withColumn("error_msg", F.when(bad, "").otherwise(F.col("error_msg"))).withColumn("status", F.when(bad, "pending").otherwise(F.col("status")))


@dataclass(frozen=True)
class Step:
    name: str
    run: Callable[[DataFrame], DataFrame]
    enabled: bool = True


def run_steps(ledger: DataFrame, steps: list[Step], stop_on_error: bool = False) -> tuple[DataFrame, list[dict]]:
    """Apply the enabled steps in order. Each report counts actions; with ``stop_on_error`` the first step with a failure is the last."""
    reports = []
    for step in steps:
        if not step.enabled:
            reports.append({"stage": step.name, "status": "skipped", "actions": {}})
            continue
        # Stored, so that no later step computes this one again; its actions are counted while it is written.
        seen, known = Observation(f"{step.name}-{uuid.uuid4().hex}"), F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False))
        before, ledger = ledger, runtime.materialize(step.run(ledger).observe(seen, *(F.count_if(F.col("action") == a).alias(a) for a in ACTIONS), F.count_if(~known).alias("other")), "ledger")
        runtime.forget(before)
        counts = {a: n for a, n in seen.get.items() if n}
        if counts.pop("other", 0):  # a step with actions of its own
            counts = {r["action"]: r["count"] for r in ledger.groupBy("action").count().collect()}
        bad = sum(n for a, n in counts.items() if a in ("CHUNK_FAILED", "NO_DATASET", "NO_FILE"))
        status = "ok" if not bad else "failed" if bad == sum(counts.values()) else "partial"
        reports.append({"stage": step.name, "status": status, "actions": counts})
        if bad and stop_on_error:
            break
    return ledger, reports


def report_rows(reports: list[dict], spark) -> DataFrame:
    """(stage, status, action, n): a run's report as rows."""
    rows = [(r["stage"], r["status"], a, n) for r in reports for a, n in (r["actions"] or {None: None}).items()]
    return spark.createDataFrame(rows, "stage string, status string, action string, n long")


def overall(reports: list[dict]) -> str:
    states = [r["status"] for r in reports if r["status"] != "skipped"]
    return "skipped" if not states else "ok" if set(states) == {"ok"} else "failed" if set(states) == {"failed"} else "partial"


def run_log(config: dict[str, str], target_stems: list[str], duration_ms: int, spark) -> DataFrame:
    """One row for the log of runs."""
    return spark.createDataFrame([(config, target_stems, duration_ms)], "config map<string,string>, target_stems array<string>, duration_ms int").withColumn("created_at", X.now_text())


def append_runs(runs: DataFrame, path: str) -> None:
    """Runs go behind those that the log at ``path`` has; a failed append leaves it as it was."""
    runs.write.mode("append").parquet(path)


def merged_profile(base: Column, override: Column, known: list[str]) -> Column:
    """A profile's values over the base's; unknown keys go, null values do not count."""
    kept = F.map_filter(override, lambda k, v: k.isin(known) & v.isNotNull())
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(kept), k)), kept)


def partial_update(values: Column) -> Column:
    """Fields to send of an update: null is absent, an empty list or text clears."""
    return F.map_filter(values, lambda k, v: v.isNotNull())
