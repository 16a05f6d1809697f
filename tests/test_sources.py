"""The stored ledger, the stream of tasks, and the data sources, with failures and restarts."""

import datetime
import io
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from granary.sources import datasource, files, stored
from granary.streaming import progress, tasks

SCHEMA = "tenant_id string, filename string, status string, created_at string"


def made(spark, n=200):
    return spark.createDataFrame([(f"t{k % 3}", f"f{k}", "old", "2024") for k in range(n)], SCHEMA)


def test_stored_ledger(spark, tmp_path):
    t = stored.StoredLedger(spark, (tmp_path / "ledger").as_uri(), made(spark).schema, ["tenant_id", "filename"], buckets=32)
    t.create(made(spark))
    want = {(r[0], r[1]): tuple(r) for r in made(spark).collect()}
    assert {(r[0], r[1]): tuple(r) for r in t.read().collect()} == want
    before = {tuple(r) for r in t.files().collect()}
    new = [("t0", "f0", "new", "2025"), ("t1", "g", None, "2025"), ("t2", "f5", None, None)]
    touched = t.upsert(spark.createDataFrame(new, SCHEMA), preserved=["created_at"])
    want |= {("t0", "f0"): ("t0", "f0", "new", "2024"), ("t1", "g"): new[1], ("t2", "f5"): ("t2", "f5", None, "2024")}
    assert {(r[0], r[1]): tuple(r) for r in t.read().collect()} == want
    after = {tuple(r) for r in t.files().collect()}
    assert 1 <= len(touched) <= 3 and {b for b, _ in before ^ after} == set(touched) and before & after
    assert t.upsert(spark.createDataFrame(new, SCHEMA), preserved=["created_at"]) == touched and {(r[0], r[1]): tuple(r) for r in t.read().collect()} == want  # run again
    assert t.upsert(spark.createDataFrame([], SCHEMA)) == []
    twice = spark.createDataFrame([("t0", "f0", s, "x", k) for k, s in enumerate(["a", "b"])], SCHEMA + ", w int")
    t.upsert(twice, order="w")
    assert t.read().where("filename = 'f0'").first()["status"] == "b"
    t.update(spark.createDataFrame([("t0", "f0", "", "y"), ("t9", "none", "z", "z")], SCHEMA))
    assert tuple(t.read().where("filename = 'f0'").first()) == ("t0", "f0", "b", "y") and t.read().where("filename = 'none'").count() == 0
    # A bucket that ends empty is gone, and so is a table.
    t.delete(t.read().where("tenant_id <> 't1'"))
    assert {r["tenant_id"] for r in t.read().collect()} == {"t1"}
    t.delete(t.read())
    assert t.read().count() == 0 and t.upsert(made(spark, 3)) and t.read().count() == 3


def test_only_touched_buckets_are_read(spark, tmp_path):
    t = stored.StoredLedger(spark, (tmp_path / "ledger").as_uri(), made(spark).schema, ["tenant_id", "filename"], buckets=32)
    t.create(made(spark, 1000))
    plan = t.rows().where(F.col(stored.BUCKET).isin([3]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(granary_bucket" in plan or "PartitionFilters: [(granary_bucket" in plan or "granary_bucket" in plan.split("PartitionFilters")[1][:60]


T0 = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def feed(spark, folder, *events):
    rows = [(task, T0 + datetime.timedelta(seconds=s), p, "", state) for task, s, p, state in events]
    n = len(list(folder.glob("*"))) if folder.exists() else 0
    spark.createDataFrame(rows, tasks.EVENT).coalesce(1).write.mode("overwrite").json((folder / f"part={n}").as_uri())


def test_tasks_with_silence_late_events_and_restarts(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    source, table = tmp_path / "in", tasks.table(spark, (tmp_path / "table").as_uri(), buckets=4)
    table.create(spark.createDataFrame([], table.schema))

    def run():
        stream = spark.readStream.schema(tasks.EVENT).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(source.as_uri())
        progress.drain(tasks.follow(stream, table, (tmp_path / "ck").as_uri()))
        return {r["task_id"]: (int((r["ts"].replace(tzinfo=datetime.timezone.utc) - T0).total_seconds()), r["progress"], r["status"], r["updates"]) for r in table.read().collect()}

    feed(spark, source, ("a", 0, 10, "parsing"), ("b", 1, 5, "parsing"), ("a", 3, 20, "parsing"), ("a", 2, 15, "parsing"))
    assert run() == {"a": (3, 20, "parsing", 3), "b": (1, 5, "parsing", 1)}
    # After a restart and a long silence a running task is still one row; an older event within the watermark only counts.
    feed(spark, source, ("a", 100, 30, "parsing"))
    feed(spark, source, ("a", 99, 29, "parsing"), ("b", 101, 100, "done"))
    assert run() == {"a": (100, 30, "parsing", 5), "b": (101, 100, "done", 2)}
    # An event behind the watermark is dropped; a finished task that is taken up again does not expire.
    feed(spark, source, ("a", 20, 99, "parsing"), ("b", 120, 1, "parsing"), ("c", 120, 100, "failed"))
    feed(spark, source, ("d", 400, 1, "parsing"))
    feed(spark, source, ("d", 401, 2, "parsing"))
    got = run()
    assert got == {"a": (100, 30, "parsing", 5), "b": (120, 1, "parsing", 3), "d": (401, 2, "parsing", 2)}


def test_idle_tasks_expire(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    source = tmp_path / "in"
    feed(spark, source, ("a", 0, 10, "parsing"))
    feed(spark, source, ("b", 500, 10, "parsing"))
    feed(spark, source, ("b", 501, 20, "parsing"))
    stream = spark.readStream.schema(tasks.EVENT).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(source.as_uri())
    query = tasks.tracked(stream, idle=60).writeStream.format("memory").queryName("idle_tasks").outputMode("update").option("checkpointLocation", (tmp_path / "ck").as_uri()).trigger(availableNow=True).start()
    progress.drain(query)
    assert [(r["task_id"], r["updates"]) for r in spark.table("idle_tasks").where("expired").collect()] == [("a", 1)]


def test_files_are_written_one_for_each_row(spark, tmp_path):
    rows = [(f"d{k % 7}/chunk_{k:03d}.md", f"text é {k}".encode()) for k in range(50)] + [("empty", None)]
    datasource.write_files(spark.createDataFrame(rows, "path string, content binary").repartition(5), (tmp_path / "out").as_uri())
    found = {str(p.relative_to(tmp_path / "out")): p.read_bytes() for p in (tmp_path / "out").rglob("*") if p.is_file()}
    assert b'"files": 51' in found.pop("_SUCCESS") and found == {p: c or b"" for p, c in rows}
    assert {(r["path"], bytes(r["content"])) for r in datasource.read_files(spark, (tmp_path / "out").as_uri()).collect()} == {(p, c or b"") for p, c in rows}
    assert datasource.read_files(spark, (tmp_path / "none").as_uri()).count() == 0
    assert {r["text"] for r in files.text_of(spark, (tmp_path / "out/d1").as_uri()).collect()} == {f"text é {k}" for k in range(1, 50, 7)}
    text = spark.createDataFrame([("d0/chunk_000.md", "other"), ("d0/chunk_007.md", "text é 7")], "path string, content string")
    datasource.write_files(text, (tmp_path / "out").as_uri())
    assert (tmp_path / "out/d0/chunk_000.md").read_text() == "other"


@pytest.mark.parametrize("bad", ["../up", "/root/x", "", "_staging/x"])
def test_a_failed_job_leaves_no_file(spark, tmp_path, bad):
    rows = spark.createDataFrame([(f"a/{k}", b"x") for k in range(40)] + [(bad, b"y")], "path string, content binary").repartition(6)
    with pytest.raises(Exception, match="leaves the folder"):
        datasource.write_files(rows, (tmp_path / "out").as_uri())
    assert [p for p in (tmp_path / "out").rglob("*") if p.is_file() and "_staging" not in p.parts] == [] and not (tmp_path / "up").exists()


def book(sheets, shared=True):
    strings, parts = [], []
    for rows in sheets.values():
        xml = ""
        for n, row in rows:
            cells = ""
            for k, v in enumerate(row):
                ref = f"{chr(65 + k)}{n}"
                if v is None:
                    continue
                if isinstance(v, str) and shared:
                    strings.append(v)
                    cells += f'<c r="{ref}" t="s"><v>{len(strings) - 1}</v></c>'
                elif isinstance(v, str):
                    cells += f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
                else:
                    cells += f'<c r="{ref}"><v>{v}</v></c>'
            xml += f'<row r="{n}">{cells}</row>'
        parts.append(f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{xml}</sheetData></worksheet>')
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{k}" Target="worksheets/s{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>")
        if strings:
            z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">' + "".join(f"<si><t>{x}</t></si>" for x in strings) + "</sst>")
        for k, p in enumerate(parts, 1):
            z.writestr(f"xl/worksheets/s{k}.xml", p)
    return out.getvalue()


def test_workbooks_sheet_by_sheet(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in/a.xlsx").write_bytes(book({"one": [(1, ["h", None, 3]), (2, [None]), (5, ["x  y", "z", None, "w"])], "two": []}))
    (tmp_path / "in/deep/b.XLSX").write_bytes(book({"é": [(k, [k, "t"]) for k in range(1, 3001)]}, shared=False))
    (tmp_path / "in/broken.xlsx").write_bytes(b"no zip")
    (tmp_path / "in/other.txt").write_text("no book")
    df = datasource.read_workbooks(spark, (tmp_path / "in").as_uri())
    assert df.rdd.getNumPartitions() == 3
    got = Counter((r["file"], r["sheet"], r["sheet_no"], r["row_no"], tuple(r["cells"])) for r in df.collect())
    want = [("a.xlsx", "one", 1, 1, ("h", "", "3")), ("a.xlsx", "one", 1, 5, ("x y", "z", "", "w"))] + [("b.XLSX", "é", 1, k, (str(k), "t")) for k in range(1, 3001)]
    assert got == Counter(want)
    with pytest.raises(Exception):
        datasource.read_workbooks(spark, (tmp_path / "in").as_uri(), strict=True).collect()




def test_files_reach_no_driver(spark, tmp_path):
    """Neither the plan of a read nor what a write tells the driver grows with the files; pieces that an attempt before has moved are passed over."""
    root = (tmp_path / "out").as_uri()
    rows = spark.range(0, 2500, 1, 1).select(F.format_string("d%d/a/%d", F.col("id") % 1300, "id").alias("path"), F.col("id").cast("string").alias("content"))
    staged = rows.mapInArrow(datasource._staged(root, "job"), "folder string, files long, bytes long").collect()
    assert [r["files"] for r in staged] == [2500]
    pieces = spark.createDataFrame([(f"{staged[0]['folder']}/{k}",) for k in range(4)], "piece string")
    for _ in range(2):
        assert pieces.mapInArrow(datasource._placed(root, False), "piece string").count() == 0
    read = datasource.read_files(spark, root)
    assert "d1299" not in read._jdf.queryExecution().toString()
    assert {(r["path"], bytes(r["content"])) for r in read.collect()} == {(f"d{k % 1300}/a/{k}", str(k).encode()) for k in range(2500)}
