"""HTML, addresses, files, ledger, pipeline and streams."""

import datetime
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from granary.functions import html as H
from granary.functions import text as X
from granary.operators import blocks as B
from granary.operators import crawl, segments
from granary.operators import ledger as L
from granary.plans import pipeline as P
from granary.sources import files, sinks
from granary.streaming import progress


def one(spark, *columns):
    return spark.range(1).select(*(c.alias(f"c{k}") for k, c in enumerate(columns))).first()


def test_markdown_of_a_page():
    page = """<html><head><title> A  page </title><style>x</style></head><body><nav>menu</nav><h1>Head</h1><p>Some <b>bold</b> and <a href="/x?a=1#f">link</a>.</p>
    <div class="ad-banner"><p>buy</p></div><div style="display: none">hidden</div><ul><li>one<ul><li>deep</li></ul></li><li>two</li></ul><ol><li>a</li><li>b</li></ol>
    <pre>x = 1
  y</pre><table><tr><th>k</th><th>v</th></tr><tr><td>1</td><td>a|b</td></tr></table><img src="i.png" alt="pic"><blockquote>said</blockquote><hr><script>bad()</script></body></html>"""
    title, text = H.to_markdown(page, "http://h.example/dir/")
    assert title == "A page"
    for part in ("# Head", "Some **bold** and [link](http://h.example/x?a=1#f).", "- one\n  - deep\n- two", "1. a\n2. b", "```\nx = 1\n  y\n```", "| k | v |\n| --- | --- |\n| 1 | a\\|b |", "![pic](http://h.example/dir/i.png)", "> said", "---"):
        assert part in text, part
    for part in ("menu", "buy", "hidden", "bad()"):
        assert part not in text
    assert H.to_markdown(None) == ("", "") and H.to_markdown("plain <b>x", "", rich=False)[1] == "plain x"


def test_links_and_overlays():
    page = "<a href='/a#x'>1</a><a href='/a'>2</a><a href='mailto:x'>3</a><script>var p='/f/doc.PDF';</script><a href='http://O.example'>4</a>"
    assert H.links(page, "https://h.example/d/") == ["https://h.example/a", "http://o.example/", "https://h.example/f/doc.PDF"]
    kept = H.without_overlays("<p>a &amp; b</p><div id='aiModal'><div>x</div></div><br><div class='badge'>c</div>")
    assert kept == "<p>a &amp; b</p><br><div class='badge'>c</div>"
    assert H.without_overlays("<div class='modal'>never closed") == "<div class='modal'>never closed" and H.without_overlays(None) is None


def test_page_time_and_bytes():
    assert H.page_time('<meta property="article:published_time" content="2024-01-02"><meta name="lastmod" content="2025-3-4 5:06">', "") == "2025-03-04 05:06"
    assert H.page_time("<time datetime='2023-10-11T12:13'>", "") == "2023-10-11 12:13" and H.page_time("", "发布 2026年8月1日 x") == "2026-08-01" and H.page_time(None, "2024-13-01") is None
    assert [H.decode(x) for x in ("é".encode(), "中文".encode("gb18030"), None)] == ["é", "中文", None]


@pytest.mark.parametrize("url,normal,ext", [("HTTP://Www.X.com", "http://www.x.com/", ""), ("https://x.com/a/b.PDF?q=1#f", "https://x.com/a/b.PDF?q=1", ".pdf"), ("mailto:a@b", "", ""), ("ftp://x/y", "", ""), ("https://x.com/%E4%B8%AD.docx", "https://x.com/%E4%B8%AD.docx", ".docx")])
def test_addresses(spark, url, normal, ext):
    assert list(one(spark, X.normalize_url(F.lit(url)), X.url_ext(F.lit(url)))) == [normal, ext]
    assert H.normalized(url) == normal


def test_scope(spark):
    ok = lambda a, b, s="column": one(spark, X.site_scope(F.lit(a), F.lit(b), s))[0]
    assert ok("http://www.x.com/n/1_2", "http://x.com/n/1") and ok("http://x.com/n/1/d", "http://x.com/n/1") and not ok("http://x.com/n/12", "http://x.com/n/1")
    assert ok("http://x.com/files/a.pdf", "http://x.com/n/1") and not ok("http://y.com/n/1", "http://x.com/n/1") and ok("http://x.com/z", "http://x.com/n", "host") and not ok("http://x.com/z", "http://x.com/n/", "host")
    assert [r[0] for r in (one(spark, crawl.url_denied(F.lit(u), ["x.com", "https://y.com/ok"])) for u in ("http://a.x.com/1", "https://y.com/ok/2", "https://y.com/no", "ftp://x.com", "http://"))] == [None, None, "not allowed", "scheme", "scheme"]


def test_small_functions(spark):
    got = one(
        spark, X.charset(F.lit("text/html; charset=GBK"), F.lit("")), X.image_kind(F.lit(b"\x89PNG1234"), F.lit("")), X.image_kind(F.lit(b"zz"), F.lit("http://x/a.jpg")), X.disposition_filename(F.lit("attachment; filename*=UTF-8''a%20b.pdf")),
        X.json_strings(F.lit('```json\n["a", "b"]\n```')), X.json_strings(F.lit("no")), X.cell_text(F.lit(" a\n b ")), X.tidy_markdown(F.lit("\na  \n\n\n\nb \n")), X.object_url(F.lit("https://c/"), F.lit("a b\\ü.png")), X.slugify(F.lit('a/b: "c"  d')),
        X.strip_qualifier(F.lit("doc [vlm]")), X.is_document_mime(F.lit("application/pdf; x")), X.clamp(F.lit("x"), 0, 5, 2), X.sanitize_html(F.lit("<p onclick='x()'>a</p><script>b</script><a href=\"javascript:c\">d</a>")), X.first_date(F.lit("on 2024/3/5T07:08 ok")),
    )
    assert list(got) == ["gbk", ".png", ".jpg", "a b.pdf", ["a", "b"], None, "a b", "a\n\nb", "https://c/a%20b/%C3%BC.png", "a_b___c__d", "doc", True, 2, '<p>a</p><a href="#">d</a>', "2024-03-05 07:08"]


def office(parts):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return held.getvalue()


def test_office_documents(spark, tmp_path):
    w, a, s = files._W[1:-1], files._A[1:-1], files._S[1:-1]
    docx = office({"word/document.xml": f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>text</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p><w:r><w:t>wide</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p/></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})
    pptx = office({f"ppt/slides/slide{k}.xml": f'<p xmlns:a="{a}"><a:p><a:t>s{k}</a:t></a:p></p>' for k in (10, 2)})
    xlsx = office({"xl/workbook.xml": f'<workbook xmlns="{s}" xmlns:r="{files._R[1:-1]}"><sheets><sheet name="One" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<R><Relationship Id="r1" Target="worksheets/sheet1.xml"/></R>', "xl/sharedStrings.xml": f'<sst xmlns="{s}"><si><t>name</t></si></sst>', "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{s}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>3</v></c></row><row/><row><c r="B2"><v>4</v></c></row></sheetData></worksheet>'})
    for name, data in (("a.docx", docx), ("b.pptx", pptx), ("c.xlsx", xlsx), ("d.docx", b"broken"), ("e.exe", b"x")):
        (tmp_path / name).write_bytes(data)
    got = {r["name"]: r for r in files.scan(spark, tmp_path.as_uri(), content=True).withColumn("t", files.office_text("content", "ext")).collect()}
    assert set(got) == {"a.docx", "b.pptx", "c.xlsx", "d.docx"} and got["d.docx"]["t"] is None
    assert got["a.docx"]["t"] == "# Head\n\ntext\n\n| wide |  |\n| --- | --- |\n|  | b |" and got["b.pptx"]["t"] == "## 2\ns2\n\n## 10\ns10" and got["c.xlsx"]["t"] == "## One\n\n| name |  | 3 |\n| --- | --- | --- |\n|  | 4 |  |"


def test_file_kinds_and_fallback(spark):
    kind = lambda n: one(spark, files.output_kind(F.lit(n)), files.preview_kind(F.lit(n)), files.chunk_file_kind(F.lit(n)))
    assert list(kind("x_content_list_v2.json")) == ["blocks_v2", "text", "metadata"] and list(kind("chunk_001_a.md")) == ["markdown", "text", "chunk"] and kind("a.PNG")[0] == "image"
    assert one(spark, files.fallback(F.lit("short"), F.lit(None).cast("string"), F.lit("x" * 120)))[0] == "x" * 120 and one(spark, files.fallback(F.lit("ab"), F.lit("a")))[0] == "ab"


def test_delimited_preview_and_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n" + "".join(f"{i},x\n" for i in range(30)))
    df, n = files.delimited_preview(spark, (tmp_path / "a.csv").as_uri(), rows=10)
    assert n == 30 and df.count() == 10
    payload = segments.prepare(spark.createDataFrame([(1, 0, "a\n\n" + "b" * 6000, "ans", ["k"], [str(i) for i in range(12)]), (1, 1, None, None, None, None)], "doc_id long, ord int, content string, answer string, keywords array<string>, attachment_ids array<string>"))
    rows = payload.orderBy("ord", "piece_no").collect()
    assert [len(r["content"]) for r in rows] == [3, 5000, 1000] and [r["answer"] for r in rows] == ["ans", None, None] and len(rows[0]["attachment_ids"]) == 12
    again = segments.retried(payload, payload.where("piece_no = 0").select("doc_id", "batch_no")).orderBy("ord", "piece_no").collect()
    assert len(again) == 3 and again[0]["attachment_ids"] == [str(i) for i in range(10)]
    assert sinks.segment_requests(payload).count() == 1 and sinks.log_lines(payload).count() == 3


def test_ledger_cases(spark):
    base = spark.createDataFrame([("default", "a", 1), ("t", "a", 2), ("t", "b", 3)], "tenant_id string, filename string, seq int")
    assert L.fetch(base, "a").first()["seq"] == 1 and L.fetch(base, "a", "t").first()["seq"] == 2 and L.fetch(base, "zz").count() == 0
    twice = spark.createDataFrame([("t", "b", 7, 1), ("t", "b", 8, 2)], "tenant_id string, filename string, seq int, w int")
    assert sorted(r["seq"] for r in L.upsert(base, L.last_write(twice, ["tenant_id", "filename"], "w").drop("w"), ["tenant_id", "filename"]).collect()) == [1, 2, 8]
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "name string")
    got = {r["wanted"]: (r["found"], r["rule"]) for r in L.resolve_directories(names("a report", "b report [vlm]", "c report (2)", "long document name 2024", "none"), names("a report", "b report", "c report", "long document name 2023 final")).collect()}
    assert got == {"a report": ("a report", 0), "b report [vlm]": ("b report", 1), "c report (2)": ("c report", 2), "long document name 2024": ("long document name 2023 final", 3)}


def test_directories_of_all_parts_against_brute_force(spark, sf):
    import hashlib
    import re

    from granary.plans import relational

    keys = [r[0] for r in spark.read.parquet(f"{sf}/part.parquet").select("p_partkey").collect()]
    base = {k: "directory " + hashlib.sha1(str(k).encode()).hexdigest()[:12] for k in keys}
    wanted = {base[k] + ("", " [vlm]", "(2)", " final")[k % 4] for k in keys}
    odd = ["short", "sixsix", "sixsix and on", "sixsix and so on", "sixsix ano", "a b", "directory"]
    cases = [(relational.directory_match_all(spark, sf), wanted, {base[k] for k in keys if k % 5}), (L.resolve_directories(*(spark.createDataFrame([(x,) for x in n], "name string") for n in (odd, odd[::-1][:5]))), set(odd), set(odd[::-1][:5]))]
    for found, left, right in cases:
        tagless = lambda x: re.sub(r"\s*\[[^\]]*\]\s*$", "", x.strip())
        clean = lambda x: re.sub(r"\s*[(（]\d+[)）]\s*$", "", tagless(x))
        want = {}
        for w in left:
            hits = []
            for e in right:
                a, b = sorted((clean(w), clean(e)), key=len)
                rules = (w == e, tagless(w) == tagless(e), clean(w) == clean(e), len(a) >= 6 and b.startswith(a[: max(6, int(0.7 * len(a)))]))
                hits += [(rules.index(True), e)] if True in rules else []
            if hits:
                want[w] = min(hits)
        assert {r["wanted"]: (r["rule"], r["found"]) for r in found.collect()} == want
        assert any(rule == 3 for rule, _ in want.values())


def test_every_field_has_operations(spark):
    names = [f"f{k}" for k in range(1200)]
    fields = spark.createDataFrame([(n, f"id-{n}") for n in names], "name string, field_id string")
    values = spark.range(2).select("id", *(F.lit("v").alias(n) for n in names))
    assert [len(r["operations"]) for r in L.metadata_operations(values, fields, "id", names).collect()] == [1200, 1200]


def test_report_on_all_orders(spark, sf):
    from granary.plans import relational

    assert relational.report_split_all(spark, sf).count() == spark.read.parquet(f"{sf}/orders.parquet").count()
    actions = spark.createDataFrame([(1, "a", 1, "x", False)], "stem int, stage string, ord int, action string, failed boolean")
    assert {(r["stem"], r["status"], len(r["stages"])) for r in L.report_by_stem(actions, spark.createDataFrame([(1,), (2,)], "stem int")).collect()} == {(1, "ok", 1), (2, "none", 0)}


def test_pipeline_stages(spark):
    ledger = spark.createDataFrame([("a", "a.pdf", "t", "", "", "", "pending", ""), ("b", "b.pdf", "t", "x", "", "", "parsed", ""), ("c", "c.pdf", "default", "x", "y", "", "chunked", ""), ("d", "d.pdf", "u", "x", "y", "", "error", "old")], "stem string, filename string, tenant_id string, parse string, chunks string, remote_id string, status string, error_msg string").withColumn("update_time", F.lit(""))
    pending = spark.createDataFrame([("a.pdf", 20)], "filename string, pages int")
    parsed = spark.createDataFrame([("b", True, False), ("d", True, True)], "stem string, found boolean, trivial boolean")
    routes = spark.createDataFrame([("t", "ds")], "tenant_id string, dataset_id string")
    assert {r["stem"]: (r["action"], r["backend"]) for r in P.parse_actions(ledger, pending).collect()} == {"a": ("PARSE", "vlm"), "b": ("NO_FILE", None), "c": ("NO_FILE", None), "d": ("NO_FILE", None)}
    assert {r["stem"]: r["action"] for r in P.chunk_actions(ledger, parsed, force=True).collect()} == {"a": "NO_PARSED", "b": "CHUNKED", "c": "CHUNK_FAILED", "d": "CHUNK_FAILED"}
    assert {r["stem"]: r["action"] for r in P.upload_actions(ledger, routes).collect()} == {"a": "NO_CHUNKS", "b": "NO_CHUNKS", "c": "UPLOAD", "d": "NO_DATASET"}
    after, reports = P.run_steps(ledger, [P.Step("upload", lambda d: P.after_stage(P.upload_actions(d, routes), "upload", "now")), P.Step("parse", lambda d: d, enabled=False)])
    assert {r["stem"]: r["status"] for r in after.collect()} == {"a": "pending", "b": "parsed", "c": "done", "d": "error"} and P.overall(reports) == "partial"
    assert P.reset_errors(ledger).where("status = 'error'").count() == 0
    assert [one(spark, P.canonical_status(F.lit(x)))[0] for x in ("Parsing_Done", "done", "??")] == ["parsed", "done", None]
    merged = one(spark, P.merged_profile(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3"), F.lit("z"), F.lit("9")), ["a", "b"]))[0]
    assert merged == {"a": "1", "b": "3"}


def test_missing_images_and_choice(spark):
    chunks = spark.createDataFrame([(1, ["images/a.png", "images/b.png"])], "doc_id long, image_refs array<string>")
    images = spark.createDataFrame([(1, "other/a.png")], "doc_id long, path string")
    assert [r["path"] for r in segments.missing_images(chunks, images).collect()] == ["images/b.png"]
    assert one(spark, segments.image_address(F.lit(""), F.lit(None).cast("string"), F.lit("up"), F.lit("rel")))[0] == "up"


def test_small_ledger_operations(spark):
    rows = lambda schema, *x: spark.createDataFrame(list(x), schema)
    assert [r["segment_id"] for r in L.not_persisted(rows("segment_id string", ("a",), ("b",)), rows("segment_id string", ("a",))).collect()] == ["b"]
    manifest = rows("stem string, status string, remote_id string, parse string", ("a", "error", "r", "p"), ("b", "done", "r", "p"), ("c", "x", "", "p"), ("d", "x", None, None))
    got = L.record_status(rows("stem string, status string", *[(k, "new") for k in "abcde"]), manifest).collect()
    assert {r["stem"]: r["status"] for r in got} == {"a": "error", "b": "ingested", "c": "parsed", "d": "landed", "e": "new"}
    both = L.listed_directories(rows("path string, stem string", ("c/a", "a"), ("c/b", "b")), rows("path string, stem string", ("c/a", "a"), ("o/a", "a")), rows("stem string", ("a",)))
    assert sorted(r["path"] for r in both.collect()) == ["c/a", "o/a"]
    assert L.keyword_rows(manifest, " ", ["stem"]).count() == 4 and L.keyword_rows(manifest, "ERR", ["stem", "status"]).count() == 1
    block = F.struct(F.lit("table").alias("block_type"), F.lit(None).cast("int").alias("level"), F.lit("").alias("text"), F.lit("<td>a</td> b").alias("table_html"), F.lit(None).cast("string").alias("image_caption"))
    got = one(spark, X.plain_text(block), X.within(F.lit("/a/b/"), F.lit("/a/b/c")), X.within(F.lit("/a/b"), F.lit("/a/bc")), X.within(F.lit("/a/b"), F.lit("/a/b/../c")), X.active_profile(F.create_map(F.lit("x"), F.lit("1")), F.lit("y"), F.lit("old")), F.length(X.now_text()))
    assert list(got) == ["a b", True, False, False, "old", 19]


def test_crawl_order_depth_and_cap(spark):
    edges = spark.createDataFrame([("http://x/a", "http://x/a/1", 0), ("http://x/a", "http://x/f.pdf", 1), ("http://x/a", "http://y/z", 2), ("http://x/a/1", "http://x/a/1/d", 0), ("http://x/a/1", "http://x/a", 1), ("http://x/a/1/d", "http://x/a/9", 0)], "url string, link string, ord int")
    seeds = spark.createDataFrame([("http://X/a", 0)], "seed string, ord int")
    got = [(r["url"], r["depth"]) for r in crawl.crawl(spark, seeds, edges).orderBy("ord").collect()]
    assert got == [("http://x/a", 0), ("http://x/f.pdf", 1), ("http://x/a/1", 1), ("http://x/a/1/d", 2)]
    assert crawl.crawl(spark, seeds, edges, max_pages=2).count() == 2


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([(1, "a. b. c."), (2, None)], "doc_id long, text string").write.json(source.as_uri())
    for _ in range(2):
        progress.drain(progress.chunk_stream(spark, source.as_uri(), (tmp_path / "out").as_uri(), (tmp_path / "ck").as_uri()))
    assert spark.read.parquet((tmp_path / "out").as_uri()).count() == 1
    t = datetime.datetime(2024, 1, 1)
    rows = [("x", t, "10%"), ("x", t + datetime.timedelta(seconds=5), "20%"), ("x", t + datetime.timedelta(seconds=100), "30%")]
    held = progress.progress(spark.createDataFrame(rows, "task_id string, ts timestamp, state string")).orderBy("last_seen").collect()
    assert [(r["state"], r["updates"]) for r in held] == [("20%", 2), ("30%", 1)]


def test_metadata_operations_of_many_fields(spark):
    names = [f"f{k}" for k in range(1200)]
    values = spark.createDataFrame([(1, *map(str, range(1200)))], "doc_id int, " + ", ".join(f"{n} string" for n in names))
    fields = spark.createDataFrame([(n, f"id{n}") for n in names], "name string, field_id string")
    assert len(L.metadata_operations(values, fields, "doc_id", names).first()["operations"]) == 1200


def test_contained_and_missing_names(spark):
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "name string")
    left, right = names("Report (2024)", "x", "plan-B", "-", "ab"), names("report 2024 final", "Plan B", "b")
    got = {r["wanted"]: r["found"] for r in L.contained_names(left, right).collect()}
    norm = lambda s: "".join(c for c in s.lower() if c not in " _-()[].,")
    want = {a: min(b for b in ("report 2024 final", "Plan B", "b") if norm(a) in norm(b) or norm(b) in norm(a)) for a in ("Report (2024)", "plan-B", "ab")}
    assert got == want and sorted(r["wanted"] for r in L.missing_files(left, right).collect()) == ["-", "x"]
    assert [tuple(r) for r in L.shared_words(names("ab", "bc", "cd"), ["b", "d"]).orderBy("word").collect()] == [("b", 2, "ab", "bc"), ("d", 1, "cd", "cd")]


def test_embedding_answers(spark):
    from granary.operators import embeddings as E

    got = one(spark, *(E.answered(F.lit(x)) for x in ('{"data": [{"embedding": [1.0, 2.0]}, {"embedding": [3.0]}]}', '{"embeddings": [[0.5]]}', '{"embeddings": []}', "no")))
    assert list(got) == [[[1.0, 2.0], [3.0]], [[0.5]], None, None]
    texts = spark.createDataFrame([(d, k, f"t{k % 3}") for d in (1, 2) for k in range(5)], "doc_id long, ord int, text string")
    batches = E.requests(texts, 2)
    assert sorted((r["doc_id"], r["batch_no"], len(r["texts"])) for r in batches.collect()) == [(d, b, n) for d in (1, 2) for b, n in ((0, 2), (1, 2), (2, 1))]
    answers = spark.createDataFrame([(d, b, '{"embeddings": [' + ", ".join(f"[{b}.0]" for _ in range(n)) + "]}") for d in (1, 2) for b, n in ((0, 2), (1, 2), (2, 1 if d == 1 else 0))], "doc_id long, batch_no int, response string")
    whole = E.complete(batches, answers)
    assert [(r["doc_id"], r["texts"], [v[0] for v in r["vectors"]]) for r in whole.collect()] == [(1, ["t0", "t1", "t2", "t0", "t1"], [0, 0, 1, 1, 2])]
    assert E.sentence_vectors(whole).first()["sentence_vectors"] == {"t0": [0.0], "t1": [0.0], "t2": [1.0]}


def test_archives_and_settings(spark):
    got = one(spark, files.canonical_name(F.lit("a/Full.MD"), F.lit("s")), files.canonical_name(F.lit("x_content_list.json"), F.lit("s")), files.canonical_name(F.lit("images/b.jpg"), F.lit("s")), X.env_entry(F.lit(" export  A_1 = x")), X.env_entry(F.lit("#A=1")), X.env_entry(F.lit("A 1")), X.env_entry(F.lit(None).cast("string")))
    assert [tuple(x) if hasattr(x, "asDict") else x for x in got] == ["a/s.md", "s_content_list_v2.json", "images/b.jpg", ("A_1", True), None, None, None]
    assert files.zip_entries(None) is None and files.zip_entries(office({"t/": "", "t/a/b.txt": "x", "c": "y"})) == [{"path": "a/b.txt", "data": b"x"}, {"path": "c", "data": b"y"}]


def test_tenants(spark):
    kinds = "tenant_id string, name string, dataset_id string, api_key_hash string, status string, create_time string, update_time string"
    base = spark.createDataFrame([("a", "A", "d", "h", "active", "t0", "t0"), ("default", None, None, None, "active", "t0", "t0")], kinds)
    wanted = spark.createDataFrame([("a", "x", "d", "k"), (" B ", "x", " d ", "k"), ("-c", "x", "d", "k"), ("default", "x", "d", "k"), ("e", "x", None, "k")], "tenant_id string, name string, dataset_id string, api_key string")
    assert {r["tenant_id"]: r["denied"] for r in L.created_tenants(base, wanted, "now").collect()} == {"a": "exists", "b": None, "-c": "malformed", "default": "built in", "e": "no dataset"}
    change = spark.createDataFrame([("a", None, "d9", None, None), ("default", None, None, None, None)], "tenant_id string, name string, dataset_id string, status string, api_key string")
    after = {r["tenant_id"]: r for r in L.updated_tenants(base, change, "now").collect()}
    assert (after["a"]["dataset_id"], after["a"]["name"], after["a"]["api_key_hash"], after["a"]["update_time"], after["default"]["update_time"]) == ("d9", "A", "h", "now", "t0")
    assert [r["tenant_id"] for r in L.removed_tenants(base, base.select("tenant_id")).collect()] == ["default"]


def test_latest_progress_shows_each_task_once(spark):
    t = datetime.datetime(2024, 1, 1)
    rows = [("x", t, "10%"), ("x", t + datetime.timedelta(seconds=100), "30%"), ("y", t, "5%"), ("z", t + datetime.timedelta(seconds=200), "late")]
    seen = progress.latest_progress(spark.createDataFrame(rows, "task_id string, ts timestamp, state string"), F.lit(t + datetime.timedelta(seconds=110))).collect()
    assert [(r["task_id"], r["state"], r["updates"]) for r in seen] == [("x", "30%", 2)]


def test_table_parts_are_those_of_the_text_function(spark):
    from granary.operators import tables as T

    row = lambda n: f"<TR class='x'><td>{n}</td>\n</TR >"
    made = [None, "", "<table></table>", "no table", *(f"<p>a</p><table border=1>{h}{''.join(map(row, range(n)))}</table> tail" for n in (0, 1, 4, 5, 6, 11) for h in ("", "<thead><tr><th>$1 \\</th></tr></thead>", "<THEAD a='b'>\n<tr><th>x</th></tr></THEAD ><thead><tr><td>second</td></tr></thead>"))]
    frame = spark.createDataFrame([(k, h) for k, h in enumerate(made)], "k int, html string")
    for most in (1, 5):
        got = {r["k"]: r["p"] for r in frame.select("k", segments.table_parts(F.col("html"), most).alias("p")).collect()}
        assert got == {k: [] if h is None else T.split_rows(h, most) for k, h in enumerate(made)}


def test_blocks_of_markdown_keep_the_digits_at_their_ends(spark):
    docs = spark.createDataFrame([(1, "\n\n".join(f"{k} a {k}" for k in range(12)))], "doc_id long, text string")
    assert [b["text"] for b in B.from_markdown(docs).first()["blocks"]] == [f"{k} a {k}" for k in range(12)]


def test_references_that_are_cut_short_stay():
    page = "<title>a &amp;&amp</title><body><p>&lt;b &amp;&am</p><p>x &quot <a href='/q?a=1&amp;b=2'>&copy; c&copy</a> R & D &#65; &#65</p>"
    for rich in (True, False):
        title, text = H.to_markdown(page, "http://h.example/", rich)
        assert title == "a &&amp" and text == "<b &&am\n\nx &quot [© c&copy](http://h.example/q?a=1&b=2) R & D A &#65"


def test_what_is_no_overlay_stays_as_it_was_written():
    ad = "<div class='ad'><p>x &amp</p>\n</div>"
    for page in ("<P>a &b &amp c &#65 &copy2</P >\n{}<br/>&am", "{}\r\n<!-- x -- ><![CDATA[y]]><?z?>\n{}<i>\n</i >{}", "{}", "a{}{}", "<script>a<b && c</script>{}<p"):
        assert H.without_overlays(page.replace("{}", ad)) == page.replace("{}", "")


def test_settings_are_checked_once_for_a_row(spark):
    from granary.operators import profiles

    rows = spark.range(1).select(profiles.validated(F.create_map(F.lit("overlap"), F.lit("7"))).alias("c")).select(profiles.scoped(F.col("c.settings"), F.create_map(F.lit("overlap"), F.lit("8"))).alias("run"), "c.settings")
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("transform_values") <= 1
    assert (rows.first()["run"]["overlap"], rows.first()["settings"]["overlap"]) == ("8", "7")
