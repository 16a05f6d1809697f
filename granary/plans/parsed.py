"""Queries over documents as a parser would hand them over: pages of typed blocks, zones, regions, tables, vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import structure as S
from granary.functions import text as X
from granary.operators import blocks as B
from granary.operators import chunking, embeddings, longdocs, zones
from granary.operators import segments as G
from granary.plans.documents import CONFIG, _lines, table

_LINE_SQL = "l as (select doc_id, unnest(range(len(p))) as k, unnest(p) as t from (select doc_id, string_split(text, chr(10)) as p from documents))"


def _runs(*texts: Column) -> Column:
    return F.array(*(F.struct(F.lit("text").alias("type"), t.alias("content")) for t in texts))


def _counts(docs: DataFrame) -> DataFrame:
    """Blocks of each kind, what counts of them, and the sum of effective levels."""
    b = F.col("b")
    rows = docs.select("doc_id", F.explode("blocks").alias("b")).select("doc_id", b["block_type"].alias("block_type"), B.block_chars(b).alias("chars"), B.block_images(b).alias("images"), b["page_num"].alias("page"), S.effective_level(b["block_type"], b["text"], b["level"]).alias("level"))
    return rows.groupBy("doc_id", "block_type").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.sum("images").cast("long").alias("images"), F.max("page").alias("last_page"), F.coalesce(F.sum("level"), F.lit(0)).alias("levels"))


# --- parser output ---------------------------------------------------------------------------------


def _pages(docs: DataFrame) -> DataFrame:
    """Documents as pages of ten blocks, in the parser's JSON: titles, runs with an equation, images, tables, lists, headers, numbered paragraphs by turns."""

    def block(t: Column, k: Column) -> Column:
        at = lambda *n: (k % 7).isin(*n)
        runs = F.when(at(1), F.concat(_runs(t), F.array(F.struct(F.lit("equation_inline").alias("type"), F.concat(F.lit("x"), k.cast("string")).alias("content"))))).when(at(6), _runs(F.concat(F.lit("3.2 "), t)))
        kind = F.element_at(F.array(*map(F.lit, ("title", "paragraph", "image", "table", "list", "header", "paragraph"))), (k % 7 + 1).cast("int"))
        content = F.struct(
            F.when(at(0), 2).alias("level"), F.when(at(0), _runs(t)).alias("title_content"), runs.alias("paragraph_content"), F.when(at(2), F.struct(F.concat(F.lit("img/"), k.cast("string"), F.lit(".png")).alias("path"))).alias("image_source"),
            F.when(at(3), F.concat(F.lit("<table><tr><td>"), k.cast("string"), F.lit("</td></tr></table>"))).alias("html"), F.when(at(4), F.array(F.struct(_runs(t).alias("item_content")), F.struct(_runs(F.lit("second")).alias("item_content")))).alias("list_items"),
        )
        return F.struct(kind.alias("type"), content.alias("content"))

    items = F.transform("parts", block)
    pages = F.transform(F.sequence(F.lit(0), F.ceil(F.size("parts") / 10) - 1), lambda i: F.slice(items, (i * 10 + 1).cast("int"), 10))
    return _lines(docs).select("doc_id", F.to_json(pages).alias("json"))


def parsed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of parsed pages by kind."""
    return _counts(B.from_pages(_pages(table(spark, sf_dir, "documents"))))


_BLOCKS = f"""
{_LINE_SQL},
b as (
  select doc_id, k, 'title' as block_type, length(t) as chars, 0 as images, 2 as level from l where k % 7 = 0
  union all select doc_id, k, 'paragraph', length(t) + 3 + length(cast(k as varchar)), 0, null from l where k % 7 = 1
  union all select doc_id, k, 'image', 0, 1, null from l where k % 7 = 2
  union all select doc_id, k, 'table', length(cast(k as varchar)), 0, null from l where k % 7 = 3
  union all select doc_id, k, 'paragraph', length(t), 0, null from l where k % 7 = 4
  union all select doc_id, k, 'paragraph', 6, 0, null from l where k % 7 = 4
  union all select doc_id, k, 'title', length(t) + 4, 0, 2 from l where k % 7 = 6)
"""
PAGES_SQL = f"with {_BLOCKS} select doc_id, block_type, count(*) as n, cast(sum(chars) as bigint) as chars, cast(sum(images) as bigint) as images, cast(max(k // 10 + 1) as integer) as last_page, cast(coalesce(sum(level), 0) as bigint) as levels from b group by 1, 2"


def flat_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of a flat list with page numbers by kind."""

    def block(t: Column, k: Column) -> Column:
        at = lambda n: k % 4 == n
        kind = F.when(at(1), "image").when(at(2), "table").otherwise("text")
        return F.struct(
            kind.alias("type"), F.when(~at(1) & ~at(2), t).alias("text"), F.when(at(3), 1).alias("text_level"), F.floor(k / 10).cast("int").alias("page_idx"), F.when(at(1), F.concat(F.lit("i/"), k.cast("string"))).alias("img_path"),
            F.when(at(2), F.concat(F.lit("<table><tr><td>"), t, F.lit("</td></tr></table>"))).alias("table_body"), F.when(at(2), F.array(F.lit("a"), F.lit("b"))).alias("table_caption"),
        )

    docs = _lines(table(spark, sf_dir, "documents")).select("doc_id", F.to_json(F.transform("parts", block)).alias("json"))
    return _counts(B.from_flat(docs))


FLAT_SQL = rf"""
with {_LINE_SQL},
b as (
  select doc_id, k, case k % 4 when 0 then 'paragraph' when 1 then 'image' when 2 then 'table' else 'title' end as block_type,
    case k % 4 when 1 then 0 when 2 then length(trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&#39;', ''''), '<[^>]+>', '', 'g'), '[ \t\r\n\f\x0B]+', ' ', 'g'))) else length(t) end as chars,
    case when k % 4 = 1 then 1 else 0 end as images, case when k % 4 = 3 then 1 end as level from l)
select doc_id, block_type, count(*) as n, cast(sum(chars) as bigint) as chars, cast(sum(images) as bigint) as images, cast(max(k // 10 + 1) as integer) as last_page, cast(coalesce(sum(level), 0) as bigint) as levels from b group by 1, 2
"""


def text_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of text layers, where some lines read like titles."""
    made = F.transform("parts", lambda t, k: F.when(k % 5 == 0, F.concat(F.lit("第"), (k + 1).cast("string"), F.lit("章 "), t)).when(k % 5 == 1, F.concat(t, F.lit("通知"))).when(k % 5 == 2, F.concat(F.lit("济政发"), t)).otherwise(t))
    pages = F.transform(F.sequence(F.lit(0), F.ceil(F.size("parts") / 8) - 1), lambda i: F.slice(made, (i * 8 + 1).cast("int"), 8))
    return _counts(B.from_text_layer(_lines(table(spark, sf_dir, "documents")).select("doc_id", pages.alias("pages"))))


LAYERS_SQL = f"""
with {_LINE_SQL},
b as (select doc_id, k, case when k % 5 <= 2 then 'title' else 'paragraph' end as block_type, length(t) + case k % 5 when 0 then 3 + length(cast(k + 1 as varchar)) when 1 then 2 when 2 then 3 else 0 end as chars, case when k % 5 <= 2 then 1 end as level from l)
select doc_id, block_type, count(*) as n, cast(sum(chars) as bigint) as chars, cast(0 as bigint) as images, cast(max(k // 8 + 1) as integer) as last_page, cast(coalesce(sum(level), 0) as bigint) as levels from b group by 1, 2
"""


def parse_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two parses of a document the better one, and whether it is as good as empty."""
    whole = B.exploded(B.from_pages(_pages(table(spark, sf_dir, "documents"))))
    both = whole.withColumn("file", F.lit("a.json")).unionByName(whole.where("ord % 2 = 0").withColumn("file", F.lit("b.json")))
    rows = B.parse_statistics(both).where("best")
    return rows.select("doc_id", "file", "blocks", "texts", "chars", B.parse_is_trivial(F.col("blocks"), F.col("texts"), F.col("chars")).alias("trivial"), B.output_is_trivial(F.col("chars"), F.lit(None).cast("long")).alias("output_trivial"))


CHOICE_SQL = f"""
with {_BLOCKS},
c as (select doc_id, count(*) as blocks, count(*) filter (block_type in ('title', 'paragraph')) as texts, cast(sum(case when block_type = 'table' then 0 else chars end) as bigint) as chars from b group by 1)
select doc_id, 'a.json' as file, blocks, texts, chars, case when blocks < 3 then 'few blocks' when texts = 0 then 'no text blocks' when chars < 50 then 'few characters' end as trivial, chars < 100 as output_trivial from c
"""


def plain_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every block as the plain text that an outside model is given."""
    rows = B.from_pages(_pages(table(spark, sf_dir, "documents"))).select("doc_id", F.posexplode("blocks").alias("ord", "b"))
    return rows.select("doc_id", "ord", F.md5(X.plain_text(F.col("b")).cast("binary")).alias("text_md5"))


PLAIN_SQL = f"""
with {_LINE_SQL},
b as (
  select doc_id, k, 0 as i, case k % 7 when 0 then '## ' || t when 1 then t || '$x' || k || '$' when 2 then '' when 3 then cast(k as varchar) when 4 then t else '## 3.2 ' || t end as text from l where k % 7 <> 5
  union all select doc_id, k, 1, 'second' from l where k % 7 = 4)
select doc_id, cast(row_number() over (partition by doc_id order by k, i) - 1 as integer) as ord, md5(text) as text_md5 from b
"""

# --- zones -----------------------------------------------------------------------------------------

_ZONED = "select doc_id, 'w' || repeat(md5(text), cast(1 + doc_id % 3 as integer)) as p from documents"


def protected_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones of texts with formulas and of texts with a table: spans, parts, cuts and tails."""
    p = F.concat(F.lit("w"), F.expr("repeat(md5(cast(text as binary)), cast(1 + doc_id % 3 as int))"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length(p).alias("n"), F.concat(p, F.lit(" $a+b$ and $$c\n= d$$ end")).alias("f"), F.concat(p, F.lit("\n| a | b |\n|---|---|\n| 1 | 2 |\nend")).alias("t"))
    n = F.col("n")
    rows = docs.select("doc_id", "n", "f", "t", zones.zone_spans("f").alias("formulas"), zones.zone_spans("t").alias("tables"), zones.zone_parts("f").alias("parts"))
    spans = lambda c: F.array_join(F.transform(c, lambda z: F.concat_ws("-", z["begin"].cast("string"), z["end"].cast("string"))), " ")
    return rows.select(
        "doc_id", spans("formulas").alias("formulas"), spans("tables").alias("tables"), F.array_join(F.transform("parts", lambda s: F.concat(F.when(s["atomic"], "!").otherwise(""), F.length(s["text"]).cast("string"))), " ").alias("parts"),
        zones.safe_position("f", n + 3).alias("early_cut"), zones.safe_position("f", n + 5).alias("late_cut"), zones.safe_position("t", n + 30).alias("table_cut"), zones.safe_position("f", n).alias("free_cut"),
        zones.safe_tail("f", F.lit(20)).alias("cut_tail"), zones.safe_tail("f", F.lit(12)).alias("whole_tail"), zones.in_zone(n + 1, F.col("formulas")).alias("inside"), zones.in_zone(n + 6, F.col("formulas")).alias("outside"),
    )


ZONES_SQL = f"""
with z as (select doc_id, cast(length(p) as integer) as n from ({_ZONED}))
select doc_id, (n + 1) || '-' || (n + 6) || ' ' || (n + 11) || '-' || (n + 20) as formulas, n || '-' || (n + 31) as tables, (n + 1) || ' !5 5 !9 4' as parts, n + 1 as early_cut, n + 6 as late_cut, n + 31 as table_cut, n as free_cut,
  'b' as cut_tail, '$c' || chr(10) || '= d$$ end' as whole_tail, true as inside, false as outside from z
"""


def zone_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences packed to 200 characters around a formula of 152, which no chunk cuts; 40 characters are carried over."""
    one = F.concat(F.lit("w"), F.md5(F.col("text").cast("binary")), F.lit(". "))
    made = F.concat(F.repeat(one, (F.col("doc_id") % 9 + 4).cast("int")), F.lit("$"), F.repeat(F.lit("x"), F.lit(150)), F.lit("$"), F.repeat(F.concat(F.lit(" "), F.rtrim(one)), (F.col("doc_id") % 5 + 3).cast("int")))
    docs = table(spark, sf_dir, "documents").select("doc_id", made.alias("text"))
    chunks = chunking.chunk_documents(B.from_lines(docs), "sentence", CONFIG.updated(split_target=200, overlap=40))
    return chunks.select("doc_id", "chunk_no", "char_count", "is_split", F.contains("body", F.concat(F.lit("$"), F.repeat(F.lit("x"), F.lit(150)), F.lit("$"))).alias("has_formula"))


ZONE_PACKING_SQL = """
with recursive d as (select doc_id, cast(doc_id % 9 + 4 as integer) as a, cast(doc_id % 5 + 3 as integer) as b from documents),
q as (
  select doc_id, unnest(range(a + 1)) as i, unnest(list_transform(range(a + 1), lambda j: case when j = 0 then 34 when j < a then 35 else 1 end)) as n, false as atomic from d
  union all select doc_id, a + 1, 152, true from d
  union all select doc_id, unnest(range(a + 2, a + 2 + b)), 35, false from d),
k as (
  select doc_id, i, n as chars, n as para, 0 as c, atomic from q where i = 0
  union all
  select q.doc_id, q.i, case when not q.atomic and k.chars + q.n > 200 then least(40, k.para) + q.n else k.chars + q.n end, case when not q.atomic and k.chars + q.n > 200 then q.n else k.para + q.n end,
    case when not q.atomic and k.chars + q.n > 200 then k.c + 1 else k.c end, q.atomic
  from k join q on q.doc_id = k.doc_id and q.i = k.i + 1)
select doc_id, cast(c + 1 as integer) as chunk_no, cast(max(chars) as integer) as char_count, max(max(c)) over (partition by doc_id) > 0 as is_split, bool_or(atomic) as has_formula from k group by doc_id, c
"""

# --- regions and tables ----------------------------------------------------------------------------


def _sized(k: int) -> Column:
    """A paragraph of 33 characters, or of 561 in every second document."""
    return F.concat(F.lit(f"w{k} "), F.repeat(F.md5(F.col("text").cast("binary")), F.when(F.col("doc_id") % 2 == 1, 17).otherwise(1)))


def _standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the lines of a standard."""
    lines = [_sized(0), "目录", "1 Scope ....... 1", "2 Terms …… 2", "前言", _sized(1), "1 总则", _sized(2), "附录 A 说明", _sized(3), "1.1 first", _sized(4), "1.2 second", _sized(5), "参考文献", _sized(6), _sized(7), _sized(8)]
    text = F.concat_ws("\n", *(F.lit(x) if isinstance(x, str) else x for x in lines))
    return B.from_lines(table(spark, sf_dir, "documents").select("doc_id", text.alias("text")))


def long_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regions of the same documents, from rows of blocks: their blocks, first and last, and the text in them."""
    rows = B.exploded(_standard(spark, sf_dir))
    found = longdocs.with_regions(rows, longdocs.region_intervals(rows))
    return found.groupBy("doc_id", "region_no", F.col("region_kind").alias("kind"), F.col("region_title").alias("title")).agg(F.count("*").alias("blocks"), F.min("ord").alias("first"), F.max("ord").alias("last"), F.sum(F.length("text")).alias("chars"))


LONG_REGIONS_SQL = """
with d as (select doc_id, repeat(md5(text), case when doc_id % 2 = 1 then 17 else 1 end) as m from documents),
r as (select * from (values (1, 'cover', '封面', 1, 0, 1, 0), (2, 'toc', '目录', 3, 1, 0, length('目录1 Scope ....... 12 Terms …… 2')), (3, 'preface', '前言', 2, 4, 1, length('前言')), (4, 'body', '', 2, 6, 1, length('1 总则')),
  (5, 'appendix', '附录 A 说明', 6, 8, 3, length('附录 A 说明1.1 first1.2 second')), (6, 'reference', '参考文献', 4, 14, 3, length('参考文献'))) t(region_no, kind, title, blocks, first, texts, fixed))
select doc_id, region_no, kind, title, cast(blocks as bigint) as blocks, first, first + blocks - 1 as last, cast(fixed + texts * (3 + length(m)) as bigint) as chars from d cross join r
"""


def region_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A standard's regions: cover, contents with entries, preface, body, an appendix that is too large in every second document, references."""
    chunks = chunking.chunk_documents(_standard(spark, sf_dir), "structure", CONFIG)
    return chunks.select("doc_id", "chunk_no", "region_no", "chunk_type", "title_path", "char_count", "is_split", F.md5(F.col("body").cast("binary")).alias("body_md5"))


REGION_SQL = """
with d as (select doc_id, doc_id % 2 = 1 as big, repeat(md5(text), case when doc_id % 2 = 1 then 17 else 1 end) as m from documents),
c as (
  select doc_id, big, 1 as pos, 1 as region_no, 'cover' as chunk_type, '封面' as title_path, false as is_split, 'w0 ' || m || chr(10) as body, ['w0 ' || m] as texts from d
  union all select doc_id, big, 2, 2, 'toc', '目录', false, '# 目录' || chr(10) || chr(10) || '# 1 Scope ....... 1' || chr(10) || chr(10) || '# 2 Terms …… 2' || chr(10), ['目录', '1 Scope ....... 1', '2 Terms …… 2'] from d
  union all select doc_id, big, 3, 3, 'preface', '前言', false, '# 前言' || chr(10) || chr(10) || 'w1 ' || m || chr(10), ['前言', 'w1 ' || m] from d
  union all select doc_id, big, 4, 4, 'body', '1 总则', false, 'w2 ' || m || chr(10), ['w2 ' || m] from d
  union all select doc_id, big, 5, 5, 'appendix', '附录 A 说明', false, 'w3 ' || m || chr(10) || chr(10) || '## 1.1 first' || chr(10) || chr(10) || 'w4 ' || m || chr(10) || chr(10) || '## 1.2 second' || chr(10) || chr(10) || 'w5 ' || m || chr(10), ['w3 ' || m, '1.1 first', 'w4 ' || m, '1.2 second', 'w5 ' || m] from d where not big
  union all select doc_id, big, 5, 5, 'appendix', '附录 A 说明 > 1.1 first', false, 'w3 ' || m || chr(10) || chr(10) || 'w4 ' || m || chr(10), ['w3 ' || m, 'w4 ' || m] from d where big
  union all select doc_id, big, 6, 5, 'appendix', '附录 A 说明 > 1.2 second', false, 'w5 ' || m || chr(10), ['w5 ' || m] from d where big
  union all select doc_id, big, 7, 6, 'reference', '参考文献', false, 'w6 ' || m || chr(10) || chr(10) || 'w7 ' || m || chr(10) || chr(10) || 'w8 ' || m || chr(10), ['w6 ' || m, 'w7 ' || m, 'w8 ' || m] from d where not big
  union all select doc_id, big, 7, 6, 'reference', '参考文献 (part 1)', true, chr(10) || 'w6 ' || m || chr(10) || chr(10) || 'w7 ' || m || chr(10), ['w6 ' || m, 'w7 ' || m] from d where big
  union all select doc_id, big, 8, 6, 'reference', '参考文献 (part 2)', true, chr(10) || 'w8 ' || m || chr(10), ['w8 ' || m] from d where big)
select doc_id, cast(row_number() over (partition by doc_id order by pos) as integer) as chunk_no, region_no, chunk_type, title_path, cast(list_sum(list_transform(texts, lambda x: length(x))) as integer) as char_count, is_split, md5(title_path || chr(10) || body) as body_md5 from c
"""


def repeated_covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standards whose cover comes again: before the explanations, which it opens as an appendix, and in the preface, which goes without it."""
    cover = "中国工程建设标准化协会标准"
    kind = lambda name, **c: F.struct(F.lit(name).alias("type"), F.struct(*(v.alias(k) for k, v in c.items())).alias("content"))
    no_runs, m = F.lit(None).cast("array<struct<type:string,content:string>>"), F.md5(F.col("text").cast("binary"))
    title = lambda t: kind("title", level=F.lit(1), title_content=_runs(t if not isinstance(t, str) else F.lit(t)), paragraph_content=no_runs)
    para = lambda p: kind("paragraph", level=F.lit(None).cast("int"), title_content=no_runs, paragraph_content=_runs(F.concat(F.lit(p + " "), m)))
    name = F.concat(F.lit("Name "), m)
    page = F.array(title(cover), title(name), title("前言"), title(name), para("why"), title("1 总则"), para("body"), title(cover), title(name), para("explained"), title("参考文献"), para("one"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.array(page)).alias("json"))
    chunks = chunking.chunk_documents(B.from_pages(docs), "structure", CONFIG)
    return chunks.select("doc_id", "chunk_no", "chunk_type", "title_path", F.md5(F.col("body").cast("binary")).alias("body_md5"), F.contains("body", F.lit("Name ")).alias("named"))


COVERS_SQL = """
with d as (select doc_id, md5(text) as m, chr(10) as n from documents),
c as (
  select doc_id, 1 as chunk_no, 'cover' as chunk_type, '封面' as title_path, '# 中国工程建设标准化协会标准' || n || n || '# Name ' || m || n as body from d
  union all select doc_id, 2, 'preface', '前言', '# 前言' || n || n || 'why ' || m || n from d
  union all select doc_id, 3, 'body', '1 总则', 'body ' || m || n from d
  union all select doc_id, 4, 'appendix', '中国工程建设标准化协会标准', '# 中国工程建设标准化协会标准' || n || n || '# Name ' || m || n || n || 'explained ' || m || n from d
  union all select doc_id, 5, 'reference', '参考文献', 'one ' || m || n from d)
select doc_id, cast(chunk_no as integer) as chunk_no, chunk_type, title_path, md5(title_path || chr(10) || body) as body_md5, contains(body, 'Name ') as named from c
"""


def table_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of the documents' lines as chunks of at most 20 rows beside their chapter's text, with keywords."""
    cells = F.transform("parts", lambda p, k: F.concat(F.lit("<tr><td>"), k.cast("string"), F.lit("</td><td>"), F.length(p).cast("string"), F.lit("</td></tr>")))
    html = F.concat(F.lit("<table><thead><tr><th>k</th><th>n</th></tr></thead>"), F.array_join(cells, ""), F.lit("</table>"))
    kind = lambda name, **c: F.struct(F.lit(name).alias("type"), F.struct(*(v.alias(k) for k, v in c.items())).alias("content"))
    none, no_runs = F.lit(None), F.lit(None).cast("array<struct<type:string,content:string>>")
    block = lambda name, level=none, title=no_runs, para=no_runs, html=none, cap=no_runs, foot=no_runs: kind(name, level=level.cast("int"), title_content=title, paragraph_content=para, html=html.cast("string"), table_caption=cap, table_footnote=foot)
    page = F.array(block("title", F.lit(1), _runs(F.lit("1 Tables"))), block("paragraph", para=_runs(F.concat(F.lit("w"), F.md5(F.array_join("parts", "\n").cast("binary"))))), block("table", html=html, cap=_runs(F.lit("Cap")), foot=_runs(F.lit("Foot"))))
    docs = _lines(table(spark, sf_dir, "documents")).select("doc_id", F.to_json(F.array(page)).alias("json"))
    chunks = chunking.chunk_documents(B.from_pages(docs), "structure", CONFIG)
    return chunks.select("doc_id", "chunk_no", "chunk_type", "title_path", "table_name", "char_count", "is_split", F.array_join(G.keywords(F.col("chunk_type"), F.col("table_name")), ",").alias("keywords"), F.md5(F.col("body").cast("binary")).alias("body_md5"))


TABLE_CHUNKS_SQL = f"""
with {_LINE_SQL},
r as (select doc_id, k, k // 20 as part, '<tr><td>' || k || '</td><td>' || length(t) || '</td></tr>' as cell from l),
n as (select doc_id, part, parts, parts > 1 as is_split, 'Cap' || case when parts > 1 then ' (part ' || (part + 1) || '/' || parts || ')' else '' end as name, '<table><thead><tr><th>k</th><th>n</th></tr></thead>' || cells || '</table>' as html from (select doc_id, part, cells, max(part) over (partition by doc_id) + 1 as parts from (select doc_id, part, string_agg(cell, '' order by k) as cells from r group by doc_id, part))),
b as (select *, '1 Tables > ' || name || chr(10) || case when is_split then chr(10) else '' end || '**' || name || '**' || chr(10) || chr(10) || html || case when part = parts - 1 then chr(10) || chr(10) || chr(10) || '*Foot*' else '' end || chr(10) as body from n)
select doc_id, cast(part + 2 as integer) as chunk_no, 'table' as chunk_type, '1 Tables > ' || name as title_path, name as table_name, cast(length(body) as integer) as char_count, is_split, 'table,' || name as keywords, md5(body) as body_md5 from b
union all select doc_id, 1, 'body', '1 Tables', null, 33, false, null, md5('1 Tables' || chr(10) || 'w' || md5(text) || chr(10)) from documents
"""

# --- vectors and outside answers -------------------------------------------------------------------


def _vector_docs(spark: SparkSession, sf_dir: str, whole: bool) -> DataFrame:
    """Vectors 64 at a time as a document's sentences, through the contract with an embedding service; some answers lack a vector."""
    v = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 64).alias("doc_id"), "vec_id", "embedding")
    first = F.col("vec_id") % 64 == 0
    texts = v.select("doc_id", F.col("vec_id").alias("ord"), F.concat(F.when(first, "").otherwise(" "), F.lit("Sentence "), F.col("vec_id").cast("string"), F.lit(".")).alias("text"), "embedding")
    docs = texts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("s")).select("doc_id", F.array_join("s.text", "").alias("text"), F.array_join("s.text", " ").alias("joined"))
    if whole:  # the vector of a whole text is that of its first sentence
        texts = texts.unionByName(docs.select("doc_id", F.lit(-1).cast("long").alias("ord"), F.col("joined").alias("text")).join(v.where(first).select("doc_id", "embedding"), "doc_id"))
    batches = embeddings.requests(texts)
    place = F.row_number().over(_in_order())
    answers = texts.withColumn("batch_no", F.floor((place - 1) / 20).cast("int")).where("doc_id % 5 <> 4 or ord <> doc_id * 64 + 1").groupBy("doc_id", "batch_no").agg(F.array_sort(F.collect_list(F.struct("ord", "embedding"))).alias("a"))
    one, two = F.to_json(F.struct(F.transform("a", lambda x: F.struct(x["embedding"].alias("embedding"))).alias("data"))), F.to_json(F.struct(F.col("a.embedding").alias("embeddings")))
    responses = answers.select("doc_id", "batch_no", F.when(F.col("doc_id") % 2 == 0, one).otherwise(two).alias("response"))
    found = embeddings.sentence_vectors(embeddings.complete(batches, responses))
    return B.from_lines(docs).join(found, "doc_id", "left")


def _in_order():
    from pyspark.sql import Window

    return Window.partitionBy("doc_id").orderBy("ord")


VECTORS = CONFIG.updated(semantic_threshold=0.3, target_chars=200, split_target=150, overlap=20)


def semantic_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by breaks between neighbouring sentences; documents without all vectors by sentences."""
    return chunking.chunk_documents(_vector_docs(spark, sf_dir, False), "semantic", VECTORS).select("doc_id", "chunk_no", "char_count", "is_split", F.md5(F.col("body").cast("binary")).alias("body_md5"))


def late_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by breaks before sentences unlike the whole text; documents without all vectors by sentences."""
    return chunking.chunk_documents(_vector_docs(spark, sf_dir, True), "late_chunking", VECTORS).select("doc_id", "chunk_no", "char_count", "is_split", F.md5(F.col("body").cast("binary")).alias("body_md5"))


def _vector_sql(breaks: str) -> str:
    return f"""
with recursive e as (select vec_id // 64 as doc_id, vec_id % 64 as i, vec_id, cast(embedding as double[]) as v, case when vec_id % 64 = 0 then '' else ' ' end || 'Sentence ' || vec_id || '.' as t from embeddings),
m as (select doc_id, count(*) as sentences from e group by 1),
s as (select e.*, m.sentences, length(t) as n, (e.doc_id % 5 <> 4 or m.sentences < 2) and m.sentences >= 2 as with_vectors from e join m using (doc_id)),
b as (select s.*, coalesce({breaks}, false) as brk from s left join e p on p.doc_id = s.doc_id and p.i = s.i - 1 left join e f on f.doc_id = s.doc_id and f.i = 0),
k as (
  select doc_id, i, n as chars, n as para, 0 as c, '' as lead from b where i = 0
  union all
  select b.doc_id, b.i,
    case when b.with_vectors then case when b.brk or k.chars + b.n > 200 then b.n else k.chars + b.n end else case when k.chars + b.n > 150 then least(20, k.para) + b.n else k.chars + b.n end end,
    case when not b.with_vectors and k.chars + b.n > 150 then b.n else k.para + b.n end,
    case when case when b.with_vectors then b.brk or k.chars + b.n > 200 else k.chars + b.n > 150 end then k.c + 1 else k.c end, ''
  from k join b on b.doc_id = k.doc_id and b.i = k.i + 1),
g as (select k.doc_id, k.c, max(k.chars) as chars, string_agg(b.t, '' order by k.i) as own, bool_or(b.with_vectors) as with_vectors from k join b using (doc_id, i) group by 1, 2),
w as (select *, count(*) over (partition by doc_id) as pieces, lag(own) over (partition by doc_id order by c) as before from g)
select doc_id, cast(c + 1 as integer) as chunk_no, cast(chars as integer) as char_count, pieces > 1 as is_split,
  md5(case when not with_vectors and pieces > 1 then ' (part ' || (c + 1) || ')' else '' end || chr(10) || case when pieces > 1 then chr(10) else '' end || case when not with_vectors and c > 0 then right(before, 20) || chr(10) || chr(10) else '' end || own || chr(10)) as body_md5 from w
"""


SEMANTIC_STRATEGY_SQL = _vector_sql("list_cosine_similarity(p.v, s.v) < 0.3")
LATE_STRATEGY_SQL = _vector_sql("list_cosine_similarity(f.v, s.v) < 0.3")


def answer_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that an outside model chose, from fenced answers, each piece as it was given, blank ones too; where the answer is no list, by structure."""
    answer = F.when(F.col("doc_id") % 5 == 0, F.lit("I cannot do that.")).otherwise(F.concat(F.lit("```json\n"), F.to_json("parts"), F.lit("\n```")))
    docs = _lines(table(spark, sf_dir, "documents")).select("doc_id", X.json_strings(answer).alias("pieces"), F.concat(F.lit("w"), F.md5(F.array_join("parts", "\n").cast("binary"))).alias("text"))
    chunks = chunking.chunk_documents(B.from_lines(docs).join(docs.select("doc_id", "pieces"), "doc_id"), "llm", CONFIG, whole_pieces=True)
    return chunks.select("doc_id", "chunk_no", "char_count", "is_split", F.md5(F.col("body").cast("binary")).alias("body_md5"))


ANSWER_SQL = f"""
with {_LINE_SQL}, n as (select *, count(*) over (partition by doc_id) as pieces from l where doc_id % 5 <> 0)
select doc_id, cast(k + 1 as integer) as chunk_no, cast(length(t) as integer) as char_count, pieces > 1 as is_split, md5(chr(10) || case when pieces > 1 then chr(10) else '' end || rtrim(t) || chr(10)) as body_md5 from n
union all select doc_id, 1, 33, false, md5(chr(10) || 'w' || md5(text) || chr(10)) from documents where doc_id % 5 = 0
"""


def queries() -> dict:
    found = (parsed_pages, flat_list, text_layers, parse_choice, plain_blocks, protected_zones, zone_packing, region_chunks, long_regions, repeated_covers, table_chunks, semantic_strategy, late_strategy, answer_pieces)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "parsed_pages": PAGES_SQL, "flat_list": FLAT_SQL, "text_layers": LAYERS_SQL, "parse_choice": CHOICE_SQL, "plain_blocks": PLAIN_SQL, "protected_zones": ZONES_SQL, "zone_packing": ZONE_PACKING_SQL, "region_chunks": REGION_SQL, "long_regions": LONG_REGIONS_SQL, "repeated_covers": COVERS_SQL,
        "table_chunks": TABLE_CHUNKS_SQL, "semantic_strategy": SEMANTIC_STRATEGY_SQL, "late_strategy": LATE_STRATEGY_SQL, "answer_pieces": ANSWER_SQL,
    }
