"""Queries over ``pages``: addresses, links, Markdown, overlays, update detection and crawls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary import runtime
from granary.functions import html as H
from granary.functions import text as X
from granary.operators import crawl as C
from granary.operators import ledger as L
from granary.plans.documents import table


def normalized_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", X.normalize_url(url).alias("normal"), X.url_ext(F.concat(url, F.lit(""))).alias("ext"), X.title_from_url(url).alias("title"), X.host_key(url).alias("host"), C.url_denied(url, ["example.com"]).alias("denied"))


URL_SQL = r"""
with u as (select page_id, url, regexp_extract(url, '^[^:]+://([^/?#]*)', 1) as h, regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1) as p, regexp_extract(url, '\?([^#]*)', 1) as q, lower(regexp_extract(url, '^([^:]+)://', 1)) as s from pages),
t as (select *, regexp_replace(list_last(string_split(regexp_replace(p, '/+$', ''), '/')), '(?i)\.(html?|php|aspx?|jsp|shtml)$', '') as last from u)
select page_id, s || '://' || lower(h) || case when p = '' then '/' else p end || case when q <> '' then '?' || q else '' end as normal,
  lower(regexp_extract(list_last(string_split(regexp_replace(p, '/+$', ''), '/')), '[^.](\.[^.]+)$', 1)) as ext, case when last <> '' then last else h end as title,
  regexp_replace(lower(h), '^www\.', '') as host, case when regexp_replace(lower(h), '^www\.', '') = 'example.com' or ends_with(lower(h), '.example.com') then null else 'not allowed' end as denied
from t
"""


def visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = X.strip_tags(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.length(text).alias("chars"), F.md5(text.cast("binary")).alias("text_md5"), F.md5(F.col("html").cast("binary")).alias("content_hash"), X.charset(F.lit(None).cast("string"), F.col("html")).alias("charset"))


VISIBLE_SQL = r"""
with e as (select page_id, html, html as h from pages),
r as (select page_id, html, replace(replace(replace(replace(replace(replace(replace(h, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&#39;', '''') as h from e),
t as (select page_id, html, trim(regexp_replace(regexp_replace(h, '<[^>]+>', '', 'g'), '[ \t\r\n\f\x0B]+', ' ', 'g')) as t from r)
select page_id, cast(length(t) as integer) as chars, md5(t) as text_md5, md5(html) as content_hash, lower(coalesce(nullif(regexp_extract(html, '(?i)charset\s*=\s*["'']?([A-Za-z0-9_-]+)', 1), ''), 'utf-8')) as charset from t
"""


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of every page, absolute and normal, in their order."""
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(H.page_links("html", "url")).alias("ord", "link"))


LINKS_SQL = r"""
with a as (select page_id, url, unnest(regexp_extract_all(html, '<a[^>]* href="([^"]*)"', 1)) as href, unnest(range(len(regexp_extract_all(html, '<a[^>]* href="([^"]*)"', 1)))) as k from pages),
b as (select *, regexp_extract(url, '^([^:]+://[^/?#]*)', 1) as root from a where href <> ''),
c as (select page_id, k, regexp_replace(case when regexp_matches(href, '^https?://') then href when starts_with(href, '/') then root || href else null end, '#.*$', '') as link from b),
d as (select page_id, min(k) as k, case when regexp_matches(link, '^https?://[^/?]*$') then link || '/' else link end as link from c where link is not null group by page_id, 3)
select page_id, cast(row_number() over (partition by page_id order by k) - 1 as integer) as ord, link from d
"""


def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and Markdown of every page, without its overlays."""
    return table(spark, sf_dir, "pages").select("page_id", H.html_to_markdown("html", "url").alias("m")).select("page_id", "m.title", "m.markdown")


_TIDY = r"""
select page_id, title, replace(replace(replace(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(b, '[ \t\r\n\f\x0B]+', ' ', 'g'), '[ \x01\x02]*\x02[ \x01\x02]*', chr(10) || chr(10), 'g'), '[ \x01]*\x01[ \x01]*', chr(10), 'g'), '^\n+|\n+$', '', 'g')), '&quot;', '"'), '&lt;', '<'), '&amp;', '&') as markdown from m
"""
_TITLE = r"""replace(replace(trim(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '[ \t\r\n\f\x0B]+', ' ', 'g')), '&quot;', '"'), '&amp;', '&')"""
MARKDOWN_SQL = rf"""
with a as (select page_id, {_TITLE} as title, regexp_extract(html, '(?s)<article>(.*)</article>', 1) as a from pages),
m as (select page_id, title, replace(replace(replace(replace(regexp_replace(a, '</?p>', chr(2), 'g'), '<h1>', chr(2) || '# '), '</h1>', chr(2)), '<br>', chr(1)), '<b>', '**') as b from a)
{_TIDY}
"""


def simple_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and plain Markdown of every page: no emphasis, and nothing is taken for an overlay."""
    return table(spark, sf_dir, "pages").select("page_id", H.html_to_simple_markdown("html").alias("m")).select("page_id", "m.title", "m.markdown")


SIMPLE_SQL = rf"""
with a as (select page_id, {_TITLE} as title, regexp_extract(html, '(?s)</nav>(.*)<footer>', 1) as a from pages),
m as (select page_id, title, regexp_replace(replace(replace(replace(regexp_replace(regexp_replace(a, '<!--.*?-->|</article>', '', 'g'), '</?p>', chr(2), 'g'), '<h1>', chr(2) || '# '), '</h1>', chr(2)), '<br>', chr(1)), '</?(div|article|b)[^>]*>', chr(3), 'g') as b3 from a),
m2 as (select page_id, title, replace(b3, chr(3), '') as b from m)
{_TIDY.replace("from m", "from m2")}
"""


def page_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When pages changed: as declared, else as published, else by the first date in the text."""
    meta = lambda name, value: F.concat(F.lit(f'<meta property="{name}" content="'), value, F.lit('">'))
    day = F.concat(F.lit("2024-03-"), F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0"))
    head = F.when(F.col("page_id") % 4 == 0, F.concat(meta("article:published_time", F.lit("2020-01-01")), meta("article:modified_time", F.concat(day, F.lit("T07:08:09Z"))))).when(F.col("page_id") % 4 == 1, meta("article:published_time", day)).otherwise(F.lit(""))
    text = F.when(F.col("page_id") % 4 == 2, F.concat(F.lit("on 2023/"), (F.col("page_id") % 12 + 1).cast("string"), F.lit("/5 it was")))
    return table(spark, sf_dir, "pages").select("page_id", H.page_changed(F.concat(head, "html"), text).alias("changed"))


TIMES_SQL = """
select page_id, case page_id % 4 when 0 then printf('2024-03-%02d 07:08', page_id % 28 + 1) when 1 then printf('2024-03-%02d', page_id % 28 + 1) when 2 then printf('2023-%02d-05', page_id % 12 + 1) end as changed from pages
"""


def stripped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without overlays, and sanitised."""
    kept = H.strip_overlays("html")
    return table(spark, sf_dir, "pages").select("page_id", F.length("html").alias("before"), kept.alias("kept")).select("page_id", "before", F.length("kept").alias("after"), F.length(X.sanitize_html(F.col("kept"))).alias("sanitized"))


STRIPPED_SQL = r"""
with k as (select page_id, html, regexp_replace(html, '<div class="ad">[^<]*</div>', '', 'g') as kept from pages)
select page_id, cast(length(html) as integer) as before, cast(length(kept) as integer) as after, cast(length(regexp_replace(kept, '(?s)<script>.*?</script>|<style>.*?</style>|<meta[^>]*>', '', 'g')) as integer) as sanitized from k
"""


def page_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First date of a text made of the page's number."""
    made = F.concat(F.lit("x 20"), F.lpad((F.col("page_id") % 30).cast("string"), 2, "0"), F.lit("年"), (F.col("page_id") % 14).cast("string"), F.lit("月"), (F.col("page_id") % 33).cast("string"), F.lit("日 "), (F.col("page_id") % 26).cast("string"), F.lit(":05"))
    return table(spark, sf_dir, "pages").select("page_id", X.first_date(made).alias("day"), X.clamp((F.col("page_id") - 5).cast("string"), 0, 5, 2).alias("depth"))


DATES_SQL = """
select page_id, case when page_id % 14 between 1 and 12 and page_id % 33 between 1 and 31 then printf('20%02d-%02d-%02d', page_id % 30, page_id % 14, page_id % 33) || case when page_id % 26 <= 23 then printf(' %02d:05', page_id % 26) else '' end end as day,
  cast(greatest(0, least(5, page_id - 5)) as integer) as depth from pages
"""


def site_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether pages lie in the scope of the first page of their host, by column and by host."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", X.host_key(F.col("url")).alias("host"))
    seeds = pages.groupBy("host").agg(F.min_by("url", "page_id").alias("seed"))
    joined = pages.join(seeds, "host")
    link, seed = F.concat("url", F.lit("")), F.col("seed")
    return joined.select("page_id", X.site_scope(link, seed).alias("in_column"), X.site_scope(link, seed, "host").alias("in_host"), X.is_attachment(F.concat(X.normalize_url(link), F.lit("/a.PDF"))).alias("attachment"))


SCOPE_SQL = r"""
with u as (select page_id, url, regexp_replace(lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1)), '^www\.', '') as host, regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1) as p0, regexp_extract(url, '\?([^#]*)', 1) as q from pages),
v as (select *, case when p0 = '' then '/' else p0 end as p from u),
s as (select host, arg_min(p, page_id) as sp from v group by host),
w as (select *, rtrim(sp, '/') as root, rtrim(p, '/') as path from v join s using (host))
select page_id, root = '' or path = root or starts_with(path, root || '/') or starts_with(path, root || '_') as in_column, not ends_with(sp, '/') or root = '' or starts_with(p, root || '/') as in_host, q = '' as attachment from w
"""


def changed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages against what was ingested last: every third record is newer and differs."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.md5(F.col("html").cast("binary")).alias("content_hash"))
    ingested = pages.select((F.col("page_id") * 2).alias("id"), "url", "content_hash").unionByName(pages.where("page_id % 3 = 0").select((F.col("page_id") * 2 + 1).alias("id"), "url", F.lit("old").alias("content_hash"))).where("id % 10 <> 8")
    return L.changed_pages(pages.select("page_id", "url", "content_hash"), ingested).select("page_id", "prev_hash", "unchanged")


CHANGED_SQL = """
with p as (select page_id, url, md5(html) as h from pages),
i as (select page_id * 2 as id, url, h from p union all select page_id * 2 + 1, url, 'old' from p where page_id % 3 = 0),
l as (select url, arg_max(h, id) as prev_hash from i where id % 10 <> 8 group by url)
select page_id, prev_hash, coalesce(h = prev_hash, false) as unchanged from p left join l using (url)
"""


def overlay_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by the words of their containers' classes, and whether one is that of an overlay."""
    classes = F.explode(F.regexp_extract_all("html", F.lit(r'<div[^>]* class="([^"]*)"'), F.lit(1)))
    rows = table(spark, sf_dir, "pages").select("page_id", classes.alias("c")).select("page_id", F.explode(X.container_tokens(F.col("c"))).alias("word"))
    overlay = F.col("word").isin(*sorted(H.OVERLAYS))
    return rows.groupBy("word").agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("pages"), F.bool_or(overlay).alias("overlay"))


WORDS_SQL = r"""
with c as (select page_id, unnest(regexp_extract_all(html, '<div[^>]* class="([^"]*)"', 1)) as c from pages),
w as (select page_id, unnest(string_split_regex(lower(regexp_replace(regexp_replace(c, '[-_]+', ' ', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[ \t\r\n\f\x0B]+')) as word from c)
select word, count(*) as n, count(distinct page_id) as pages, word in ('modal', 'popup', 'dialog', 'toast', 'mask', 'overlay', 'drawer', 'ad', 'ads', 'adv', 'adsbygoogle', 'qrcode', 'layer') as overlay from w where word <> '' group by word
"""


# Elements, whether their text is part of a page's Markdown, and whether they stay when overlays go.
_ELEMENTS = [
    ('<div style="Position : fixed">inner</div>', False, False), ('<section style="display: NONE">inner</section>', False, True), ('<div style="visibility:hidden">inner</div>', False, True), ('<div style="color:red">inner</div>', True, True),
    ('<div id="aiModal">inner</div>', False, False), ('<ul class="site-nav"><li>inner</li></ul>', False, True), ('<div class="badge">inner</div>', True, True), ('<span class="ad">inner</span>', True, True), ('<div class="x popup_box"><p>inner</p></div>', False, False),
]


def noise_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements that are overlays or hidden by their names or style, in Markdown and in stripped pages."""
    made = F.concat(F.lit("<p>a</p>"), F.element_at(F.array(*(F.lit(e) for e, _, _ in _ELEMENTS)), (F.col("page_id") % len(_ELEMENTS) + 1).cast("int")), F.lit("<p>b</p>"))
    rows = table(spark, sf_dir, "pages").select("page_id", H.html_to_markdown(made, "url")["markdown"].alias("markdown"), H.strip_overlays(made).alias("kept"))
    return rows.select("page_id", F.contains("markdown", F.lit("inner")).alias("shown"), F.contains("kept", F.lit("inner")).alias("stays"), F.contains("markdown", F.lit("b")).alias("goes_on"))


NOISE_SQL = f"select page_id, {[s for _, s, _ in _ELEMENTS]}[page_id % {len(_ELEMENTS)} + 1] as shown, {[k for _, _, k in _ELEMENTS]}[page_id % {len(_ELEMENTS)} + 1] as stays, true as goes_on from pages"


def crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl from the first page over the links of all pages, two levels deep."""
    pages = table(spark, sf_dir, "pages")
    edges = runtime.materialize(pages.select(X.normalize_url(F.col("url")).alias("url"), F.posexplode(H.page_links("html", "url")).alias("ord", "link")), "edges")
    seeds = pages.orderBy("page_id").limit(3).select(F.col("url").alias("seed"), F.col("page_id").alias("ord"))
    return C.crawl(spark, seeds, edges, max_depth=2, max_pages=20, scope="host")


_STEP = r"""
  select url, 'x' as x, arg_min(seed, (src, place)) as seed, min((src, place)) as m
  from (select e.link as url, f.seed, f.ord as src, e.ord as place, regexp_extract(f.seed, '^[^:]+://[^/?#]*([^?#]*)', 1) as sp, regexp_extract(e.link, '^[^:]+://[^/?#]*([^?#]*)', 1) as lp
        from {frontier} f join edges e using (url)
        where regexp_extract(f.seed, '^[^:]+://([^/?#]*)', 1) = regexp_extract(e.link, '^[^:]+://([^/?#]*)', 1))
  where (not ends_with(sp, '/') or rtrim(sp, '/') = '' or starts_with(lp, rtrim(sp, '/') || '/')) and url not in (select url from {visited}) group by url
"""
CRAWL_SQL = rf"""
with links as ({LINKS_SQL}),
p as (select page_id, regexp_extract(url, '^([^:]+://[^/?#]*)', 1) || case when regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1) = '' then '/' else regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1) end || case when regexp_extract(url, '\?([^#]*)', 1) <> '' then '?' || regexp_extract(url, '\?([^#]*)', 1) else '' end as url from pages),
edges as (select p.url, l.link, l.ord from links l join p using (page_id)),
v0 as (select url, 0 as depth, url as seed, min(page_id) as ord from (select * from p order by page_id limit 3) group by url),
s1 as ({_STEP.format(frontier="v0", visited="v0")}),
v1 as (select url, 1 as depth, seed, (select count(*) from v0) + row_number() over (order by m, url) as ord from s1 qualify row_number() over (order by m, url) <= 20 - (select count(*) from v0)),
b1 as (select * from v0 union all select * from v1),
s2 as ({_STEP.format(frontier="v1", visited="b1")}),
v2 as (select url, 2 as depth, seed, (select count(*) from b1) + row_number() over (order by m, url) as ord from s2 qualify row_number() over (order by m, url) <= 20 - (select count(*) from b1))
select url, depth, seed, ord from b1 union all select url, depth, seed, ord from v2
"""


def crawl_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl of each site of 40 documents, all at once: lists of four details lead from page to page, details to their neighbours, back, out of the column, and to attachments."""
    doc = table(spark, sf_dir, "documents").select("doc_id")
    id_, host = F.col("doc_id"), F.format_string("https://s%d.example.org", F.expr("doc_id div 40"))
    n = F.expr("doc_id % 40 div 4 + 1")  # the list that names a document
    list_ = lambda k: F.concat(host, F.lit("/news/"), F.when(k > 1, F.concat(F.lit("?page="), k.cast("string"))).otherwise(F.lit("")))
    detail = lambda k: F.concat(host, F.lit("/news/d"), k.cast("string"), F.lit(".html"))
    edge = lambda url, link, place, where="true": doc.where(where).select(url.alias("url"), link.alias("link"), F.lit(place).cast("long").alias("ord") if isinstance(place, int) else place.alias("ord"))
    edges = (
        edge(list_(n), detail(id_), (id_ % 4).cast("long") * 2).unionByName(edge(list_(n), list_(n + 1), 3, "doc_id % 4 = 0"))
        .unionByName(edge(list_(n), F.concat(host, F.lit("/files/l"), n.cast("string"), F.lit(".pdf")), 9, "doc_id % 12 = 0"))
        .unionByName(edge(detail(id_), detail(id_ + 1), 1, "doc_id % 40 < 39")).unionByName(edge(detail(id_), list_(n), 2)).unionByName(edge(detail(id_), F.concat(host, F.lit("/about")), 3))
        .unionByName(edge(detail(id_), F.concat(host, F.lit("/files/"), id_.cast("string"), F.lit(".pdf")), 4, "doc_id % 3 = 0"))
    )
    edges = runtime.materialize(edges, "edges")
    seeds = doc.where("doc_id % 40 = 0").select(F.expr("doc_id div 40").cast("string").alias("profile"), F.concat(host, F.lit("/news/")).alias("seed"), F.lit(0).alias("ord"))
    failed = doc.where("doc_id % 7 = 3").select(detail(id_).alias("url"))
    out = C.visits(seeds, edges, max_depth=2, max_pages=30, failed=failed)
    return out.select("profile", "ord", "url", "depth", "hop")


_HOP = r"""
h{k}_all as (
  select f.profile, e.link as url, f.hop, f.depth, f.url as parent, f.path || [e.ord] as path, ends_with(e.link, '.pdf') as att
  from h{p} f join edges e on e.url = f.url
  where f.hop = {p} and not f.att and f.depth < 2 and not contains(e.link, '/about') and e.link not in (select url from failed) and (f.profile, e.link) not in (select (profile, url) from m{p})),
h{k} as (
  select profile, url, hop + case when att then 0 else 1 end as hop,
    depth + case when rtrim(regexp_extract(url, '^[^:]+://[^/]*([^?]*)', 1), '/') = rtrim(regexp_extract(parent, '^[^:]+://[^/]*([^?]*)', 1), '/') then 0 else 1 end as depth, path, att
  from h{k}_all qualify row_number() over (partition by profile, url order by path) = 1),
m{k} as (select * from m{p} union all select * from h{k})"""
_HOPS = 8
CRAWL_COLUMNS_SQL = (
    r"""
with b as (select doc_id, doc_id // 40 as profile, 'https://s' || (doc_id // 40) || '.example.org' as host, doc_id % 40 // 4 + 1 as n from documents),
l as (select *, host || '/news/' || case when n > 1 then '?page=' || n else '' end as list, host || '/news/d' || doc_id || '.html' as detail from b),
edges as (
  select list as url, detail as link, doc_id % 4 * 2 as ord from l union all select list, host || '/news/?page=' || (n + 1), 3 from l where doc_id % 4 = 0
  union all select list, host || '/files/l' || n || '.pdf', 9 from l where doc_id % 12 = 0
  union all select detail, host || '/news/d' || (doc_id + 1) || '.html', 1 from l where doc_id % 40 < 39
  union all select detail, list, 2 from l union all select detail, host || '/about', 3 from l union all select detail, host || '/files/' || doc_id || '.pdf', 4 from l where doc_id % 3 = 0),
failed as (select detail as url from l where doc_id % 7 = 3),
h0 as (select cast(profile as varchar) as profile, list as url, 0 as hop, 0 as depth, [cast(0 as bigint)] as path, false as att from l where doc_id % 40 = 0),
m0 as (select * from h0),"""
    + ",".join(_HOP.format(k=k, p=k - 1) for k in range(1, _HOPS + 1))
    + f"""
select profile, row_number() over (partition by profile order by hop, path) as ord, url, depth, hop from m{_HOPS} qualify row_number() over (partition by profile order by hop, path) <= 30
"""
)


def queries() -> dict:
    return {f.__name__: f for f in (normalized_urls, visible_text, page_links, page_markdown, simple_pages, page_times, stripped_pages, page_dates, site_scope, changed_pages, overlay_words, noise_containers, crawl, crawl_columns)}


def oracle_sql() -> dict[str, str]:
    return {"normalized_urls": URL_SQL, "visible_text": VISIBLE_SQL, "page_links": LINKS_SQL, "page_markdown": MARKDOWN_SQL, "simple_pages": SIMPLE_SQL, "page_times": TIMES_SQL, "stripped_pages": STRIPPED_SQL, "page_dates": DATES_SQL, "site_scope": SCOPE_SQL, "changed_pages": CHANGED_SQL, "overlay_words": WORDS_SQL, "noise_containers": NOISE_SQL, "crawl": CRAWL_SQL, "crawl_columns": CRAWL_COLUMNS_SQL}
