"""Scalar functions as column expressions: they stay in the JVM, inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[ \t\r\n\f\x0B]"
#: ASCII and ideographic white space, as a trim takes it.
_EDGE = r"^[\s\x{3000}\x{00A0}]+|[\s\x{3000}\x{00A0}]+$"

# Entities that are resolved before tags go, in this order.
ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'")]
# What counts as an attachment.
ATTACHMENTS = [".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".csv", ".txt", ".md", ".rtf", ".wps", ".et", ".dps", ".zip", ".rar", ".7z", ".tar", ".gz", ".eml", ".msg"]
ATTACHMENT_MIME = ["application/pdf", "application/msword", "application/vnd.", "application/zip", "application/octet-stream", "text/csv"]


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, _EDGE, "")


def collapse_ws(c: Column) -> Column:
    """Runs of ASCII white space as one space, none at the ends."""
    return F.btrim(F.regexp_replace(c, WS + "+", " "))


def strip_tags(html: Column) -> Column:
    """Visible text of HTML: entities first, then tags, then white space."""
    c = F.coalesce(html, F.lit(""))
    for entity, ch in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(ch))
    return collapse_ws(F.regexp_replace(c, "<[^>]+>", ""))


def slugify(c: Column, most: int = 40) -> Column:
    """A title as part of a file name."""
    s = F.regexp_replace(F.btrim(F.regexp_replace(c, r'[\\/:*?"<>|\r\n\t]+', "_")), WS + "+", "_")
    s = F.when(F.length(s) == 0, F.lit("chunk")).otherwise(s)
    return F.when(F.length(s) > most, F.regexp_replace(F.substring(s, 1, most), "_+$", "")).otherwise(s)


def safe_stem(c: Column) -> Column:
    """A file's stem without characters that file systems refuse, nor dots or spaces at its end."""
    return F.regexp_replace(F.regexp_replace(c, r'[\\/:*?"<>|\x00-\x1F]', "_"), r"[ .]+$", "")


def page_title(c: Column, most: int = 60) -> Column:
    """A page's own title: what stands before the first dash or bar, safe as a stem."""
    return F.substring(safe_stem(F.btrim(F.element_at(F.split(c, r"\s*[-_|–—]\s*", 2), 1))), 1, most)


def strip_qualifier(stem: Column) -> Column:
    """A stem without a trailing tag in square brackets or a copy number."""
    return F.regexp_replace(stem, r"\s*\[[^\]]*\]$", "")


def sentences(text: Column) -> Column:
    """Sentences with their terminators. A stop counts before white space or the end, unless a letter and a dot precede it."""
    mark = F.regexp_replace(text, r"([。；!?\n]|(?<![A-Za-z]\.)\.(?=[\s\x{3000}]|$))", "$1\u0001")
    return F.filter(F.split(mark, "\u0001"), lambda s: F.length(F.regexp_replace(s, r"[\s\x{3000}]+", "")) > 0)


def image_refs(text: Column) -> Column:
    """Local image references of Markdown, in order, each once."""
    raw = F.transform(F.regexp_extract_all(text, F.lit(r"!\[[^\]]*\]\(([^)]+)\)"), F.lit(1)), lambda r: F.replace(F.btrim(r), F.lit("\\"), F.lit("/")))
    local = F.filter(raw, lambda r: ~r.rlike("^(https?://|data:)") & (F.length(F.element_at(F.split(r, "/"), -1)) > 0))
    return F.array_distinct(local)


def rewrite_images(text: Column, mapping: Column) -> Column:
    """References replaced by a map of urls; an empty alternative text becomes ``image``. One fold over the map's entries."""
    quoted = lambda k: F.concat(F.lit(r"!\[([^\]]*)\]\(\s*\Q"), k, F.lit(r"\E\s*\)"))
    done = F.aggregate(F.map_entries(mapping), text, lambda acc, e: F.regexp_replace(acc, quoted(e["key"]), F.concat(F.lit("![$1]("), F.replace(F.replace(e["value"], F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$")), F.lit(")"))))
    return F.regexp_replace(done, r"!\[\s*\]\((https?://[^)]*)\)", "![image]($1)")


def table_rows(html: Column) -> Column:
    """Rows of an HTML table."""
    return F.regexp_count(F.coalesce(html, F.lit("")), F.lit(r"(?i)<tr[\s>/]"))


def _part(url: Column, part: str) -> Column:
    return F.try_parse_url(url, F.lit(part))


def url_path(url: Column) -> Column:
    path = _part(url, "PATH")
    return F.when(path.isNull() | (path == ""), F.lit("/")).otherwise(path)


def normalize_url(url: Column) -> Column:
    """Scheme and host in lower case, ``/`` for no path, without fragment; '' for other schemes."""
    scheme, host, query = F.lower(_part(url, "PROTOCOL")), F.lower(_part(url, "AUTHORITY")), _part(url, "QUERY")
    path = F.regexp_replace(url_path(url), ";[^/]*$", "")
    whole = F.concat(scheme, F.lit("://"), host, path, F.when(query.isNotNull() & (query != ""), F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    return F.when(scheme.isin("http", "https") & (F.length(host) > 0), whole).otherwise(F.lit(""))


def url_ext(url: Column) -> Column:
    """Lower-case extension of the last part of a URL's path, or ''."""
    last = F.element_at(F.split(F.regexp_replace(F.coalesce(F.try_url_decode(url_path(url)), url_path(url)), "/+$", ""), "/"), -1)
    return F.lower(F.regexp_extract(last, r"[^.](\.[^.]+)$", 1))


def is_attachment(url: Column) -> Column:
    return url_ext(url).isin(ATTACHMENTS)


def is_document_mime(kind: Column) -> Column:
    first = F.btrim(F.element_at(F.split(F.lower(F.coalesce(kind, F.lit(""))), ";"), 1))
    return F.exists(F.array(*map(F.lit, ATTACHMENT_MIME)), lambda p: F.startswith(first, p))


def title_from_url(url: Column) -> Column:
    """Last part of the path without a page extension, else the host."""
    path = F.regexp_replace(F.coalesce(_part(url, "PATH"), F.lit("")), "/+$", "")
    last = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?i)\.(html?|php|aspx?|jsp|shtml)$", "")
    return F.when(F.length(last) > 0, last).otherwise(F.coalesce(_part(url, "AUTHORITY"), url))


def disposition_filename(value: Column) -> Column:
    starred = F.regexp_extract(value, r"(?i)filename\*=UTF-8''([^;]+)", 1)
    plain = F.regexp_extract(value, r"(?i)filename=[\"']?([^\"';]+)", 1)
    return F.when(F.length(starred) > 0, F.try_url_decode(F.btrim(starred, F.lit(' "')))).when(F.length(plain) > 0, F.btrim(plain))


def host_key(url: Column) -> Column:
    """Host in lower case without ``www.``."""
    return F.regexp_replace(F.lower(_part(url, "AUTHORITY")), r"^www\.", "")


def in_subtree(child: Column, seed: Column) -> Column:
    """A path that is the seed's, below it, or continues its last part with an underscore."""
    root, path = F.regexp_replace(seed, "/+$", ""), F.regexp_replace(child, "/+$", "")
    return (root == "") | (path == root) | F.startswith(path, F.concat(root, F.lit("/"))) | F.startswith(path, F.concat(root, F.lit("_")))


def site_scope(link: Column, seed: Column, scope: str = "column") -> Column:
    """Whether a crawl from ``seed`` may follow ``link``."""
    same = host_key(link) == host_key(seed)
    if scope == "column":
        inside = in_subtree(url_path(link), url_path(seed))
    else:
        root = F.regexp_replace(url_path(seed), "/+$", "")
        inside = ~F.endswith(url_path(seed), F.lit("/")) | (root == "") | F.startswith(url_path(link), F.concat(root, F.lit("/")))
    return F.coalesce(same & (is_attachment(link) | inside), F.lit(False))


def container_tokens(value: Column) -> Column:
    """Words of an id or class: split at dashes, underscores, spaces and humps, in lower case."""
    humps = F.regexp_replace(F.regexp_replace(F.coalesce(value, F.lit("")), "[-_]+", " "), "([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(humps), WS + "+"), lambda t: t != "")


def first_date(text: Column) -> Column:
    """First date as yyyy-MM-dd, with HH:mm if a time follows; null if none or out of range."""
    pattern = r"((?:19|20)\d{2})\s*[-/年.]\s*(\d{1,2})\s*[-/月.]\s*(\d{1,2})日?(?:[\sT](\d{1,2})[:：](\d{1,2}))?"
    y, mo, d, h, mi = (F.regexp_extract(text, pattern, k) for k in range(1, 6))
    ok = F.try_to_number(mo, F.lit("99")).between(1, 12) & F.try_to_number(d, F.lit("99")).between(1, 31)
    two = lambda c: F.lpad(c, 2, "0")
    timed = (h != "") & F.try_to_number(h, F.lit("99")).between(0, 23) & F.try_to_number(mi, F.lit("99")).between(0, 59)
    day = F.concat(y, F.lit("-"), two(mo), F.lit("-"), two(d))
    return F.when((y != "") & ok, F.when(F.coalesce(timed, F.lit(False)), F.concat(day, F.lit(" "), two(h), F.lit(":"), two(mi))).otherwise(day))


def charset(content_type: Column, head: Column) -> Column:
    """Declared encoding: of the header, else of the page's head, else utf-8."""
    found = [F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?i)charset\s*=\s*[\"']?([A-Za-z0-9_-]+)", 1), F.lit("")) for c in (content_type, head)]
    return F.lower(F.coalesce(*found, F.lit("utf-8")))


def image_kind(data: Column, url: Column) -> Column:
    """Image extension by leading bytes, else by the URL, else .png."""
    h = F.hex(F.substring(data, 1, 12))
    return (
        F.when(F.startswith(h, F.lit("89504E47")), ".png").when(F.startswith(h, F.lit("FFD8FF")), ".jpg").when(F.startswith(h, F.lit("47494638")), ".gif")
        .when(F.startswith(h, F.lit("52494646")) & (F.substring(h, 17, 8) == "57454250"), ".webp").when(F.startswith(h, F.lit("424D")), ".bmp")
        .when(url_ext(url).isin(".png", ".jpg", ".jpeg", ".gif", ".webp", ".bmp", ".svg"), url_ext(url)).otherwise(".png")
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if one is empty, of another length, or of norm 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0), dot(a, b) / norm).otherwise(F.lit(0.0))


def cell_text(c: Column, most: int = 300) -> Column:
    s = collapse_ws(F.coalesce(c, F.lit("")))
    return F.when(F.length(s) > most, F.concat(F.substring(s, 1, most), F.lit("…"))).otherwise(s)


def clamp(c: Column, low: int, high: int, default: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(c.try_cast("int"), F.lit(default))))


def tidy_markdown(c: Column) -> Column:
    """Lines without trailing blanks, at most one blank line in a row, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[ \t]+(?=\n|$)", ""), r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")


def json_strings(answer: Column) -> Column:
    """An answer that is a JSON array of strings, perhaps fenced; null if it is not."""
    bare = F.regexp_replace(F.regexp_replace(answer, r"^\s*```[a-zA-Z]*\s*", ""), r"\s*```\s*$", "")
    return F.from_json(F.regexp_extract(bare, r"(?s)(\[.*\])", 1), "array<string>")


def status_hint(code: Column) -> Column:
    """What a failed request most likely needs."""
    return (
        F.when(code == 401, "check the key").when(code == 403, "the key lacks permission").when(code == 404, "check the address and the dataset")
        .when(code == 413, "the file is too large").when(code == 429, "wait: too many requests").when(code >= 500, "the service failed; retry").otherwise("")
    )


def retry_wait(attempt: Column, first: float = 1.0, factor: float = 2.0, most: float = 60.0) -> Column:
    return F.least(F.lit(first) * F.pow(F.lit(factor), attempt - 1), F.lit(most))


def mask_secrets(config: Column, keys: list[str]) -> Column:
    return F.transform_values(config, lambda k, v: F.when(F.lower(k).isin(keys) & (F.length(v) > 0), F.lit("***")).otherwise(v))


def object_url(base: Column, key: Column) -> Column:
    """A public address: each part of the key is percent-encoded."""
    parts = F.transform(F.filter(F.split(F.replace(key, F.lit("\\"), F.lit("/")), "/"), lambda p: p != ""), lambda p: F.replace(F.url_encode(p), F.lit("+"), F.lit("%20")))
    return F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), F.array_join(parts, "/"))


def sanitize_html(html: Column) -> Column:
    """HTML without scripts, styles, frames, handlers and script addresses."""
    c = F.regexp_replace(html, r"(?is)<(script|style|iframe|object|embed|noscript|template)\b[^>]*>.*?</\1\s*>", "")
    c = F.regexp_replace(c, r"(?is)</?(?:script|style|iframe|object|embed|noscript|template|link|meta|base)\b[^>]*>", "")
    c = F.regexp_replace(c, r"(?is)\s+on[a-z]+\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", "")
    return F.regexp_replace(c, r"(?is)(href|src)\s*=\s*([\"'])\s*javascript:[^\"']*\2", "$1=$2#$2")


def plain_text(b: Column) -> Column:
    """A block as plain text: a title marked by its level, a table as what it shows, an image by its caption."""
    kind = b["block_type"]
    level = F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce(b["level"], F.lit(2))))
    return F.when(kind == "title", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), b["text"])).when(kind == "table", strip_tags(b["table_html"])).when(kind == "image", F.coalesce(b["image_caption"], F.lit(""))).otherwise(F.coalesce(b["text"], F.lit("")))


def now_text() -> Column:
    """The time as the ledger writes it, in UTC if the session is."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")


def profile_entries(value: Column) -> Column:
    """Entries of a crawl profile: a JSON list or lines of ``URL<TAB>label``, as structs; blank ones go."""
    listed = F.from_json(value, "array<string>")
    raw = F.when(F.ltrim(value).startswith("["), F.coalesce(listed, F.array().cast("array<string>"))).otherwise(F.split(F.coalesce(value, F.lit("")), "\n"))
    entry = lambda e: F.struct(F.btrim(F.element_at(F.split(e, "\t", 2), 1)).alias("url"), F.coalesce(F.btrim(F.get(F.split(e, "\t", 2), F.lit(1))), F.lit("")).alias("label"))
    return F.filter(F.transform(raw, entry), lambda e: e["url"] != "")


def within(base: Column, path: Column) -> Column:
    """Whether a path lies in a folder, part by part: neither a sibling's longer name nor dots lead out of it."""
    root = F.regexp_replace(base, "/+$", "")
    return ~F.array_contains(F.split(path, "/"), "..") & ((path == root) | F.startswith(path, F.concat(root, F.lit("/"))))


def active_profile(active: Column, kind: Column, old: Column) -> Column:
    """The active profile of a type, else the single one of older files."""
    return F.coalesce(F.element_at(active, kind), old)


def env_entry(line: Column) -> Column:
    """(key, exported) of a line of settings, null for a comment, a blank line and whatever is no assignment."""
    bare = trimmed(line)
    key = F.regexp_extract(bare, r"^(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=", 1)
    return F.when((key != "") & ~F.startswith(bare, F.lit("#")), F.struct(key.alias("key"), bare.rlike(r"^export\s").alias("exported")))
