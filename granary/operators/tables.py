"""Tables: rows, splitting by rows, Markdown, and table chunks."""

from __future__ import annotations

import re
from html.parser import HTMLParser

_ROW = re.compile(r"<tr[\s>/].*?</tr\s*>", re.I | re.S)
_OPEN = re.compile(r"<table\b[^>]*>", re.I)
_HEAD = re.compile(r"<thead\b[^>]*>.*?</thead\s*>", re.I | re.S)
_TABLE = re.compile(r"<table\b[^>]*>.*?</table\s*>", re.I | re.S)
_TAG = re.compile(r"<[^>]+>")
_ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'")]


def visible(html: str | None) -> str:
    """Text that HTML shows, white space collapsed."""
    out = html or ""
    for entity, ch in _ENTITIES:
        out = out.replace(entity, ch)
    return re.sub(r"\s+", " ", _TAG.sub("", out)).strip()


def row_count(html: str | None) -> int:
    return len(re.findall(r"<tr[\s>/]", html or "", re.I))


def split_rows(html: str, most: int) -> list[str]:
    """Parts of at most ``most`` body rows, each with the opening tag and the head of the whole table."""
    head = _HEAD.search(html)
    opening = _OPEN.search(html)
    body = html[: head.start()] + html[head.end() :] if head else html
    rows = _ROW.findall(body)
    if len(rows) <= most:
        return [html]
    start = (opening.group() if opening else "<table>") + (head.group() if head else "")
    return [f"{start}{''.join(rows[k : k + most])}</table>" for k in range(0, len(rows), most)]


def rows_per_part(html: str, max_rows: int, max_chars: int) -> int:
    """How many rows a part takes; 0 if the table stays whole."""
    rows, chars = row_count(html), len(visible(html))
    if rows > max_rows:
        return max_rows
    if max_chars <= 0 or chars <= max_chars or not rows:
        return 0
    fit = max(1, rows * max_chars // chars)
    return fit if fit < rows else max(1, rows - 1)


class _Cells(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list[str]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th"):
            self._close()
            self.cell = []
        elif tag == "br" and self.cell is not None:
            self.cell.append(" ")

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr", "table"):
            self._close()

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def _close(self):
        if self.cell is not None:
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append(" ".join("".join(self.cell).split()))
            self.cell = None


def matrix(html: str) -> list[list[str]]:
    """Cells of an HTML table."""
    p = _Cells()
    p.feed(html)
    p.close()
    p._close()
    return [r for r in p.rows if r]


def markdown(rows: list[list[str]]) -> str:
    """Rows as a Markdown table: the first is the head, short rows are padded, bars escaped."""
    if not rows:
        return ""
    width = max(map(len, rows))
    line = lambda r: "| " + " | ".join(c.replace("|", "\\|") for c in [*r, *[""] * (width - len(r))]) + " |"
    return "\n".join([line(rows[0]), "|" + " --- |" * width, *map(line, rows[1:])])


def tables_to_markdown(text: str) -> str:
    """Every HTML table in a text as Markdown; one without cells goes as its visible text."""
    return _TABLE.sub(lambda m: "\n" + (markdown(matrix(m.group())) or visible(m.group())) + "\n", text)


def split_oversize(text: str, limit: int) -> list[str]:
    """Pieces of at most ``limit`` characters: between paragraphs, else between lines, else anywhere. Blank pieces go."""

    def parts(whole: str, cut: str) -> list[str]:
        return [p for p in re.split(f"(?<={cut})", whole) if p] if cut == "\n" else [p for p in re.findall(r"(?s).+?(?:\n\s*\n|\Z)", whole) if p]

    out: list[str] = []
    now = ""
    units: list[str] = []
    for paragraph in parts(text, "\n\n"):
        if len(paragraph) <= limit:
            units.append(paragraph)
            continue
        for line in parts(paragraph, "\n"):
            units += [line[k : k + limit] for k in range(0, len(line), limit)]
    for u in units:
        if now and len(now) + len(u) > limit:
            out.append(now)
            now = ""
        now += u
    return [p for p in [*out, now] if p.strip()]
