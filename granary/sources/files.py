"""Sources: files, parser artefacts, office documents, delimited text; and the driver's tables."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructType

from granary.operators.tables import markdown

EXTENSIONS = [".pdf", ".doc", ".docx", ".ppt", ".pptx", ".xls", ".xlsx", ".html", ".htm", ".md", ".txt", ".csv", ".png", ".jpg", ".jpeg"]
T_STRING = StringType()


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def scan(spark: SparkSession, root: str, extensions: list[str] = EXTENSIONS, content: bool = False) -> DataFrame:
    """Files below a folder: path, name, stem, ext, size, mtime, md5, in any store that Spark reads."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    name = file_name(F.col("path"))
    found = rows.select("path", name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).alias("ext"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.md5("content").alias("md5"), *(["content"] if content else []))
    return found.where(F.col("ext").isin(extensions))


def output_kind(name: Column) -> Column:
    """Kind of a parser's output file."""
    low = F.lower(name)
    return F.when(F.endswith(low, F.lit(".md")), "markdown").when(F.endswith(low, F.lit("_content_list_v2.json")), "blocks_v2").when(F.endswith(low, F.lit("_content_list.json")), "blocks_v1").when(F.endswith(low, F.lit(".json")), "json").when(low.rlike(r"\.(png|jpe?g|gif|webp|bmp|svg)$"), "image").otherwise("other")


def preview_kind(name: Column) -> Column:
    ext = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    return F.when(ext == "pdf", "pdf").when(ext.isin("png", "jpg", "jpeg", "gif", "webp", "bmp", "svg"), "image").when(ext.isin("md", "txt", "csv", "json", "log"), "text").when(ext.isin("html", "htm"), "html").when(ext.isin("doc", "docx", "xls", "xlsx", "ppt", "pptx"), "office").otherwise("other")


def chunk_file_kind(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.rlike(r"\.(png|jpe?g|gif|webp|bmp)$"), "image").when(low.rlike(r"^chunk_\d+.*\.md$"), "chunk").when(F.endswith(low, F.lit(".json")), "metadata").otherwise("other")


def parsed_artefacts(files: DataFrame) -> DataFrame:
    """The first artefact of each kind in each document's folder."""
    folder = F.element_at(F.split("path", "/"), -2)
    return files.select(folder.alias("doc"), output_kind(F.col("name")).alias("kind"), "path").groupBy("doc", "kind").agg(F.min("path").alias("path"))


def text_of(spark: SparkSession, paths: str) -> DataFrame:
    """(path, text) of whole files."""
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def delimited_preview(spark: SparkSession, path: str, rows: int = 1000, columns: int = 80) -> tuple[DataFrame, int]:
    """The first rows and columns of a delimited file, and how many rows it has. The limits are the feature."""
    df = spark.read.option("header", "true").csv(path)
    return df.select(*df.columns[:columns]).limit(rows), df.count()


def fallback(*tiers: Column, least: int = 100) -> Column:
    """The first tier with enough text, else the longest of them."""
    enough = [F.when(F.length(t) >= least, t) for t in tiers]
    longest = F.array_max(F.array(*(F.struct(F.coalesce(F.length(t), F.lit(0)).alias("n"), F.coalesce(t, F.lit("")).alias("t")) for t in tiers)))
    return F.coalesce(*enough, longest["t"])


def parser_result(response: Column) -> Column:
    """Markdown, block list and images of a parser's JSON answer."""
    return F.from_json(response, "struct<md_content:string,content_list:string,images:map<string,string>>")


def result_images(rows: DataFrame, result: str = "result", key: str = "doc_id") -> DataFrame:
    """(doc_id, path, data) of the images in an answer."""
    return rows.select(key, F.explode(F.col(result)["images"]).alias("path", "b64")).select(key, "path", F.unbase64(F.regexp_replace("b64", "^data:[^,]*,", "")).alias("data"))


# What a remote parser calls its files, and how they are called here, after the document's stem.
RENAMED = {"full.md": ".md", "layout.json": "_middle.json"}
RENAMED_ENDS = {"_model.json": "_model.json", "_content_list.json": "_content_list_v2.json"}


def canonical_name(path: Column, stem: Column) -> Column:
    """A parser's path with the name that later stages look for; other names stay."""
    name, folder = file_name(path), F.regexp_extract(path, r"^(.*/)?[^/]*$", 1)
    low = F.lower(name)
    whole = [F.when(low == k, F.concat(stem, F.lit(v))) for k, v in RENAMED.items()]
    ends = [F.when(F.endswith(low, F.lit(k)), F.concat(stem, F.lit(v))) for k, v in RENAMED_ENDS.items()]
    return F.concat(folder, F.coalesce(*whole, *ends, name))


_ENTRIES = ArrayType(StructType().add("path", T_STRING).add("data", BinaryType()))


def zip_entries(data: bytes | None) -> list[dict] | None:
    """Files of an archive without their top folder; null if it is none."""
    try:
        with zipfile.ZipFile(io.BytesIO(data or b"")) as z:
            return [{"path": n.split("/", 1)[1] if "/" in n else n, "data": z.read(n)} for n in z.namelist() if not n.endswith("/")]
    except zipfile.BadZipFile:
        return None


@F.pandas_udf(_ENTRIES)
def unzipped(data: pd.Series) -> pd.Series:
    return pd.Series([zip_entries(d) for d in data], dtype=object)


# --- office documents: zip archives of XML ----------------------------------------------------------

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def docx_markdown(data: bytes | None) -> str | None:
    """Paragraphs and tables of a text document, in order; a merged cell takes as many columns as it spans."""
    if data is None:
        return None
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    out = []
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t")).strip()
    for e in body if body is not None else []:
        if e.tag == f"{_W}p":
            style = e.find(f"{_W}pPr/{_W}pStyle")
            m = re.match(r"(?i)heading\s*(\d)", style.get(f"{_W}val", "") if style is not None else "")
            if line := text(e):
                out.append("#" * int(m.group(1)) + " " + line if m else line)
        elif e.tag == f"{_W}tbl":
            rows = []
            for tr in e.findall(f"{_W}tr"):
                row = []
                for tc in tr.findall(f"{_W}tc"):
                    span = tc.find(f"{_W}tcPr/{_W}gridSpan")
                    row += [text(tc), *[""] * (int(span.get(f"{_W}val", "1")) - 1 if span is not None else 0)]
                rows.append(row)
            out.append(markdown(rows))
    return "\n\n".join(out)


def pptx_text(data: bytes | None) -> str | None:
    """Text of slides, in the order of their numbers."""
    if data is None:
        return None
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        slides = sorted((int(m.group(1)), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        parts = []
        for k, n in slides:
            lines = ["".join(t.text or "" for t in p.iter(f"{_A}t")).strip() for p in ET.fromstring(z.read(n)).iter(f"{_A}p")]
            parts.append("\n".join([f"## {k}", *(x for x in lines if x)]))
    return "\n\n".join(parts)


def xlsx_markdown(data: bytes | None, sheets: int = 50, rows: int = 2000, columns: int = 80) -> str | None:
    """One Markdown table for each sheet, within the limits of a preview; empty rows are left out."""
    if data is None:
        return None
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        strings = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_S}si")] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))} if "xl/_rels/workbook.xml.rels" in names else {}
        out = []
        for sheet in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"):
            if len(out) >= sheets:
                break
            target = (targets.get(sheet.get(f"{_R}id")) or "").lstrip("/")
            path = target if target.startswith("xl/") else f"xl/{target}"
            if path not in names:
                continue
            held = []
            for row in ET.fromstring(z.read(path)).iter(f"{_S}row"):
                line: list[str] = []
                for c in row.findall(f"{_S}c"):
                    at = 0
                    for ch in re.match(r"[A-Z]*", c.get("r") or "").group():
                        at = at * 26 + ord(ch) - 64
                    line += [""] * (at - 1 - len(line))
                    v, inline = c.find(f"{_S}v"), c.find(f"{_S}is")
                    value = strings[int(v.text)] if c.get("t") == "s" and v is not None else "".join(t.text or "" for t in inline.iter(f"{_S}t")) if inline is not None else (v.text or "" if v is not None else "")
                    line.append(" ".join(value.split()))
                if any(line):
                    held.append(line[:columns])
                if len(held) >= rows:
                    break
            if held:
                out.append(f"## {sheet.get('name')}\n\n{markdown(held)}")
    return "\n\n".join(out)


@F.pandas_udf(T_STRING)
def office_text(data: pd.Series, ext: pd.Series) -> pd.Series:
    """Markdown of an office document by its extension; null if it is none or broken."""
    readers = {".docx": docx_markdown, ".pptx": pptx_text, ".xlsx": xlsx_markdown}

    def one(d, e):
        try:
            return readers[e](d) if e in readers else None
        except (zipfile.BadZipFile, KeyError, ET.ParseError):
            return None

    return pd.Series([one(d, e) for d, e in zip(data, ext)], dtype=object)


@F.pandas_udf(BinaryType())
def workbook_bytes(rows: pd.Series) -> pd.Series:
    """A workbook of array<struct<sheet,cells>>: its sheets in the order of their first rows, cells as texts, null cells left out."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'

    def letters(k):
        out = ""
        while k:
            k, r = divmod(k - 1, 26)
            out = chr(65 + r) + out
        return out

    def one(held):
        sheets: dict[str, list] = {}
        for r in held if held is not None else []:
            sheets.setdefault(r["sheet"], []).append(r["cells"])
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            names = "".join(f'<sheet name={quoteattr(n)} sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(sheets, 1))
            z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{names}</sheets></workbook>')
            z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>")
            for k, lines in enumerate(sheets.values(), 1):
                cells = lambda line, n: "".join(f'<c r="{letters(i)}{n}" t="inlineStr"><is><t>{escape(v)}</t></is></c>' for i, v in enumerate(line, 1) if v is not None)
                z.writestr(f"xl/worksheets/sheet{k}.xml", f"<worksheet {ns}><sheetData>" + "".join(f'<row r="{n}">{cells(line, n)}</row>' for n, line in enumerate(lines, 1)) + "</sheetData></worksheet>")
        return out.getvalue()

    return pd.Series([one(r) for r in rows], dtype=object)
