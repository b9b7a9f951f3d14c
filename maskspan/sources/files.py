"""Files as tables: recursive scans, format dispatch, text extraction, and writers of masked documents.

Whatever a parser meets, a row comes out: (text, scan_status, reason), status ok, failed or unsupported.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spans import extension, masked_name
from ..operators.detect import fresh
from .pdf import pdf_text

DOCUMENTS = tuple(".pdf .pptx .xlsx .hwpx .hwp .docx".split())
TEXTS = (".c", ".cfg", ".cpp", ".css", ".csv", ".env", ".go", ".html", ".ini", ".java", ".js", ".json", ".log", ".md", ".py", ".rs", ".sh", ".sql", ".toml", ".ts", ".tsv", ".txt", ".xml", ".yaml", ".yml")
MIME = {
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    ".pdf": "application/pdf",
    ".hwp": "application/x-hwp",
    ".hwpx": "application/hwp+zip",
    ".txt": "text/plain",
    ".md": "text/markdown",
    ".csv": "text/csv",
    ".html": "text/html",
    ".json": "application/json",
}
#: S12.
REASONS = {
    ".hwp": "HWP needs an office suite on the workers",
    ".hwpx": "HWPX needs its own office suite",
    ".xls": "the old spreadsheet format is not read: save as .xlsx",
    ".ppt": "the old slide format is not read: save as .pptx",
}
UPLOAD_BYTES = 20 << 20

_BAR = " | "
_RULE = "\n\n---\n\n"
_HEAD = "<?xml version='1.0' standalone='yes'?>"


def scan_folder(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, file_name, length, modified, content) of all files below root; content is read only if it is used.  Spark leaves
    out files whose names begin with a dot or an underscore."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return rows.select("path", F.regexp_extract("path", "([^/]*)$", 1).alias("file_name"), "length", F.col("modificationTime").alias("modified"), "content")


def file_kind(name: Column | str) -> Column:
    """Document, text or binary."""
    ext = extension(name)
    base = F.regexp_extract(F.col(name) if isinstance(name, str) else name, "([^/]*)$", 1)
    return F.when(ext.isin(*DOCUMENTS), "document").when(ext.isin(*TEXTS) | base.startswith(".env"), "text").otherwise("binary")


def mime_type(name: Column | str) -> Column:
    """S16."""
    table = F.create_map(*(F.lit(x) for pair in MIME.items() for x in pair))
    return F.coalesce(F.try_element_at(table, extension(name)), F.lit("application/octet-stream"))


def is_supported_upload(name: Column, mime: Column, protect: Column) -> Column:
    """P16."""
    return protect & (mime.isin(MIME[".pdf"], MIME[".docx"]) | extension(name).isin(".pdf", ".docx"))


def list_files(files: DataFrame, limit: int) -> DataFrame:
    """(path, kind, length) in the order of the paths."""
    return files.select("path", file_kind("file_name").alias("kind"), "length").orderBy("path").limit(limit)


def size_limit(files: DataFrame, most: int = UPLOAD_BYTES) -> DataFrame:
    """What is too large is rejected with a reason, before its content is read."""
    big = F.col("length") > most
    return files.select("*", F.when(big, "unsupported").otherwise("ok").alias("size_status"), F.when(big, F.lit(f"more than {most} bytes")).cast("string").alias("size_reason"))


def folder_size(files: DataFrame) -> DataFrame:
    """A14."""
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.count("*").alias("files"))


def decode_text(data: bytes) -> str:
    """S3: UTF-8, else the Korean code pages, else UTF-8 with replacements."""
    for name in "utf-8 cp949 euc-kr".split():
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            pass
    return data.decode("utf-8", "replace")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _find(root, name: str):
    return [x for x in root.iter() if _local(x.tag) == name]


def _plain(node) -> str:
    out = []
    for x in node.iter():
        kind = _local(x.tag)
        if kind == "t":
            out.append(x.text or "")
        elif kind == "tab":
            out.append("\t")
        elif kind in ("br", "cr"):
            out.append("\n")
    return "".join(out)


def docx_text(data: bytes) -> str:
    """Paragraphs that aren't blank, then the tables' rows, with blank lines between."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = _find(ElementTree.fromstring(z.read("word/document.xml")), "body")[0]
    parts = [t for p in body if _local(p.tag) == "p" and (t := _plain(p)).strip()]
    for table in (x for x in body if _local(x.tag) == "tbl"):
        for row in _find(table, "tr"):
            cells = [t for c in row if _local(c.tag) == "tc" and (t := "\n".join(_plain(p) for p in _find(c, "p")).strip())]
            parts += [_BAR.join(cells)] if cells else []
    return "\n\n".join(parts)


def xlsx_text(data: bytes) -> str:
    """Every sheet under its title, non-empty cells with bars between, sheets with a rule between."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = [_plain(x) for x in _find(ElementTree.fromstring(z.read("xl/sharedStrings.xml")), "si")] if "xl/sharedStrings.xml" in names else []
        target = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in _find(ElementTree.fromstring(z.read("xl/workbook.xml")), "sheet"):
            link = next(v for k, v in sheet.attrib.items() if _local(k) == "id")
            path = target[link]
            lines = [f"[{sheet.get('name')}]"]
            for row in _find(ElementTree.fromstring(z.read(path.lstrip("/") if path.startswith("/") else f"xl/{path}")), "row"):
                cells = []
                for c in _find(row, "c"):
                    value = next((v.text or "" for v in c if _local(v.tag) == "v"), "")
                    kind = c.get("t")
                    text = shared[int(value)] if kind == "s" and value else _plain(c) if kind == "inlineStr" else value
                    if text.strip():
                        cells.append(text.strip())
                lines += [_BAR.join(cells)] if cells else []
            out.append("\n".join(lines))
    return _RULE.join(out)


def pptx_text(data: bytes) -> str:
    """Slides under their numbers; an empty one is left out but counted."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        slides = sorted((n for n in z.namelist() if n.startswith("ppt/slides/slide") and n.endswith(".xml")), key=lambda n: int("".join(filter(str.isdigit, n.rpartition("/")[2])) or 0))
        out = []
        for k, name in enumerate(slides, 1):
            root = ElementTree.fromstring(z.read(name))
            lines = [t for s in _find(root, "txBody") if (t := "\n".join(x for p in _find(s, "p") if (x := _plain(p)).strip()))]
            for row in _find(root, "tr"):
                cells = [t for c in _find(row, "tc") if (t := " ".join(_plain(p) for p in _find(c, "p")).strip())]
                lines = [x for x in lines if x not in cells]
                lines += [_BAR.join(cells)] if cells else []
            if lines:
                out.append(f"[슬라이드 {k}]\n" + "\n".join(lines))
    return "\n\n".join(out)


#: S5.
SCANNED = "a scanned PDF: its pages hold no text"
_BINARY = {".docx": docx_text, ".xlsx": xlsx_text, ".pptx": pptx_text, ".pdf": pdf_text}
_EXTENSION_OF = {v: k for k, v in MIME.items()}


def parse_one(data, mime, name):
    """By extension, else by MIME type, else as text; never raises."""
    base = (name or "").rpartition("/")[2].lstrip(".").lower()
    ext = "." + base.rpartition(".")[2] if "." in base else _EXTENSION_OF.get(mime or "", "")
    if ext in REASONS:
        return "", "unsupported", REASONS[ext]
    try:
        text = (_BINARY[ext] if ext in _BINARY else decode_text)(bytes(data or b""))
        return ("", "unsupported", SCANNED) if text is None else (text, "ok", None)
    except Exception as e:  # any file may be broken in any way: its row says so
        return "", "failed", f"{type(e).__name__}: {e}"


def parse(files: DataFrame) -> DataFrame:
    """Adds text, scan_status and reason to (file_name, content, ...), drops content.  UTF-8 text never leaves the JVM; only
    other formats and code pages go to a vectorised function."""
    ext = extension("file_name")
    mime = F.col("mime_type") if "mime_type" in files.columns else F.lit(None).cast("string")

    @F.pandas_udf("struct<text:string,scan_status:string,reason:string>")
    def others(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for content, kind, name in batches:
            yield pd.DataFrame([parse_one(c, m, n) for c, m, n in zip(content, kind, name)], columns=["text", "scan_status", "reason"])

    plain = ~ext.isin(*_BINARY, *REASONS) & ~F.coalesce(mime, F.lit("")).isin(*(MIME[x] for x in DOCUMENTS)) & F.is_valid_utf8(F.col("content").cast("string"))
    simple = F.struct(F.col("content").cast("string").alias("text"), F.lit("ok").alias("scan_status"), F.lit(None).cast("string").alias("reason"))
    # a file that the JVM has read goes to Python as null
    is_plain, other, result = fresh(files, 3)
    unread = ~F.col(is_plain)
    parsed = files.withColumn(is_plain, F.coalesce(plain, F.lit(False))).withColumn(other, others(F.when(unread, F.col("content")), mime, F.when(unread, F.col("file_name"))))
    return parsed.withColumn(result, F.when(F.col(is_plain), simple).otherwise(F.col(other))).select(*[c for c in files.columns if c != "content"], f"{result}.*")


def readable_text(files: DataFrame) -> DataFrame:
    """Text files in UTF-8 or a Korean code page; others are left out."""

    @F.pandas_udf("string")
    def korean(content: pd.Series) -> pd.Series:
        def one(x):
            try:
                return None if x is None else bytes(x).decode("cp949")
            except UnicodeDecodeError:
                return None

        return content.map(one)

    rows = files.where(file_kind("file_name") == "text")
    utf8 = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.when(utf8, F.col("content").cast("string")).otherwise(korean(F.when(~utf8, F.col("content"))))
    return rows.withColumn("text", text).where("text is not null").drop("content")


def _docx(text: str) -> bytes:
    """K3: a paragraph a line."""
    from xml.sax.saxutils import escape

    def node(name: str, inside: str = "", **attributes: str) -> str:
        return f"<{name}" + "".join(f' {k.replace("_", ":")}="{v}"' for k, v in attributes.items()) + f">{inside}</{name}>"

    site = "http://schemas.openxmlformats.org"
    kind = "application/vnd.openxmlformats-{}+xml".format
    font = node("w:rPr", node("w:rFonts", **dict.fromkeys(("w_ascii", "w_hAnsi", "w_eastAsia"), "Malgun Gothic")))
    lines = "".join(node("w:p", node("w:r", font + node("w:t", escape(x), xml_space="preserve")) if x.strip() else "") for x in text.split("\n"))
    types = node("Default", Extension="rels", ContentType=kind("package.relationships")) + node("Override", PartName="/word/document.xml", ContentType=kind("officedocument.wordprocessingml.document.main"))
    link = node("Relationship", Id="rId1", Type=f"{site}/officeDocument/2006/relationships/officeDocument", Target="word/document.xml")
    parts = {
        "[Content_Types].xml": node("Types", types, xmlns=f"{site}/package/2006/content-types"),
        "_rels/.rels": node("Relationships", link, xmlns=f"{site}/package/2006/relationships"),
        "word/document.xml": node("w:document", node("w:body", lines), xmlns_w=f"{site}/wordprocessingml/2006/main"),
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            # a fixed time: equal texts give equal files
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), _HEAD + body)
    return out.getvalue()


def wrap(masked: DataFrame, kind: str = "docx", name: str = "file_name", text: str = "masked_text") -> DataFrame:
    """K3-K7: adds out_name, out_mime, out_content and out_base64."""
    if kind == "md":
        content = F.encode(F.col(text), "UTF-8")
    elif kind == "docx":
        content = F.pandas_udf(lambda s: s.map(lambda t: None if t is None else _docx(t)), "binary")(F.col(text))
    else:
        raise ValueError("the writers are docx and md")
    return masked.withColumn("out_name", masked_name(name, kind)).withColumn("out_mime", F.lit(MIME[".docx"] if kind == "docx" else "text/plain")).withColumn("out_content", content).withColumn("out_base64", F.base64("out_content"))
