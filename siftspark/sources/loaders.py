"""Sources: files to paragraphs, validation of uploads, and what is written.

Paragraphs are rows (doc_id, pos, type, content, page, line_start, line_end, heading_level,
heading, language). Loaders parse one file at a time in Arrow batches; dispatch, validation and
tables' text are Column expressions.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.functions import text as T
from siftspark.sources import pdf
from siftspark.sources.layout import OCR_CHARS, OCR_SHARE

PARAGRAPH = "type string, content string, page int, line_start int, line_end int, heading_level int, heading string, language string"
LOADED = f"doc_id long, title string, pos int, {PARAGRAPH}"
_LOADED = pa.schema([("doc_id", pa.int64()), ("title", pa.string()), ("pos", pa.int32()), ("type", pa.string()), ("content", pa.string()), *[(n, pa.int32()) for n in ("page", "line_start", "line_end", "heading_level")], ("heading", pa.string()), ("language", pa.string())])
#: Characters of a batch that a loader gives.
_BATCH = 4 << 20
MAX_UPLOAD_BYTES = 104_857_600

_ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})\s*([^`\s]*)[^`]*$")
_DELIMITER = re.compile(r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$")
_IMAGE = re.compile(r"!\[([^\]]*)\]\([^)]*\)")
_LINK = re.compile(r"\[([^\]]*)\]\([^)]*\)")
_MARKS = re.compile(r"(\*\*|__|\*|_|`+)(?=\S)(.+?)(?<=\S)\1")


def inline_text(text: str) -> str:
    """Text without emphasis, links and code marks; an image gives its alternative text."""
    text = _LINK.sub(r"\1", _IMAGE.sub(r"\1", text))
    while (plain := _MARKS.sub(r"\2", text)) != text:
        text = plain
    return re.sub(r"(?: {2,}|\\)\n", "\n", text)


def _cells(line: str) -> list[str]:
    line = line.strip().removeprefix("|")
    return [inline_text(c.strip().replace("\\|", "|")) for c in re.split(r"(?<!\\)\|", line.removesuffix("|"))]


def table_lines(lines: list[str]) -> str:
    """A Markdown table's cells, one per line; the delimiter row is left out."""
    return "\n".join(c for k, line in enumerate(lines) if k != 1 for c in _cells(line))


def markdown_blocks(text: str) -> Iterator[dict]:
    """Headings, fenced code, tables and paragraphs. Lines run from 1, with one blank line between blocks."""
    lines = text.split("\n")
    at, line_no = 0, 1

    def block(kind: str, content: str, **more) -> dict:
        nonlocal line_no
        n = content.count("\n") + 1
        out = {"type": kind, "content": content, "line_start": line_no, "line_end": line_no + n - 1} | more
        line_no += n + 1
        return out

    while at < len(lines):
        line = lines[at]
        if not line.strip():
            at += 1
        elif m := _FENCE.match(line):
            end = at + 1
            while end < len(lines) and not re.match(rf"^ {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}\s*$", lines[end]):
                end += 1
            yield block("code", "\n".join(lines[at + 1 : end]), language=m[2] or None)
            at = end + 1
        elif m := _ATX.match(line):
            heading = inline_text((m[2] or "").strip())
            yield block("markdown", heading, heading_level=len(m[1]), heading=heading)
            at += 1
        elif "|" in line and at + 1 < len(lines) and "-" in lines[at + 1] and _DELIMITER.match(lines[at + 1]) and len(_cells(line)) == len(_cells(lines[at + 1])):
            end = at + 2
            while end < len(lines) and "|" in lines[end] and lines[end].strip():
                end += 1
            yield block("table", table_lines(lines[at:end]))
            at = end
        else:
            end = at + 1
            while end < len(lines) and lines[end].strip() and not _ATX.match(lines[end]) and not _FENCE.match(lines[end]):
                if re.match(r"^ {0,3}(=+|-+)\s*$", lines[end]):
                    break
                end += 1
            content = inline_text("\n".join(x.strip() for x in lines[at:end]))
            if end < len(lines) and (m := re.match(r"^ {0,3}(=+|-+)\s*$", lines[end])):
                yield block("markdown", content, heading_level=1 if m[1][0] == "=" else 2, heading=content)
                end += 1
            else:
                yield block("markdown", content)
            at = end


def first_title(blocks: list[dict]) -> str:
    """The first heading of level 1, else the first paragraph's first line, 300 characters at most."""
    for b in blocks:
        if b.get("heading_level") == 1:
            return b["content"]
    return blocks[0]["content"].split("\n")[0][:300] if blocks else ""


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _docx_body(raw: bytes | None) -> list:
    """The children of a DOCX file's body; ValueError if there is none to be read."""
    try:
        with zipfile.ZipFile(io.BytesIO(raw or b"")) as z:
            body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, EOFError, OSError, RuntimeError, NotImplementedError, zlib.error) as e:
        raise ValueError("DOCX_UNREADABLE") from e
    return list(body) if body is not None else []


def docx_blocks(raw: bytes | None) -> list[dict]:
    """Paragraphs and tables of a DOCX file in the body's order, lines counted from 1 with a blank one between them.

    Heading styles give levels, Title and Subtitle level 1. A file that can't be read gives its code as the one block.
    """
    try:
        body = _docx_body(raw)
    except ValueError as e:
        return [{"type": "error", "content": str(e)}]
    text = lambda node: "".join(t.text or "" for t in node.iter(f"{_W}t")).strip()
    found: list[dict] = []
    for node in body:
        if node.tag == f"{_W}tbl":
            found.append({"type": "table", "content": pipe_rows([[text(cell) for cell in row.iter(f"{_W}tc")] for row in node.iter(f"{_W}tr")])})
        elif node.tag == f"{_W}p":
            style = node.find(f"{_W}pPr/{_W}pStyle")
            name = (style.get(f"{_W}val") if style is not None else "") or ""
            level = 1 if name.lower() in ("title", "subtitle") else int(m[1]) if (m := re.match(r"(?i)heading\s*(\d+)", name)) else None
            kind = "code" if "code" in name.lower() else "markdown" if level else "text"
            found.append({"type": kind, "content": text(node), "heading_level": level, "heading": text(node) if level else None, "style": name})
    out, line = [], 1
    for block in found:
        if block["content"]:
            n = block["content"].count("\n") + 1
            out.append(block | {"line_start": line, "line_end": line + n - 1})
            line += n + 1
    return out


def pipe_rows(rows: list[list[str]]) -> str:
    lines = ["| " + " | ".join(r) + " |" for r in rows]
    return "\n".join([*lines[:1], *(["| " + " | ".join(["---"] * len(rows[0])) + " |"] if rows else []), *lines[1:]])


def pipe_table(rows: Column) -> Column:
    """The same of an array of rows."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(F.get(rows, 0), lambda _: F.lit("---")), " | "), F.lit(" |"))
    lines = F.transform(rows, line)
    return F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, 1_000_000_000)), "\n")


def _loaded(found: Iterable[tuple[object, str, list[dict]]]) -> Iterator[pa.RecordBatch]:
    """(id, title, blocks) of documents to paragraphs; a batch is of many documents, some MB of text at a time."""
    columns, size = [[] for _ in _LOADED.names], 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _LOADED.types, strict=True)], schema=_LOADED)

    for doc, title, blocks in found:
        for k, block in enumerate(blocks):
            for column, value in zip(columns, (doc, title, k, *map(block.get, _LOADED.names[3:])), strict=True):
                column.append(value)
            size += 200 + len(title) + len(block["content"]) + len(block.get("heading") or "")
            if size > _BATCH:
                yield out()
                columns, size = [[] for _ in columns], 0
    if columns[0]:
        yield out()


def _load(rows: DataFrame, parsed: Callable[[object], tuple[str, list[dict]]]) -> DataFrame:
    """Paragraphs of (doc_id, content), by what gives a content's title and blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _loaded((doc.as_py(), *parsed(content.as_py())) for b in batches for doc, content in zip(b.column(0), b.column(1), strict=True))

    return rows.mapInArrow(run, LOADED)


def load_markdown(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Paragraphs of Markdown texts; an empty text has none."""

    def parsed(text: str) -> tuple[str, list[dict]]:
        blocks = list(markdown_blocks(text))
        return first_title(blocks), blocks

    return _load(documents.select(F.col(id_col).cast("long").alias("doc_id"), T.line_feeds(F.col(text_col)).alias("text")), parsed)


def load_docx(files: DataFrame, id_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    """Paragraphs of DOCX files' bytes. The title is the Title paragraph, else the first of level 1, else the first line. A file that can't be read has one of type error with the code."""

    def parsed(raw: bytes | None) -> tuple[str, list[dict]]:
        blocks = docx_blocks(raw)
        named = [b["content"] for b in blocks if b.get("style", "").lower() == "title"]
        return named[0] if named else first_title(blocks), blocks

    return _load(files.select(F.col(id_col).cast("long").alias("doc_id"), content_col), parsed)


def load_plain(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every line a paragraph; built-ins only."""
    lines = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.posexplode(F.split(T.line_feeds(F.col(text_col)), "\n")).alias("line", "content"))
    empty = {n.split()[0]: F.lit(None).cast(n.split()[1]) for n in PARAGRAPH.split(", ")}
    own = empty | {"type": F.lit("text"), "content": F.col("content"), "line_start": F.col("line") + 1, "line_end": F.col("line") + 1}
    return lines.filter("content <> ''").select("doc_id", F.lit("").alias("title"), F.col("line").alias("pos"), *[c.alias(n) for n, c in own.items()])


def pdf_blocks(raw: bytes) -> list[dict]:
    """Paragraphs of a PDF file's text layer, with a blank line between them in the count; a file that can't be read, or needs a scan's text recognised, gives its code as the one paragraph."""
    try:
        found = pdf.blocks(raw)
    except pdf.Unsupported as e:
        return [{"type": "error", "content": e.code}]
    out, line = [], 1
    for page, blocks in enumerate(found, 1):
        for content in (text.replace("\x00", "").strip() for _, _, text in blocks):
            if content:
                n = content.count("\n") + 1
                out.append({"type": "text", "content": content, "page": page, "line_start": line, "line_end": line + n - 1})
                line += n + 1
    empty = 1 - len({b["page"] for b in out}) / len(found) if found else 1.0
    if empty > OCR_SHARE and sum(len(b["content"]) for b in out) < OCR_CHARS:
        return [{"type": "error", "content": "OCR_REQUIRED" if found else "EMPTY_PDF"}]
    return out


def load_pdf(files: DataFrame, id_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    """Paragraphs of PDF files' bytes: blocks from the top, then from the left. Files without any have one of type error with the code."""

    def parsed(raw: bytes | None) -> tuple[str, list[dict]]:
        blocks = pdf_blocks(raw or b"")
        return first_title(blocks), blocks

    return _load(files.select(F.col(id_col).cast("long").alias("doc_id"), content_col), parsed)


LOADERS: dict[str, Callable[..., DataFrame]] = {".md": load_markdown, ".markdown": load_markdown, ".docx": load_docx, ".pdf": load_pdf}


def register(extension: str, loader: Callable[..., DataFrame]) -> None:
    LOADERS[extension.lower()] = loader


def loader_for(path: str) -> Callable[..., DataFrame]:
    extension = (re.search(r"(\.[^./\\]+)$", path) or [""])[0].lower()
    if extension not in LOADERS:
        raise ValueError(f"UNSUPPORTED_MEDIA_TYPE: {extension or path}")
    return LOADERS[extension]


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder with their extension, size, hash and problem: unsupported type, wrong beginning, or too large."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    extension = T.has_extension(F.col("path"))
    return files.select("path", extension.alias("extension"), F.length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"), upload_problem(extension, F.col("content")).alias("problem"), "content")


def upload_problem(extension: Column, content: Column) -> Column:
    """Null if a file can be taken; else the code of the first problem."""
    begins = lambda magic: F.hex(F.substring(content, 1, len(magic))) == magic.hex().upper()
    size = F.length(content)
    return (
        F.when(~extension.isin(".pdf", ".docx", ".md"), F.lit("UNSUPPORTED_MEDIA_TYPE"))
        .when(size > MAX_UPLOAD_BYTES, F.lit("FILE_TOO_LARGE"))
        .when(size < 1, F.lit("EMPTY_FILE"))
        .when((extension == ".pdf") & ~begins(b"%PDF-"), F.lit("BAD_MAGIC"))
        .when((extension == ".docx") & ~begins(b"PK\x03\x04"), F.lit("BAD_MAGIC"))
    )


def is_inside(root: str, path: Column) -> Column:
    """The path names something below root and has no parent parts."""
    return F.startswith(path, F.lit(root.rstrip("/") + "/")) & ~path.rlike(r"(^|/)\.\.(/|$)")
