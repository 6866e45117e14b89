"""Chunking: paragraphs of a document become retrieval units.

Sections, small documents and runs of text are relational; merging sentences up to a limit
depends on what was merged before, so it runs over one document at a time in Arrow batches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftspark.config import ChunkConfig
from siftspark.functions import sentences
from siftspark.functions import text as T

CHUNK = "chunk_index int, kind string, section_path array<string>, raw_content string, page_start int, page_end int, line_start int, line_end int, parent_chunk_index int, hard_split boolean, fragment boolean, code_not_add_index boolean"
_NAMES = [x.split()[0] for x in CHUNK.split(", ")]
_TYPES = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
_CHUNKS = pa.schema([("doc_id", pa.int64()), ("title", pa.string()), *((n, _TYPES[t]) for n, t in (x.split() for x in CHUNK.split(", ")))])
#: Characters of a batch of chunks, and what a chunk counts beside its text.
_BATCH, _ROW = 1 << 20, 500


def merge_sentences(text: str, cfg: ChunkConfig) -> list[tuple[str, bool]]:
    """Sentences joined by spaces while at most max_sentences and, without the last space, max_chunk_chars; flags of hard cuts."""
    found = sentences.split(text, cfg.max_chunk_chars)
    numbers = sentences.piece_numbers([len(s) for s, _ in found], cfg.max_chunk_chars, 1, joint_counts=False, members=cfg.max_sentences)
    runs = [list(g) for _, g in groupby(zip(numbers, found, strict=True), key=lambda t: t[0])]
    return [(" ".join(s for _, (s, _) in run), any(cut for _, (_, cut) in run)) for run in runs]


def table_parts(text: str, cfg: ChunkConfig) -> list[tuple[str, bool]]:
    """A table as it is if it fits, else parts that repeat its first two lines."""
    if len(text) <= cfg.max_chunk_chars:
        return [(text, False)]
    lines = text.split("\n")
    head, rows = "".join(f"{x}\n" for x in lines[:2]), lines[2:]
    numbers = sentences.piece_numbers([len(r) + 1 for r in rows], cfg.max_chunk_chars - len(head), 0)
    return [(head + "\n".join(r for _, r in part), True) for _, part in groupby(zip(numbers, rows, strict=True), key=lambda t: t[0])]


def sections(paragraphs: list[dict], levels: int) -> list[tuple[int, dict | None, list[str]]]:
    """(section number, paragraph or None for a heading, path): headings nest by level, skipped levels under the nearest lower one."""
    stack: list[tuple[int, list[str]]] = [(0, [])]
    out, number = [], 0
    for p in paragraphs:
        level = p.get("heading_level")
        if level and level > 0:
            level = min(int(level), levels)
            while stack[-1][0] >= level:
                stack.pop()
            stack.append((level, [*stack[-1][1], p.get("heading") or p["content"]]))
            number += 1
            out.append((number, None, stack[-1][1]))
        else:
            out.append((number, p, stack[-1][1]))
    return out


def _least(values: Iterator) -> int | None:
    return min((int(v) for v in values if v and v == v), default=None)


def _most(values: Iterator) -> int | None:
    return max((int(v) for v in values if v and v == v), default=None)


def chunk(paragraphs: list[dict], cfg: ChunkConfig) -> list[dict]:
    """The chunks of one document's paragraphs."""
    if not paragraphs:
        return []
    if sum(len(p["content"]) for p in paragraphs) <= cfg.small_document_chars:
        heading = next(([p.get("heading") or p["content"]] for p in paragraphs if (p.get("heading_level") or 0) > 0), [])
        pick = lambda f, name: f(p.get(name) for p in paragraphs)
        return [_chunk(0, "text", heading, "\n\n".join(p["content"] for p in paragraphs), pick(_least, "page"), pick(_most, "page"), pick(_least, "line_start"), pick(_most, "line_end"))]
    placed = sections(paragraphs, cfg.heading_levels)
    filled = {n for n, p, _ in placed if p is not None}
    out: list[dict] = []
    titles: dict[tuple[str, ...], int] = {}
    for number, p, path in placed:
        if p is None and number in filled and path[-1]:
            titles[tuple(path)] = len(out)
            out.append(_chunk(len(out), "title", path, path[-1]))
    run: list[dict] = []
    last: tuple[int, list[str]] = (0, [])

    def add(kind: str, text: str, path: list[str], first: dict, end: dict, **more) -> None:
        out.append(_chunk(len(out), kind, path, text, first.get("page"), end.get("page"), first.get("line_start"), end.get("line_end"), titles.get(tuple(path)), **more))

    def flush() -> None:
        if run:
            for text, hard in merge_sentences("\n".join(p["content"] for p in run if p["content"].strip()), cfg):
                add("text", text, last[1], run[0], run[-1], hard_split=hard or None)
            run.clear()

    for number, p, path in placed:
        if p is None:
            continue
        kind = p["type"] if p["type"] != "table" or p["content"].count("\n") else "text"
        if run and (number != last[0] or kind in ("table", "code") or p.get("page") != run[-1].get("page")):
            flush()
        last = (number, path)
        if kind == "table":
            for text, part in table_parts(p["content"], cfg):
                add("table", text, path, p, p, fragment=part or None)
        elif kind == "code":
            add("code", p["content"], path, p, p, code_not_add_index=None if cfg.index_code else True)
        else:
            run.append(p)
            if p["type"] == "table":
                flush()
    flush()
    return out


def _chunk(index: int, kind: str, path: list[str], text: str, page_start=None, page_end=None, line_start=None, line_end=None, parent=None, **more) -> dict:
    own = dict(zip(_NAMES, [index, kind, list(path), text, page_start, page_end, line_start, line_end, parent], strict=False))
    return own | {n: more.get(n) for n in _NAMES[9:]}


def _finished(chunks: DataFrame, cfg: ChunkConfig) -> DataFrame:
    """Adds what follows from a chunk's text: its hash, id, size and indexed text."""
    return chunks.select(
        F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")), 256).alias("chunk_id"),
        "doc_id", "title", *_NAMES,
        T.retrieval_content(F.col("title"), F.col("section_path"), F.col("raw_content"), cfg.retrieval_chars).alias("retrieval_content"),
        F.sha2("raw_content", 256).alias("content_hash"),
        F.length("raw_content").alias("character_count"),
    )


def _run(batches: Iterator[pa.RecordBatch], parse, cfg: ChunkConfig) -> Iterator[pa.RecordBatch]:
    """One document at a time; what is given out is some MB of chunks."""
    rows, size = [], 0
    for b in batches:
        for doc, title, body in zip(b.column(0), b.column(1), b.column(2), strict=True):
            own = {"doc_id": doc.as_py(), "title": title.as_py()}
            for c in chunk(parse(body.as_py()), cfg):
                rows.append(own | c)
                size += _ROW + len(c["raw_content"]) + sum(map(len, c["section_path"]))
                if size > _BATCH:
                    yield pa.RecordBatch.from_pylist(rows, schema=_CHUNKS)
                    rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=_CHUNKS)


def chunk_texts(documents: DataFrame, cfg: ChunkConfig | None = None, id_col: str = "doc_id", text_col: str = "text", title: Column | None = None) -> DataFrame:
    """Chunks of plain texts whose lines are paragraphs. A document is a row, so nothing is shuffled."""
    cfg = cfg or ChunkConfig()

    def parse(text: str) -> list[dict]:
        return [{"type": "text", "content": line, "line_start": k + 1, "line_end": k + 1} for k, line in enumerate(text.split("\n")) if line]

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), (title if title is not None else F.lit("")).alias("title"), T.line_feeds(F.col(text_col)).alias("text"))
    return _finished(rows.mapInArrow(lambda b: _run(b, parse, cfg), f"doc_id long, title string, {CHUNK}"), cfg)


def chunk_paragraphs(paragraphs: DataFrame, cfg: ChunkConfig | None = None) -> DataFrame:
    """Chunks of loaded paragraphs (doc_id, title, pos, ...): a document's are gathered, which its size bounds."""
    cfg = cfg or ChunkConfig()
    fields = ["pos", "type", "content", "page", "line_start", "line_end", "heading_level", "heading"]
    docs = paragraphs.groupBy("doc_id").agg(F.first("title").alias("title"), F.array_sort(F.collect_list(F.struct(*fields))).alias("body"))
    return _finished(docs.mapInArrow(lambda b: _run(b, list, cfg), f"doc_id long, title string, {CHUNK}"), cfg)


def small_documents(documents: DataFrame, cfg: ChunkConfig | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The single chunk of each small document, by built-ins only: (doc_id, raw_content, content_hash, character_count)."""
    cfg = cfg or ChunkConfig()
    lines = F.filter(F.split(T.line_feeds(F.col(text_col)), "\n"), lambda x: x != "")
    total = F.aggregate(lines, F.lit(0), lambda a, x: a + F.length(x))
    raw = F.array_join(lines, "\n\n")
    return documents.filter((F.size(lines) > 0) & (total <= cfg.small_document_chars)).select(F.col(id_col).alias("doc_id"), raw.alias("raw_content"), F.sha2(raw, 256).alias("content_hash"), F.length(raw).cast("long").alias("character_count"))


def heading_paths(paragraphs: DataFrame, levels: int = 10) -> DataFrame:
    """Adds section_path to paragraphs by windows: the last heading of each level since the last one of a lower level."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    level = F.when(F.col("heading_level") > 0, F.least("heading_level", F.lit(levels)))
    out = paragraphs.withColumn("_level", level)
    text = F.coalesce("heading", "content")
    for k in range(1, levels + 1):
        # a heading of this level holds until one of this level or above follows
        mark = F.when(F.col("_level") == k, F.struct(F.col("pos"), text.alias("text"))).when(F.col("_level") < k, F.struct(F.col("pos"), F.lit(None).cast("string").alias("text")))
        out = out.withColumn(f"_h{k}", F.last(mark, ignorenulls=True).over(w)["text"])
    path = F.filter(F.array(*[F.col(f"_h{k}") for k in range(1, levels + 1)]), lambda x: x.isNotNull())
    return out.withColumn("section_path", path).drop("_level", *[f"_h{k}" for k in range(1, levels + 1)])


def text_runs(paragraphs: DataFrame) -> DataFrame:
    """Runs of text in one section and page, tables and code alone: gaps and islands."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    alone = F.col("type").isin("table", "code")
    change = alone | F.lag(alone).over(w) | ~F.lag("section_path").over(w).eqNullSafe(F.col("section_path")) | ~F.lag("page").over(w).eqNullSafe(F.col("page"))
    run = F.sum(F.coalesce(change, F.lit(True)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = paragraphs.filter("coalesce(heading_level, 0) = 0").withColumn("run", run)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda x: x["content"]), "\n")
    return marked.groupBy("doc_id", "run").agg(F.first("type").alias("type"), F.first("section_path").alias("section_path"), F.min("page").alias("page"), F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end"), joined.alias("content"))


def chunk_problems(chunks: DataFrame) -> DataFrame:
    """Repeated indexes, missing parents and impossible ranges: (doc_id, chunk_index, code)."""
    twice = chunks.groupBy("doc_id", "chunk_index").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id", "chunk_index", F.lit("DUPLICATE_INDEX").alias("code"))
    own = chunks.select("doc_id", F.col("chunk_index").alias("parent_chunk_index"))
    orphan = chunks.filter("parent_chunk_index is not null").join(own, ["doc_id", "parent_chunk_index"], "left_anti").select("doc_id", "chunk_index", F.lit("PARENT_MISSING").alias("code"))
    bad = chunks.filter("page_end < page_start or line_end < line_start or chunk_index < 0").select("doc_id", "chunk_index", F.lit("RANGE_INVALID").alias("code"))
    kind = chunks.filter(~F.col("kind").isin("text", "title", "table", "code", "chapter")).select("doc_id", "chunk_index", F.lit("KIND_INVALID").alias("code"))
    return twice.unionByName(orphan).unionByName(bad).unionByName(kind)


def hash_text(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
