"""Table functions for SQL text: what takes one text apart, by name, with lateral joins.

    sql_functions.register(spark)
    spark.sql("select d.doc_id, c.* from documents d, lateral sift_chunks(d.text, 800) c")

A null text gives no rows. Limits are constants; what they must be is checked when a query is
analysed. Rows go to and from Python in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from siftspark.config import ChunkConfig
from siftspark.functions import sentences
from siftspark.operators import chunking
from siftspark.sources import loaders



def _schema(columns: str) -> S.StructType:
    """Of names and types; analysis runs where there is no session that could parse them."""
    kinds = {"int": S.IntegerType(), "string": S.StringType(), "boolean": S.BooleanType()}
    return S.StructType([S.StructField(n, kinds[t]) for n, t in map(str.split, columns.split(", "))])


CHUNKS = _schema("chunk_index int, kind string, raw_content string, character_count int, line_start int, line_end int, hard_split boolean")
SENTENCES = _schema("position int, sentence string, cut boolean")
BLOCKS = _schema("pos int, type string, content string, line_start int, line_end int, heading_level int")


def _limit(at: AnalyzeArgument, least: int) -> None:
    if not at.isConstantExpression or at.value is None or not isinstance(at.value, int) or at.value < least:
        raise ValueError(f"a limit is a constant whole number of {least} at least")


def _checked(schema: S.StructType, kind: type[S.DataType], defaults: int, first: AnalyzeArgument, *limits: AnalyzeArgument) -> AnalyzeResult:
    if not isinstance(first.dataType, (kind, S.NullType)):
        raise ValueError(f"the first argument is a {kind.typeName()}, not a {first.dataType.simpleString()}")
    if len(limits) > defaults:
        raise ValueError(f"{defaults} limits at most")
    for x in limits:
        _limit(x, 1)
    return AnalyzeResult(schema)


def _lines(text: str) -> str:
    """Line ends as the loaders have them."""
    return text.replace("\r\n", "\n").replace("\r", "\n").replace("\x00", "")


class Chunks:
    """sift_chunks(text[, characters of a chunk[, characters of a small document]]): lines are paragraphs."""

    @staticmethod
    def analyze(text: AnalyzeArgument, *limits: AnalyzeArgument) -> AnalyzeResult:
        return _checked(CHUNKS, S.StringType, 2, text, *limits)

    def eval(self, text: str, most: int = ChunkConfig.max_chunk_chars, small: int = ChunkConfig.small_document_chars) -> Iterator[tuple]:
        if text is None:
            return
        body = [{"type": "text", "content": x, "line_start": k, "line_end": k} for k, x in enumerate(_lines(text).split("\n"), 1) if x]
        for c in chunking.chunk(body, ChunkConfig(max_chunk_chars=most, small_document_chars=small)):
            yield c["chunk_index"], c["kind"], c["raw_content"], len(c["raw_content"]), c["line_start"], c["line_end"], c["hard_split"]


class Sentences:
    """sift_sentences(text[, characters of a sentence])."""

    @staticmethod
    def analyze(text: AnalyzeArgument, *limits: AnalyzeArgument) -> AnalyzeResult:
        return _checked(SENTENCES, S.StringType, 1, text, *limits)

    def eval(self, text: str, most: int = 800) -> Iterator[tuple]:
        for k, (sentence, cut) in enumerate(sentences.split(text, most) if text is not None else ()):
            yield k, sentence, cut


class Markdown:
    """sift_markdown(text): headings, code, tables and paragraphs."""

    @staticmethod
    def analyze(text: AnalyzeArgument) -> AnalyzeResult:
        return _checked(BLOCKS, S.StringType, 0, text)

    def eval(self, text: str) -> Iterator[tuple]:
        for k, b in enumerate(loaders.markdown_blocks(_lines(text)) if text is not None else ()):
            yield k, b["type"], b["content"], b["line_start"], b["line_end"], b.get("heading_level")


class Docx:
    """sift_docx(content): paragraphs and tables of a DOCX file, or one row of type error."""

    @staticmethod
    def analyze(content: AnalyzeArgument) -> AnalyzeResult:
        return _checked(BLOCKS, S.BinaryType, 0, content)

    def eval(self, content: bytes) -> Iterator[tuple]:
        for k, b in enumerate(loaders.docx_blocks(content) if content is not None else ()):
            yield k, b["type"], b["content"], b.get("line_start"), b.get("line_end"), b.get("heading_level")


FUNCTIONS = {"sift_chunks": Chunks, "sift_sentences": Sentences, "sift_markdown": Markdown, "sift_docx": Docx}


def register(spark: SparkSession) -> None:
    for name, f in FUNCTIONS.items():
        spark.udtf.register(name, F.udtf(f, useArrow=True))
