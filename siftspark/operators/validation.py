"""Checks of parsed documents. Each returns its violations (document_id, ref, code); none fails a job.

pages: (document_id, page, width, height); elements: (document_id, element_id, reading_order,
kind, text, normalized_text, parent_id, provenance array<struct<page, x0, y0, x1, y1>>, has_table).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftspark import shared
from siftspark.functions import tables as tab
from siftspark.operators.indexing import parser_signature

#: Points by which a box may leave its page.
TOLERANCE = 0.5


def _found(rows: DataFrame, ref: Column, code: str) -> DataFrame:
    return rows.select("document_id", ref.cast("string").alias("ref"), F.lit(code).alias("code"))


def page_sequence(pages: DataFrame) -> DataFrame:
    """Pages that don't run from 1 without gaps."""
    n = F.row_number().over(Window.partitionBy("document_id").orderBy("page"))
    return _found(pages.withColumn("n", n).filter("n <> page"), F.col("page"), "PAGE_SEQUENCE")


def reading_order(elements: DataFrame) -> DataFrame:
    """Orders that don't run from 0 without gaps or repetitions."""
    n = F.row_number().over(Window.partitionBy("document_id").orderBy("reading_order", "element_id")) - 1
    return _found(elements.withColumn("n", n).filter("n <> reading_order"), F.col("element_id"), "READING_ORDER")


def element_ids(elements: DataFrame) -> DataFrame:
    twice = elements.groupBy("document_id", "element_id").agg(F.count("*").alias("n")).filter("n > 1")
    return _found(twice, F.col("element_id"), "ELEMENT_ID_DUPLICATE")


def page_references(elements: DataFrame, pages: DataFrame) -> DataFrame:
    used = elements.select("document_id", "element_id", F.explode("provenance").alias("p")).select("document_id", "element_id", F.col("p.page").alias("page"))
    return _found(used.join(pages.select("document_id", "page"), ["document_id", "page"], "left_anti").dropDuplicates(["document_id", "element_id"]), F.col("element_id"), "ELEMENT_REF_MISSING")


def provenance(elements: DataFrame) -> DataFrame:
    return _found(elements.filter("coalesce(size(provenance), 0) <= 0"), F.col("element_id"), "PROVENANCE_MISSING")


def boxes(elements: DataFrame, pages: DataFrame) -> DataFrame:
    used = elements.select("document_id", "element_id", F.explode("provenance").alias("p")).select("document_id", "element_id", "p.*")
    out = (F.col("x0") < -TOLERANCE) | (F.col("y0") < -TOLERANCE) | (F.col("x1") > F.col("width") + TOLERANCE) | (F.col("y1") > F.col("height") + TOLERANCE)
    return _found(used.join(pages, ["document_id", "page"]).filter(out).dropDuplicates(["document_id", "element_id"]), F.col("element_id"), "BBOX_OUT_OF_BOUNDS")


def parents(elements: DataFrame, depth: int = 64) -> DataFrame:
    """Parents that don't exist, and cycles: chains that are still going on after ``depth`` doublings would be.

    Each round looks twice as far up, so a chain of 2**k elements takes k joins; an element on a
    cycle never reaches a root. Rounds are stored, so a task holds one join, and end when all have reached one.
    """
    links = shared.stored(elements.select("document_id", "element_id", "parent_id"), "links")
    have = links.select("document_id", F.col("element_id").alias("parent_id"))
    missing = _found(links.filter("parent_id is not null").join(have, ["document_id", "parent_id"], "left_anti"), F.col("element_id"), "PARENT_MISSING")
    up = shared.stored(links.filter("parent_id is not null").join(have, ["document_id", "parent_id"], "left_semi").select("document_id", "element_id", F.col("parent_id").alias("far")), "up")
    for _ in range(max(1, depth.bit_length())):
        if not up.head(1):
            break
        again = up.select("document_id", F.col("element_id").alias("far"), F.col("far").alias("further"))
        up = shared.stored(up.join(again, ["document_id", "far"]).select("document_id", "element_id", F.col("further").alias("far")), "up")
    return missing.unionByName(_found(up, F.col("element_id"), "PARENT_CYCLE"))


def tables(cells: DataFrame, shapes: DataFrame) -> DataFrame:
    """Header rows out of range, repeated cell ids, cells out of bounds, overlaps and Markdown that isn't canonical.

    shapes: (document_id, table_id, row_count, column_count, header_rows, markdown).
    """
    # a table's rows are made once and meet its shape by its id alone, as its cells do; each row gives its codes
    said = lambda flag, code: F.when(flag, F.lit(code))
    both = shapes.join(tab.table_rows(cells), "table_id", "left")
    heads = F.exists("header_rows", lambda h: (h < 0) | (h >= F.col("row_count")))
    wrong = F.col("markdown") != tab.markdown_of()
    codes = F.array_compact(F.array(said(heads, "TABLE_HEADER_ROW_INVALID"), said(F.col("overlap"), "TABLE_OVERLAP"), said(wrong, "TABLE_MARKDOWN_MISMATCH")))
    of_tables = both.select("document_id", F.col("table_id").cast("string").alias("ref"), F.explode(codes).alias("code"))
    own = cells.select("table_id", "cell_id", "row", "col", "row_span", "col_span").join(shapes.select("document_id", "table_id", "row_count", "column_count"), "table_id")
    out = F.expr("row < 0 or col < 0 or row + row_span > row_count or col + col_span > column_count")
    counted = own.groupBy("document_id", "table_id", "cell_id").agg(F.count("*").alias("n"), F.count_if(out).alias("out")).filter("n > 1 or out > 0")
    codes = F.array_compact(F.concat(F.array(said(F.col("n") > 1, "TABLE_CELL_ID_DUPLICATE")), F.array_repeat(F.lit("TABLE_CELL_OUT_OF_BOUNDS"), F.col("out").cast("int"))))
    return of_tables.unionByName(counted.select("document_id", F.col("cell_id").cast("string").alias("ref"), F.explode(codes).alias("code")))


def _nul() -> Column:
    return F.contains(F.coalesce("text", F.lit("")), F.lit("\x00")) | F.contains(F.coalesce("normalized_text", F.lit("")), F.lit("\x00"))


def nul_characters(elements: DataFrame) -> DataFrame:
    return _found(elements.filter(_nul()), F.col("element_id"), "TEXT_NUL")


def manifest_problems(manifest: dict) -> list[str]:
    """Codes of a parser manifest: unpinned revisions, or a signature that doesn't follow from it."""
    found = [] if manifest.get("parser_version") else ["REVISION_EMPTY"]
    for name in manifest.get("model_ids", {}):
        revision = manifest.get("model_revisions", {}).get(name, "")
        found += ["REVISION_EMPTY"] if not revision else ["REVISION_UNKNOWN"] if revision in ("unknown", "latest", "main") else []
    made = parser_signature(manifest["parser_id"], manifest.get("parser_version", ""), manifest.get("model_ids"), manifest.get("model_revisions"), manifest.get("options"))
    return found + (["SIGNATURE_MISMATCH"] if manifest.get("signature") != made else [])


def signature() -> Column:
    """The signature of a row's manifest (parser_id, parser_version, model_ids, model_revisions): see indexing.parser_signature."""
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    body = F.struct(F.lit(2).alias("ir_schema_version"), "model_ids", "model_revisions", F.lit("unicode-v2").alias("normalizer"), empty.alias("options"), "parser_id", "parser_version")
    return F.sha2(F.to_json(body), 256)


def manifests(rows: DataFrame) -> DataFrame:
    """(parser_id, code): manifest_problems of a table of manifests with their signatures; maps have their keys in order."""
    said = F.transform(F.map_keys("model_ids"), lambda m: F.coalesce(F.try_element_at("model_revisions", m), F.lit("")))
    loose = F.flatten(F.array(F.when(F.col("parser_version") == "", F.array(F.lit("REVISION_EMPTY"))).otherwise(F.array().cast("array<string>")), F.transform(said, lambda r: F.when(r == "", F.lit("REVISION_EMPTY")).when(r.isin("unknown", "latest", "main"), F.lit("REVISION_UNKNOWN")))))
    codes = F.concat(loose, F.array(F.when(F.col("signature") != signature(), F.lit("SIGNATURE_MISMATCH"))))
    return rows.select("parser_id", F.explode(F.array_compact(codes)).alias("code"))


def hard_failures(quality: DataFrame) -> DataFrame:
    return _found(quality.filter("coalesce(size(hard_failures), 0) > 0"), F.array_join("hard_failures", ","), "HARD_FAILURES_PRESENT")


def all_problems(pages: DataFrame, elements: DataFrame) -> DataFrame:
    """Every check. Elements are made once and stored without their texts, which only the check for NUL reads."""
    slim = shared.stored(elements.select("document_id", "element_id", "reading_order", "parent_id", "provenance", _nul().alias("nul")), "elements")
    pages = shared.stored(pages, "pages")
    nul = _found(slim.filter("nul"), F.col("element_id"), "TEXT_NUL")
    return _union([page_sequence(pages), reading_order(slim), element_ids(slim), page_references(slim, pages), provenance(slim), boxes(slim, pages), parents(slim), nul])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
