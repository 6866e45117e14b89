"""Table structure: a table is one row per cell.

cells: (table_id, cell_id, row, col, row_span, col_span, text, is_header, is_column_header,
is_row_header). tables: (table_id, row_count, column_count, header_rows array<int>).
"""

from __future__ import annotations

import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from siftspark import shared
from siftspark.functions import text as T


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.trim(text), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def upto(n: Column) -> Column:
    """0 to n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _spread(cells: DataFrame) -> DataFrame:
    """Cells at each place (r, c) that they cover."""
    return cells.withColumn("r", F.explode(F.sequence("row", F.col("row") + F.col("row_span") - 1))).withColumn("c", F.explode(F.sequence("col", F.col("col") + F.col("col_span") - 1)))


def _place() -> Column:
    """A spread cell in the order in which cells own a place, with what it shows there."""
    header = F.when(F.trim("text") == "", F.concat(F.lit("column_"), F.col("c").cast("string"))).otherwise(escaped(F.col("text")))
    data = F.when((F.col("r") == F.col("row")) & (F.col("c") == F.col("col")), escaped(F.col("text")))
    return F.struct("c", "row", "col", "cell_id", F.when(F.col("is_header"), header).otherwise(data).alias("text"))


def grid_rows(cells: DataFrame, tables: DataFrame, rows: Column | None = None) -> DataFrame:
    """(table_id, r, texts): the rows of the dense grid, all or those named by an array of the tables.

    Of several cells on a place the first by (row, col) owns it. Cells meet as rows, and a table's cells
    that are in one partition already stay there up to the join.
    """
    own = cells
    if rows is not None:
        own = cells.join(tables.select("table_id", rows.alias("_rows")), "table_id").filter(F.exists("_rows", lambda h: (h >= F.col("row")) & (h < F.col("row") + F.col("row_span"))))
    spread = _spread(own)
    held = spread.groupBy("table_id", "r").agg(F.array_sort(F.collect_list(_place())).alias("xs"))
    first = F.filter("xs", lambda x, k: (k == 0) | (x["c"] != F.get("xs", k - 1)["c"]))
    shown = held.select("table_id", "r", F.map_from_entries(F.transform(first, lambda x: F.struct(x["c"], x["text"]))).alias("by_col"))
    every = upto(F.col("row_count")) if rows is None else F.array_distinct(F.filter(rows, lambda h: (h >= 0) & (h < F.col("row_count"))))
    places = tables.select("table_id", F.explode(every).alias("r"), "column_count")
    text = F.transform(upto(F.col("column_count")), lambda c: F.coalesce(F.element_at("by_col", c), F.lit("")))
    return places.join(shown, ["table_id", "r"], "left").select("table_id", "r", text.alias("texts"))


def grid(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """(table_id, r, c, text): the dense grid. Headers repeat over their span, empty ones are column_<c>; data stands at its origin only."""
    return grid_rows(cells, tables).select("table_id", "r", F.posexplode("texts").alias("c", "text"))


def empty_headers(cells: DataFrame) -> DataFrame:
    return cells.filter(F.col("is_header") & (F.trim("text") == "")).select("table_id", "cell_id")


def table_rows(cells: DataFrame) -> DataFrame:
    """(table_id, rows, overlap): a table's rows of the grid (r, cs, texts), and whether cells of several ids share a place.

    As in ``grid_rows``, the first of several cells on a place owns it. Only the table's id groups here.
    """
    spread = _spread(cells)
    held = spread.groupBy("table_id", "r").agg(F.sort_array(F.collect_list(_place())).alias("xs"))
    named = F.filter("xs", lambda x: x["cell_id"].isNotNull())
    pairs = lambda f: F.size(F.array_distinct(F.transform(named, f)))
    shared_place = pairs(lambda x: F.struct(x["c"], x["cell_id"])) > pairs(lambda x: x["c"])
    first = F.filter("xs", lambda x, k: (k == 0) | (x["c"] != F.get("xs", k - 1)["c"]))
    held = held.select("table_id", "r", first.alias("first"), F.when(F.size("xs") > F.size(first), shared_place).otherwise(F.lit(False)).alias("overlap"))
    row = F.struct("r", F.transform("first", lambda x: x["c"]).alias("cs"), F.transform("first", lambda x: F.coalesce(x["text"], F.lit(""))).alias("texts"))
    return held.groupBy("table_id").agg(F.collect_list(row).alias("rows"), F.bool_or("overlap").alias("overlap"))


def markdown_of() -> Column:
    """The Markdown of a table (rows, row_count, column_count, header_rows), null without rows: see ``markdown``."""
    every = upto(F.col("column_count"))
    line = lambda texts: F.concat(F.lit("| "), F.array_join(texts, " | "), F.lit(" |"))
    whole = lambda x: F.when(x["cs"] == every, x["texts"]).otherwise(F.transform(every, lambda c: F.coalesce(F.get(x["texts"], F.array_position(x["cs"], c).cast("int") - 1), F.lit(""))))
    own = F.filter(F.coalesce("rows", F.array().cast("array<struct<r:int,cs:array<int>,texts:array<string>>>")), lambda x: (x["r"] >= 0) & (x["r"] < F.col("row_count")))
    missing = F.array_except(upto(F.col("row_count")), F.transform(own, lambda x: x["r"]))
    blank = line(F.transform(every, lambda _: F.lit("")))
    lines = F.concat(F.transform(own, lambda x: F.struct(x["r"].alias("r"), line(whole(x)).alias("text"))), F.transform(missing, lambda r: F.struct(r.alias("r"), blank.alias("text"))))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.col("column_count")), " | "), F.lit(" |"))
    after = F.coalesce(F.array_max("header_rows"), F.lit(0)) + 1
    ruled = lambda xs: F.array_join(F.concat(F.slice(xs, F.lit(1), after), F.array(rule), F.slice(xs, after + 1, F.greatest(F.size(xs) - after, F.lit(0)))), "\n")
    return F.when(F.col("row_count") > 0, T.bound(F.transform(F.sort_array(lines), lambda x: x["text"]), ruled))


def markdown(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """(table_id, markdown): pipe rows with a rule after the last header row, or after row 0."""
    both = tables.join(table_rows(cells).select("table_id", "rows"), "table_id", "left")
    return both.filter("row_count > 0").select("table_id", markdown_of().alias("markdown"))


@F.pandas_udf(StringType())
def fingerprint(caption: pd.Series, header_rows: pd.Series, row_count: pd.Series, column_count: pd.Series, flat: pd.Series) -> pd.Series:
    """SHA-256 of the Python form of a table's caption, header rows, shape and grid (flat: the grid's cells, row by row)."""

    def one(caption, heads, n, m, cells):
        cells = list(cells)
        rows = [[str(x) for x in cells[k * m : (k + 1) * m]] for k in range(n)]
        body = {"caption": caption, "header_rows": sorted(int(h) for h in heads), "shape": (int(n), int(m)), "grid": rows}
        return hashlib.sha256(repr(body).encode()).hexdigest()

    return pd.Series([one(*x) for x in zip(caption, header_rows, row_count, column_count, flat, strict=True)])


def header_paths(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """(table_id, col, path): the header texts over a column from the top, neighbours that repeat once; else column_<c>."""
    return table_paths(cells, tables).select("table_id", F.posexplode("paths").alias("col", "path"))


def table_paths(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """(table_id, paths): the header paths of a table's columns, of which there are as many as a row has places."""
    head = cells.filter("is_column_header and trim(text) <> '' and col_span > 0").select("table_id", "row", "col", "row_span", "col_span", F.trim("text").alias("text"))
    over = head.join(tables.select("table_id", "column_count", "header_rows"), "table_id")
    over = over.withColumn("h", F.explode(F.filter("header_rows", lambda h: (h >= F.col("row")) & (h < F.col("row") + F.col("row_span")))))
    low, high = F.greatest("col", F.lit(0)), F.least(F.col("col") + F.col("col_span"), F.col("column_count")) - 1
    over = over.filter(low <= high).withColumn("c", F.explode(F.sequence(low, high)))
    listed = over.groupBy("table_id", "c").agg(F.array_sort(F.collect_list(F.struct("h", "row", "col", "text"))).alias("xs"))
    named = listed.select("table_id", F.struct("c", without_neighbours(F.transform("xs", lambda x: x["text"])).alias("path")).alias("p"))
    by_col = named.groupBy("table_id").agg(F.map_from_entries(F.collect_list("p")).alias("by_col"))
    path = lambda c: F.coalesce(F.element_at("by_col", c), F.array(F.concat(F.lit("column_"), c.cast("string"))))
    return tables.select("table_id", "column_count").join(by_col, "table_id", "left").select("table_id", F.transform(upto(F.col("column_count")), path).alias("paths"))


def without_neighbours(items: Column) -> Column:
    return F.filter(items, lambda x, k: (k == 0) | (x != F.get(items, k - 1)))


def row_headers(cells: DataFrame) -> DataFrame:
    """The cells that head each data row: the declared ones, else the row's first cell."""
    w = Window.partitionBy("table_id", "row")
    ranked = cells.withColumn("_any", F.max(F.col("is_row_header").cast("int")).over(w)).withColumn("_n", F.row_number().over(w.orderBy("col")))
    return ranked.filter(F.when(F.col("_any") == 1, F.col("is_row_header")).otherwise(F.col("_n") == 1)).drop("_any", "_n")


def row_chunks(cells: DataFrame, tables: DataFrame, max_chunk_chars: int = 800) -> DataFrame:
    """Row and group chunks of tables: (table_id, row, subtype, header_group, raw_content, retrieval_content, cell_ids).

    tables also has document_title, section (the path joined by ' > ') and label. A row of
    values gives a row chunk; also one chunk per top header if the table has several header
    rows, the text is too long, a group repeats, or several cells head the row.
    """
    # a row's cells are one row from here; what is the table's own joins them by table_id alone
    cell = F.struct("col", "text", "cell_id", "is_row_header")
    held = cells.groupBy("table_id", "row").agg(F.array_sort(F.collect_list(cell)).alias("cells"), F.coalesce(F.bool_or("is_row_header"), F.lit(False)).alias("declared"))
    names = F.transform("paths", lambda p: F.struct(F.array_join(p, " > ").alias("head"), F.get(p, 0).alias("top")))
    info = tables.select("table_id", "document_title", "section", "label", "header_rows", "column_count").join(table_paths(cells, tables).select("table_id", names.alias("names")), "table_id")
    rows = held.join(info, "table_id").filter(~F.array_contains("header_rows", F.col("row")))
    heads = lambda x, k: F.when(F.col("declared"), F.coalesce(x["is_row_header"], F.lit(False))).otherwise(k == 0)
    valued = F.filter("cells", lambda x, k: ~heads(x, k) & (F.trim(x["text"]) != "") & (x["col"] >= 0) & (x["col"] < F.col("column_count")))
    value = lambda x: F.struct(x["col"].alias("col"), F.get("names", x["col"])["head"].alias("head"), F.trim(x["text"]).alias("text"), x["cell_id"].alias("cell_id"), F.get("names", x["col"])["top"].alias("top"))
    rows = rows.select("table_id", "row", "document_title", "section", "label", F.size("header_rows").alias("n_header_rows"), F.filter("cells", heads).alias("heads"), F.array_sort(F.transform(valued, value)).alias("values"))
    tops = F.array_distinct(F.transform("values", lambda v: v["top"]))
    head_ids = F.transform(F.array_sort(F.transform("heads", lambda x: F.struct(x["col"], x["cell_id"]))), lambda x: x["cell_id"])
    label = F.array_join(F.filter(F.transform("heads", lambda x: F.trim(x["text"])), lambda x: x != ""), " > ")
    name = F.when(label != "", label).otherwise(F.concat(F.lit("row_"), F.col("row").cast("string")))
    rows = rows.select("table_id", "row", "document_title", "section", "label", "n_header_rows", "values", tops.alias("tops"), head_ids.alias("head_ids"), name.alias("name"))
    needs_groups = (F.col("n_header_rows") > 1) | (F.size("tops") < F.size("values")) | (F.size("head_ids") > 1) | (F.length(_said()) > max_chunk_chars)
    whole = F.array(F.struct(F.lit("table_row").alias("subtype"), F.lit(None).cast("string").alias("header_group"), F.col("values").alias("values")))
    parts = F.transform("tops", lambda t: F.struct(F.lit("table_group").alias("subtype"), t.alias("header_group"), F.filter("values", lambda v: v["top"] == t).alias("values")))
    chunks = F.when(F.size("values") > 0, F.when(needs_groups, F.concat(whole, parts)).otherwise(whole))
    listed = rows.select("table_id", "row", "document_title", "section", "label", "head_ids", "name", F.inline(chunks))
    line = lambda first, name_of: F.concat(F.lit("| "), F.array_join(F.concat(F.array(first), F.transform("values", name_of)), " | "), F.lit(" |"))
    raw = F.concat_ws("\n", line(F.lit("Row"), lambda v: v["head"]), line(F.lit("---"), lambda _: F.lit("---")), line(F.col("name"), lambda v: v["text"]))
    return listed.select("table_id", "row", "subtype", "header_group", raw.alias("raw_content"), _said().alias("retrieval_content"), F.concat("head_ids", F.transform("values", lambda v: v["cell_id"])).alias("cell_ids"))


def _said() -> Column:
    """What is indexed of a chunk of values: the table's labels, the row's name and each value under its header."""
    said = [F.concat(F.lit(f"{k}: "), F.coalesce(F.col(c), F.lit(""))) for k, c in (("Document", "document_title"), ("Section", "section"), ("Table", "label"), ("Row", "name"))]
    return F.array_join(F.concat(F.array(*said), F.transform("values", lambda v: F.concat(v["head"], F.lit(": "), v["text"]))), "\n")


def parent_chunks(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """The chunk of each table that isn't indexed: its labels and header lines."""
    lines = grid_rows(cells, tables, F.col("header_rows")).select("table_id", "r", F.array_join("texts", " | ").alias("line"))
    heads = lines.groupBy("table_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "line"))), lambda x: x["line"]).alias("lines"))
    said = [F.concat(F.lit(f"{k}: "), F.coalesce(F.col(c), F.lit(""))) for k, c in (("Document", "document_title"), ("Section", "section"), ("Table", "label"))]
    raw = F.array_join(F.concat(F.array(*said, F.lit("Headers:")), F.coalesce("lines", F.array().cast("array<string>"))), "\n")
    return tables.join(heads, "table_id", "left").select("table_id", F.lit("table_parent").alias("subtype"), raw.alias("raw_content"), F.sha2(raw, 256).alias("content_hash"))


def term_overlap(query: Column, text: Column) -> Column:
    return F.size(F.array_intersect(T.table_terms(query), T.table_terms(text)))


#: Chunks of a parent that meet a hit as one row.
SIBLINGS = 64
PART = ("chunk_id", "raw_content", "content_hash")
NO_SIBLINGS = "array<struct<less:int,away:int,at:int,own:struct<chunk_id:string,raw_content:string,content_hash:string>>>"


def _nearest(siblings: Column, hit_id: Column, at: Column, asked: Column, most: int) -> Column:
    """The best of an array of siblings (chunk_index, own, terms) for a hit: those with most words of its query, then the nearer ones."""
    overlap = lambda x: F.size(F.array_intersect(asked, x["terms"]))
    ranked = F.transform(F.filter(siblings, lambda x: x["own"]["chunk_id"] != hit_id), lambda x: F.struct((-overlap(x)).alias("less"), F.abs(x["chunk_index"] - at).alias("away"), x["chunk_index"].alias("at"), x["own"].alias("own")))
    return F.slice(F.array_sort(F.filter(ranked, lambda x: x["less"] < 0)), 1, most)


def _over_blocks(base: DataFrame, blocks: DataFrame, most: int) -> DataFrame:
    """Hits (parent_id, qid, hit_id, own, parent, chunk_index, asked) with the best of all blocks of their parent's siblings."""
    best = _nearest(F.col("siblings"), F.col("hit_id"), F.col("chunk_index"), F.col("asked"), most)
    met = base.join(blocks, "parent_id", "left").select("parent_id", "qid", "hit_id", "own", "parent", F.coalesce(best, F.array().cast(NO_SIBLINGS)).alias("best"))
    near = F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, most)
    return met.groupBy("parent_id", "qid", "hit_id").agg(F.first("own").alias("own"), F.first("parent").alias("parent"), near.alias("near"))


def _said_once(found: DataFrame) -> DataFrame:
    """(qid, hit_id, content, chunk_ids) of hits with own, parent and near."""
    parts = found.select("qid", "hit_id", F.array_compact(F.concat(F.array("parent", "own"), F.transform("near", lambda x: x["own"]))).alias("xs"))
    for key in ("chunk_id", "content_hash"):
        parts = parts.withColumn("xs", F.filter("xs", _first_of(key)))
    return parts.select("qid", "hit_id", F.array_join(F.transform("xs", lambda x: x["raw_content"]), "\n\n").alias("content"), F.transform("xs", lambda x: x["chunk_id"]).alias("chunk_ids"))


def expand_context(hits: DataFrame, chunks: DataFrame, max_adjacent_rows: int = 2) -> DataFrame:
    """Parent, hit and at most two related rows of each row or group hit: (qid, hit_id, content, chunk_ids).

    hits: (qid, hit_id, query). chunks: (chunk_id, chunk_index, parent_chunk_id, subtype,
    raw_content, retrieval_content, content_hash, headers). Related rows have words of the query;
    more of them, then nearer ones, come first. Repeated chunks and repeated contents appear once.
    Other hits give their own text.
    """
    # terms are taken once from each text; siblings meet a hit in blocks, of which each leaves its best
    most = min(max_adjacent_rows, 2)
    own = chunks.select("chunk_id", F.struct(*PART).alias("own"), "chunk_index", "subtype", "parent_chunk_id")
    asked = hits.select("qid", "hit_id", T.table_terms(F.col("query")).alias("asked"))
    rows = F.col("subtype").isin("table_row", "table_group")
    base = asked.join(own.withColumnRenamed("chunk_id", "hit_id"), "hit_id").withColumn("parent_id", F.when(rows, F.col("parent_chunk_id"))).drop("parent_chunk_id", "subtype")
    terms = T.table_terms(F.concat_ws(" ", "headers", "retrieval_content")).alias("terms")
    held = chunks.filter(rows & F.col("parent_chunk_id").isNotNull()).select(F.col("parent_chunk_id").alias("parent_id"), "chunk_index", F.struct(*PART).alias("own"), terms)
    block = F.floor(F.col("chunk_index") / SIBLINGS)
    blocks = held.repartition("parent_id").groupBy("parent_id", block.alias("block")).agg(F.collect_list(F.struct("chunk_index", "own", "terms")).alias("siblings"))
    family = chunks.select(F.col("chunk_id").alias("parent_id"), F.struct(*PART).alias("parent"))
    return _said_once(_over_blocks(base.join(family, "parent_id", "left"), blocks, most))


@F.arrow_udf(ArrayType(StringType()))
def _folded(texts: pa.Array) -> pa.Array:
    return pa.array([[(s or "").casefold() for s in x] for x in texts.to_pylist()], pa.list_(pa.string()))


def row_contexts(rows: DataFrame, parents: DataFrame, max_adjacent_rows: int = 2) -> DataFrame:
    """What ``expand_context`` gives where each row of each table is a hit: (hit_id, content, chunk_ids).

    rows: (parent_id, chunk_id, chunk_index, raw_content, said, query), said being the text with headers and indexes
    running from 0. parents: (parent_id, last, chunk_id, raw_content), last being a table's largest index.
    A table's block of rows is one row, stored with its parent's text: rows that are dealt by parent_id are
    grouped where they are, and nothing is dealt again but the blocks of tables that have several.
    """
    shared.bounded_batches(rows.sparkSession)
    most = min(max_adjacent_rows, 2)
    held = rows.groupBy("parent_id", F.floor(F.col("chunk_index") / SIBLINGS).alias("block")).agg(F.collect_list(F.struct("chunk_index", "chunk_id", "raw_content", "said", "query")).alias("held"))
    family = parents.select("parent_id", (F.col("last") >= SIBLINGS).alias("several"), F.struct("chunk_id", "raw_content", F.md5("raw_content").alias("content_hash")).alias("parent"))
    blocks = shared.stored(held.join(family, "parent_id", "left"), "blocks", "zstd")
    # Python sees a block's texts at once; before the blocks are made it would part the rows from how they are dealt
    folded = blocks.withColumn("texts", _folded(F.col("held.said"))).withColumn("queries", _folded(F.col("held.query")))
    distinct = lambda x: F.array_distinct(F.regexp_extract_all(x, F.lit(T.TABLE_TERM), F.lit(0)))
    own = lambda x: F.struct(x["chunk_id"].alias("chunk_id"), x["raw_content"].alias("raw_content"), F.md5(x["raw_content"]).alias("content_hash"))
    siblings = F.transform("held", lambda x, k: F.struct(x["chunk_index"].alias("chunk_index"), own(x).alias("own"), distinct(F.get("texts", k)).alias("terms"), distinct(F.get("queries", k)).alias("asked")))
    blocks = folded.select("parent_id", "parent", F.coalesce("several", F.lit(True)).alias("several"), siblings.alias("siblings"))
    hit = lambda x: F.struct(x["own"]["chunk_id"].alias("hit_id"), x["own"].alias("own"), _nearest(F.col("siblings"), x["own"]["chunk_id"], x["chunk_index"], x["asked"], most).alias("near"))
    one = blocks.filter("not several").select(F.lit(0).alias("qid"), "parent", F.inline(F.transform("siblings", hit)))
    more = blocks.filter("several")
    base = more.select("parent_id", "parent", F.explode("siblings").alias("x")).select("parent_id", F.lit(0).alias("qid"), F.col("x.own.chunk_id").alias("hit_id"), "x.own", "parent", "x.chunk_index", "x.asked")
    found = _over_blocks(base, more.select("parent_id", "siblings"), most).select("qid", "parent", "hit_id", "own", "near")
    return _said_once(one.unionByName(found)).drop("qid")


def _first_of(key: str):
    return lambda x, k: ~F.exists(F.slice("xs", F.lit(1), k), lambda y: y[key].eqNullSafe(x[key]))
