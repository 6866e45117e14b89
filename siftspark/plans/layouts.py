"""Queries over page layout: lines of documents placed on pages, and tables as parsers export them.

Twelve lines stand on a page of 600 by 800 points, in two columns where the document's id is
even; each page has a header that repeats and a footer that doesn't.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftspark import shared
from siftspark.functions import text as T
from siftspark.plans.queries import lines, query, rounded, table
from siftspark.plans.structure import longs
from siftspark.sources import export_graph, layout

PLACED = """n as (select doc_id as d, x as t, row_number() over (partition by doc_id order by i) - 1 as o from (select doc_id, unnest(string_split(text, chr(10))) as x, unnest(range(len(string_split(text, chr(10))))) as i from documents) where x <> ''),
 b as (select d, o // 12 + 1 as page, o % 12 as block, case when d % 2 = 0 then 40.0 + (o % 2) * 280 else 40.0 end::double as x0, (90 + (o % 12) * 50)::double as y0, t, case when length(t) % 6 = 0 then 14.0 else 10 + (length(t) % 3) * 0.1 end::double as size from n),
 bl as (select d, page, block, x0, y0, x0 + case when d % 2 = 0 then 240 else 520 end as x1, y0 + 30 as y1, t, size from b),
 pg as (select d, unnest(range((count(*) + 11) // 12)) + 1 as page from b group by 1),
 hd as (select pg.d, page, 'Report ' || source as t from pg join documents on doc_id = pg.d),
 every as (select d, page, block, x0, y0, x1, y1, t, size from bl union all select d, page, 100, 40, 20, 200, 40, t, 9 from hd union all select d, page, 101, 40, 770, 200, 790, 'Page ' || page, 9 from pg)"""


def placed(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of one line each, with the size of their letters."""
    o = F.row_number().over(Window.partitionBy("document_id").orderBy("chunk_index")) - 1
    n = lines(spark, d).withColumn("o", o)
    two = F.col("document_id") % 2 == 0
    x0 = F.when(two, F.lit(40.0) + (F.col("o") % 2) * 280).otherwise(F.lit(40.0))
    y0 = (F.lit(90.0) + (F.col("o") % 12) * 50).cast("double")
    size = F.when(F.length("raw_content") % 6 == 0, F.lit(14.0)).otherwise(F.lit(10) + (F.length("raw_content") % 3) * F.lit(0.1))
    body = n.select("document_id", (F.floor(F.col("o") / 12) + 1).cast("int").alias("page"), (F.col("o") % 12).alias("block"), x0.alias("x0"), y0.alias("y0"), (x0 + F.when(two, 240).otherwise(520)).alias("x1"), (y0 + 30).alias("y1"), F.col("raw_content").alias("text"), size.alias("size"))
    source = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "source")
    p = sheets(spark, d)
    fixed = lambda block, y, text: p.join(source, "document_id").select("document_id", "page", F.lit(block).alias("block"), F.lit(40.0).alias("x0"), F.lit(y).alias("y0"), F.lit(200.0).alias("x1"), F.lit(y + 20).alias("y1"), text.alias("text"), F.lit(9.0).alias("size"))
    return body.unionByName(fixed(100, 20.0, F.concat(F.lit("Report "), "source"))).unionByName(fixed(101, 770.0, F.concat(F.lit("Page "), F.col("page").cast("string"))))


def sheets(spark: SparkSession, d: str) -> DataFrame:
    n = lines(spark, d).groupBy("document_id").agg(F.ceil(F.count("*") / 12).cast("int").alias("n"))
    return n.select("document_id", F.explode(F.sequence(F.lit(1), "n")).alias("page"), F.lit(600.0).alias("width"), F.lit(800.0).alias("height"))


@query(f"with {PLACED} select d as document_id, page, block, row_number() over (partition by d, page order by round_even(y0 / 12, 0), x0) - 1 as place from every")
def block_order(spark, d):
    return longs(layout.sorted_blocks(placed(spark, d)).select("document_id", "page", "block", "place"))


COLUMNS = "counted as (select d, page, count(*) as n, count(*) filter (where x0 < 298 and x1 > 302) as c, count(*) filter (where not (x0 < 298 and x1 > 302) and x1 <= 300) as l, count(*) filter (where not (x0 < 298 and x1 > 302) and x1 > 300) as r from {} group by 1, 2), cols as (select d, page, case when n >= 4 then c / n::double else 0 end as crossing, case when n >= 4 and c / n::double <= 0.15 and l >= 2 and r >= 2 then 2 else 1 end as columns from counted)"


@query(f"with {PLACED}, {COLUMNS.format('every')} select d as document_id, page, columns::bigint as columns, round(crossing, 6) as crossing from cols")
def page_columns(spark, d):
    return rounded(longs(layout.page_columns(placed(spark, d), sheets(spark, d))))


@query(f"with {PLACED}, {COLUMNS.format('every')} select e.d as document_id, page, block, case when columns = 2 and (x0 + x1) / 2 >= 300 then 1 else 0 end::bigint as place from every e join cols c using (d, page)")
def block_columns(spark, d):
    b, p = placed(spark, d), sheets(spark, d)
    both = b.join(layout.page_columns(b, p), ["document_id", "page"]).join(p, ["document_id", "page"])
    return longs(both.select("document_id", "page", "block", layout.column_of(F.col("x0"), F.col("x1"), F.col("width"), F.col("columns")).alias("place")))


BANDS = "many as (select d, count(*) as p from pg group by 1 having count(*) >= 2)"


@query(f"with {PLACED}, {BANDS} select hd.d as document_id, page, t as key, 'header' as kind from hd join many using (d)")
def repeated_bands(spark, d):
    """Headers that stand on every page; page numbers differ."""
    return longs(layout.repeated_bands(placed(spark, d), sheets(spark, d)))


@query(f"with {PLACED}, p as (select d, count(*) as p from pg group by 1) select d as document_id, case when p >= 2 then 0.5 else 0 end::double as share from p")
def band_shares(spark, d):
    p = sheets(spark, d)
    return rounded(layout.repeated_share(layout.repeated_bands(placed(spark, d), p), p))


BODY = "quart as (select d, list(size order by size) as s, count(*) as n from {} group by 1), body as (select d, case when n = 1 then s[1] else (s[at1] * (4 - rest) + s[at1 + 1] * rest) / 4 end as body from (select *, greatest(1, least((n + 1) // 4, n - 1)) as at1, (n + 1) - greatest(1, least((n + 1) // 4, n - 1)) * 4 as rest from quart))"


@query(f"with {PLACED}, {BODY.format('bl')} select d as document_id, round(body, 6) as body from body")
def body_sizes(spark, d):
    return rounded(layout.body_sizes(placed(spark, d).filter("block < 100")))


MATH = "[εθΣμπΠΦφ±≤≥≠∑∫∂∇−×÷≈√]"


def _kind(text: str, size: str, body: str) -> str:
    t = f"regexp_replace({text}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"
    symbols = f"len(regexp_extract_all({t}, '{MATH}'))"
    return f"case when length({t}) between 1 and 300 and ({symbols} >= 2 or (contains({t}, '=') and {symbols} >= 1)) then 'formula' when regexp_matches({t}, '^(?:[-*•]|[0-9]+[.)])\\s+') then 'list' when {size} >= {body} * 1.15 and length({t}) <= 200 then 'heading' when regexp_matches({t}, '^(?:Table|Figure|Fig\\.|表|图)') and length({t}) <= 300 then 'caption' else 'paragraph' end"


SAID = "case d % 7 when 1 then 'Σ = μ ' || left(t, 20) when 2 then '3. ' || t when 3 then 'Figure 2 ' || left(t, 50) else t end"


@query(f"with {PLACED}, {BODY.format('bl')} select d as document_id, page, block, {_kind(SAID, 'size', 'body')} as kind from bl join body using (d)")
def line_kinds(spark, d):
    """Formulas, list items, headings, captions and paragraphs, by a line's beginning and size."""
    b = placed(spark, d).filter("block < 100")
    key = F.col("document_id") % 7
    said = F.when(key == 1, F.concat(F.lit("Σ = μ "), F.left("text", F.lit(20)))).when(key == 2, F.concat(F.lit("3. "), "text")).when(key == 3, F.concat(F.lit("Figure 2 "), F.left("text", F.lit(50)))).otherwise(F.col("text"))
    both = b.join(layout.body_sizes(b), "document_id")
    return longs(both.select("document_id", "page", "block", layout.line_kind(said, F.col("size"), F.col("body")).alias("kind")))


def _paragraphs(lines_of: str, blocks_of: str) -> str:
    bullet, caption = "'^(?:[-*•]|[0-9]+[.)])\\s+'", "'^(?:Table|Figure|Fig\\.|表|图)'"
    return f"""{COLUMNS.format(blocks_of)}, {BODY.format(lines_of)},
 placed as (select l.*, body, case when columns = 2 and (x0 + x1) / 2 >= 300 then 1 else 0 end as col, median(greatest(y1 - y0, 1)) over (partition by l.d, l.page) * 1.8 as room from {lines_of} l join cols using (d, page) join body using (d)),
 lagged as (select *, lag(col) over w as col0, lag(y1) over w as y10, lag(size) over w as size0, lag(t) over w as t0, row_number() over w as k from placed window w as (partition by d, page order by col, round(y0, 1), round(x0, 1), block)),
 runs as (select *, sum(case when coalesce(col0 = col and y0 - y10 between -1 and room and abs(size - size0) <= greatest(size, size0) * 0.2 and not (size0 >= body * 1.15 and length(t0) <= 200) and not regexp_matches(trim(t0), {caption}) and not regexp_matches(ltrim(t), {bullet}), false) then 0 else 1 end) over (partition by d, page order by k rows between unbounded preceding and current row)::bigint as run from lagged),
 para as (select d, page, run, arg_min(t, k) as first, string_agg(t, chr(10) order by k) as t, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1, arg_min(size, k) as size, any_value(body) as body from runs group by 1, 2, 3),
 paras as (select d, page, run, t, {_kind("first", "size", "body")} as kind, x0, y0, x1, y1, size from para)"""


@query(f"with {PLACED}, {_paragraphs('bl', 'bl')} select d as document_id, page, run, kind, md5(t) as text_md5, round(y0, 6) as y0, round(y1, 6) as y1 from paras")
def merged_paragraphs(spark, d):
    """Lines that go on: same column, close, of like size."""
    b = placed(spark, d).filter("block < 100")
    found = layout.paragraphs(b.withColumn("line", F.lit(0)), sheets(spark, d), b)
    return rounded(longs(found.select("document_id", "page", "run", "kind", F.md5("text").alias("text_md5"), "y0", "y1")))


@query(
    f"""with {PLACED}, {BANDS}, inner_ as (select e.* from every e where not (block = 100 and d in (select d from many))), {_paragraphs("inner_", "every")},
 el as (select hd.d, page, 0 as part, 100 as n, 'header' as kind, t from hd join many using (d) union all select d, page, 1, run, kind, t from paras),
 ord as (select *, row_number() over (partition by d order by page, part, n) - 1 as reading_order from el), sec as (select *, last_value(case when kind = 'heading' then t end ignore nulls) over (partition by d order by reading_order rows between unbounded preceding and current row) as section from ord)
 select d as document_id, reading_order, page, kind, md5(t) as text_md5, coalesce(md5(section), '') as section_md5 from sec"""
)
def page_elements(spark, d):
    """Elements in reading order with their section: bands first on each page, then paragraphs."""
    # lines are stored once, with their keys
    b = shared.stored(placed(spark, d).withColumn("key", T.for_retrieval(F.col("text"))), "placed", "zstd")
    p = shared.stored(sheets(spark, d), "sheets", "zstd")
    found = layout.elements(p, b.drop("size"), b.drop("key").withColumn("line", F.lit(0)))
    section = F.when(F.size("section_path") > 0, F.md5(F.element_at("section_path", -1))).otherwise(F.lit(""))
    return longs(found.select("document_id", "reading_order", "page", "kind", F.md5("text").alias("text_md5"), section.alias("section_md5")))


@query(f"with {PLACED}, p as (select d, count(*) as p from pg group by 1) select doc_id as document_id, 'OCR_REQUIRED' as code from documents join p on p.d = doc_id where doc_id % 3 = 0")
def scanned_documents(spark, d):
    """Documents whose pages lost their text but for a few characters on none or one of six."""
    p = sheets(spark, d)
    b = placed(spark, d).filter("document_id % 3 <> 0")
    return layout.ocr_required(p, b, b.select("document_id", "page").filter("false"))


REPORT = "report as (select doc_id as d, doc_id % 5 as k from documents)"


def reports(spark: SparkSession, d: str) -> DataFrame:
    """Quality reports of documents: each of four kinds fails one limit."""
    key = F.col("doc_id") % 5
    return table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.when(key == 0, 1).otherwise(0).alias("malformed"), F.when(key == 1, 0.9).otherwise(0.98).alias("confidence"), F.when(key == 2, 1).otherwise(0).alias("replacements"), F.when(key == 3, 0.06).otherwise(0.05).alias("orphan_ratio"), F.array().cast("array<string>").alias("hard_failures"))


@query(f"with {REPORT} select d as document_id, case when k = 4 then 'fast' else 'layout' end as parser from report")
def parser_routes(spark, d):
    """The simple parser's result where its report allows, else the layout parser's."""
    one = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"))
    return layout.routed(one, one, reports(spark, d)).select("document_id", "parser")


@query("with l as (select doc_id as d, i as o, x as t, case length(x) % 8 when 0 then 'heading' when 1 then 'table' when 2 then 'footer' when 3 then 'code' else 'paragraph' end as kind from (select doc_id, unnest(string_split(text, chr(10))) as x, unnest(range(len(string_split(text, chr(10))))) as i from documents) where x <> '') select d as doc_id, o as pos, case when kind in ('table', 'code') then kind else 'text' end as type, row_number() over (partition by d order by o) as line_start, case when kind = 'heading' then 2 end::bigint as heading_level from l where kind <> 'footer'")
def bridged_paragraphs(spark, d):
    """Elements as loaded paragraphs; footers don't count."""
    n = F.length("raw_content") % 8
    kind = F.when(n == 0, F.lit("heading")).when(n == 1, F.lit("table")).when(n == 2, F.lit("footer")).when(n == 3, F.lit("code")).otherwise(F.lit("paragraph"))
    e = lines(spark, d).select("document_id", F.col("chunk_index").alias("reading_order"), kind.alias("kind"), F.col("raw_content").alias("text"), F.lit(1).alias("page"), F.array(F.lit("a"), F.lit("b")).alias("section_path"))
    return longs(layout.as_paragraphs(e).select("doc_id", "pos", "type", "line_start", "heading_level"))


# tables of parsers: the items of an order as rows of text


def item_rows(spark: SparkSession, d: str) -> DataFrame:
    """(table_id, rows, row_count, column_count): a row of names, then a row for each item."""
    cells = lambda r: F.array(F.concat(F.lit("n"), r["l_linenumber"].cast("string")), r["l_partkey"].cast("string"), r["l_quantity"].cast("long").cast("string"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))), cells)
    found = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("table_id")).agg(items.alias("items"))
    odd = F.when(F.col("table_id") % 3 == 0, F.array(F.array(F.lit("one")))).otherwise(F.array().cast("array<array<string>>"))
    rows = F.concat(F.array(F.array(F.lit("Line"), F.lit("Part"), F.lit("Quantity"))), F.col("items"), odd)
    return found.select("table_id", rows.alias("rows"), F.size(rows).alias("row_count"), F.lit(3).alias("column_count"))


ITEMS = "it as (select l_orderkey as k, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_quantity) as r, l_linenumber, l_partkey, l_quantity::bigint as q from lineitem)"


@query(f"with {ITEMS} select k as table_id, case when k % 3 = 0 then 'PDF_TABLE_INVALID: ragged' when k % 3 = 1 then 'PDF_TABLE_INVALID: unverified' end as problem, 1::bigint as heads from it group by 1")
def table_shapes(spark, d):
    """Ragged and unverified tables, and how many rows are headers."""
    t = item_rows(spark, d)
    return longs(t.select("table_id", layout.table_problem(F.col("rows"), F.col("row_count"), F.col("column_count"), F.col("table_id") % 3 == 2).alias("problem"), layout.header_row_count(F.col("rows")).alias("heads")))


@query(f"with {ITEMS}, c as (select k, r, unnest([0, 1, 2]) as c, unnest(['n' || l_linenumber, l_partkey::varchar, q::varchar]) as t from it where k % 3 <> 0 union all select distinct k, 0, unnest([0, 1, 2]), unnest(['Line', 'Part', 'Quantity']) from it where k % 3 <> 0) select k || '-' || r || '-' || c as cell_id, t as text, r = 0 as is_header from c")
def primitive_cells(spark, d):
    return layout.primitive_cells(item_rows(spark, d)).select("cell_id", "text", "is_header")


@query(f"with {ITEMS} select k as table_id, count(*) filter (where r % 2 = 0) * 2 as orphans, count(*) * 2 as total from it where k % 3 <> 0 group by 1")
def orphan_cells(spark, d):
    """Numbers in rows whose label is taken away."""
    cells = layout.primitive_cells(item_rows(spark, d))
    bare = F.when((F.col("col") == 0) & (F.col("row") > 0) & (F.col("row") % 2 == 0), F.lit("")).otherwise(F.col("text"))
    return longs(layout.orphan_cells(cells.withColumn("text", bare)))


@query(f"with {ITEMS}, w as (select k, r, ['n' || l_linenumber, case when k % 2 = 0 then '' else l_partkey::varchar end, case when k % 2 = 0 then l_partkey || '.' || q else q::varchar end] as cells from it) select k as table_id, count(*) > 1 as expanded, md5(string_agg(array_to_string(cells, ','), ';' order by r)) as rows_md5 from w group by 1")
def repaired_tables(spark, d):
    """Rows written into one are taken apart; a number whose fraction went to the next cell is put together."""
    rows = item_rows(spark, d).select("table_id", F.filter("rows", lambda r, i: (i > 0) & (F.size(r) == 3)).alias("rows"))
    even = F.col("table_id") % 2 == 0
    third = lambda r: F.when(even, F.concat(F.lit("."), r[2])).otherwise(r[2])
    column = lambda f: F.array_join(F.transform("rows", f), "\n")
    one = F.array(F.array(column(lambda r: r[0]), column(lambda r: r[1]), column(third)))
    made = rows.select("table_id", layout.repaired(one).alias("x"))
    return made.select("table_id", "x.expanded", F.md5(F.array_join(F.transform("x.rows", lambda r: F.array_join(r, ",")), ";")).alias("rows_md5"))


# exports of other parsers


@query("select event_id, round(greatest(0.0, least(value, 50.0)), 6) as x0, round(case when event_id % 2 = 0 then 100 - 40 else 30 end::double, 6) as y0, round(greatest(0.0, least(value + 10, 50.0)), 6) as x1, round(case when event_id % 2 = 0 then 100 - 30 else 40 end::double, 6) as y1, round(value * 50 / 1000, 6) as scaled from events")
def export_boxes(spark, d):
    """Boxes from the bottom or the top, inside their page; boxes in thousandths of a page."""
    v = F.col("value")
    box = layout.top_left_box(v, F.lit(30.0), v + 10, F.lit(40.0), F.lit(50.0), F.lit(100.0), F.col("event_id") % 2 == 0)
    scaled = layout.scaled_box(F.array(v, v, v, v), F.lit(50.0), F.lit(100.0))
    return rounded(table(spark, d, "events").select("event_id", box.alias("b"), F.get(scaled, 0).alias("scaled")).select("event_id", "b.*", "scaled"))


@query("select doc_id, case when doc_id % 5 = 0 then 'figure' else case doc_id % 7 when 0 then case when doc_id % 3 = 0 then 'header' else 'title' end when 1 then case when doc_id % 3 = 0 then 'header' else 'heading' end when 2 then case when doc_id % 3 = 0 then 'header' else 'heading' end when 3 then case when doc_id % 3 = 0 then 'header' else 'paragraph' end when 4 then 'footer' when 5 then case when doc_id % 3 = 0 then 'header' else 'list' end else case when doc_id % 3 = 0 then 'header' else 'paragraph' end end end as kind from documents")
def element_kinds(spark, d):
    """Labels of another parser's export; furniture and pictures have kinds of their own."""
    i = F.col("doc_id")
    labels = F.array(*[F.lit(x) for x in ("title", "section_header", "subtitle", "footnote", "page_footer", "list_item", "handwriting")])
    return table(spark, d, "documents").select("doc_id", layout.element_kind(F.get(labels, (i % 7).cast("int")), i % 3 == 0, i % 5 == 0).alias("kind"))


@query(f"with {ITEMS} select k as table_id, case when k % 2 = 0 then '0,1' else '0' end as header_rows from it group by 1")
def declared_headers(spark, d):
    """Leading rows whose filled cells are all column headers; where none are, the first."""
    cells = layout.primitive_cells(item_rows(spark, d).withColumn("rows", F.filter("rows", lambda r: F.size(r) == 3)))
    key = F.split("table_id", "-")[0].cast("long") % 2
    return layout.declared_header_rows(cells.withColumn("table_id", F.col("table_id").cast("string")).withColumn("is_column_header", (key == 0) & (F.col("row") < 2))).select(F.col("table_id").cast("long").alias("table_id"), F.array_join(F.transform("header_rows", lambda h: h.cast("string")), ",").alias("header_rows"))


@query(f"with {ITEMS} select k as table_id, count(*) as n, sum(r)::bigint as total from it group by 1")
def merged_copies(spark, d):
    """An export repeats each cell at the two places that it covers."""
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity"))
    one = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("table_id"), n.alias("start_row"), F.lit(0).alias("start_col"), F.lit(1).alias("row_span"), F.lit(2).alias("col_span"), F.lit("t").alias("text"), n.alias("row"))
    one = one.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("col"))
    return layout.without_merged_copies(one).filter("col = 0").groupBy("table_id").agg(F.count("*").alias("n"), F.sum("row").cast("long").alias("total"))


@query(f"with {ITEMS}, m as (select k, max(r) as m from it group by 1) select it.k as document_id, 'e' || r as ref, case when it.k % 2 = 0 then r - 1 else r - 1 end as reading_order, round(case when it.k % 3 = 0 then 0.96 else 1 end::double, 6) as confidence from it join m using (k)")
def export_orders(spark, d):
    """A graph of references: items under one another; documents of some ids have a dangling one and a cycle."""
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity"))
    it = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), n.alias("r"))
    ref = lambda x: F.concat(F.lit("e"), x.cast("string"))
    r = F.col("r")
    refs = it.select("document_id", F.when(r == 1, F.lit("#body")).otherwise(ref(r - 1)).alias("parent"), ref(r).alias("child"), F.lit(0).alias("place"))
    bad = it.filter((F.col("document_id") % 3 == 0) & (r == 1)).select("document_id", F.inline(F.array(F.struct(F.lit("e1").alias("parent"), F.lit("lost").alias("child"), F.lit(1).alias("place")), F.struct(F.lit("e1").alias("parent"), F.lit("e1").alias("child"), F.lit(2).alias("place")))))
    order, sure = export_graph.export_order(it.select("document_id", ref(r).alias("ref")), refs.unionByName(bad))
    return rounded(longs(order.join(sure, "document_id")))


@query("with recursive e as (select d, r, case when r = 1 then 0 when d = 0 then r - 1 else (r + 1) // 3 end as p from (select doc_id % 4 as d, row_number() over (partition by doc_id % 4 order by doc_id) as r from documents)), walk as (select d, r, [r] as path from e where p = 0 union all select e.d, e.r, list_append(w.path, e.r) from e join walk w on e.d = w.d and e.p = w.r) select d as document_id, 'e' || r as ref, row_number() over (partition by d order by path) - 1 as reading_order, case when d = 1 then 0.94 else 1.0 end::double as confidence from walk")
def deep_orders(spark, d):
    """Reference graphs over all documents: one chain as deep as they are many, and trees of three; a cycle over the whole depth and two dangling references in one."""
    n = F.row_number().over(Window.partitionBy(F.col("doc_id") % 4).orderBy("doc_id"))
    it = table(spark, d, "documents").select((F.col("doc_id") % 4).alias("document_id"), n.alias("r"))
    ref = lambda x: F.concat(F.lit("e"), x.cast("string"))
    r = F.col("r")
    parent = F.when(r == 1, F.lit("#body")).otherwise(ref(F.when(F.col("document_id") == 0, r - 1).otherwise(F.floor((r + 1) / 3))))
    refs = it.select("document_id", parent.alias("parent"), ref(r).alias("child"), r.alias("place"))
    last = it.filter("document_id = 1").groupBy("document_id").agg(F.max("r").alias("r"))
    bad = last.select("document_id", F.inline(F.array(F.struct(ref(r).alias("parent"), F.lit("e1").alias("child"), r.alias("place")), F.struct(ref(r).alias("parent"), F.lit("gone").alias("child"), r.alias("place")), F.struct(F.lit("#body").alias("parent"), F.lit("lost").alias("child"), r.alias("place")))))
    order, sure = export_graph.export_order(it.select("document_id", ref(r).alias("ref")), refs.unionByName(bad))
    return rounded(longs(order.join(sure, "document_id")))


@query(f"with {ITEMS}, t as (select k, r, r % 2 = 1 as own from it) select k as document_id, r as page, case when own then 'first' else 'other' end as parser, row_number() over (partition by k order by r) - 1 as reading_order from t")
def fallback_tables(spark, d):
    """The first parser found tables on odd pages; the other's fill the even ones."""
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity"))
    it = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), n.alias("page"), F.lit("table").alias("kind"), F.lit(1.0).alias("y0"), n.alias("reading_order"))
    out = layout.with_fallback_tables(it.filter("page % 2 = 1").withColumn("parser", F.lit("first")), it.withColumn("parser", F.lit("other")))
    return longs(out.select("document_id", "page", "parser", "reading_order"))


@query(f"with {ITEMS}, c as (select k, r, unnest([0, 2]) as c, unnest(['L ' || l_linenumber, l_partkey::varchar]) as t, unnest([2, 1]) as w from it union all select distinct k, 0, unnest([0, 1, 2]), unnest(['A', 'B', 'C']), 1 from it) select k as table_id, count(*) as n, md5(string_agg(r || ',' || c || ',' || w || ',' || t || ',' || (r = 0), ';' order by r, c)) as cells_md5 from c where k % 2 = 0 group by 1 union all select k, count(*), md5(string_agg(r || ',' || c || ',1,' || t || ',' || (r = 0), ';' order by r, c)) from (select k, r, unnest([0, 1]) as c, unnest(['L ' || l_linenumber, l_partkey::varchar]) as t from it union all select distinct k, 0, unnest([0, 1]), unnest(['A', 'B']) from it) where k % 2 = 1 group by 1")
def exported_tables(spark, d):
    """HTML tables with a cell over two columns, and pipe tables."""
    item = F.struct("l_linenumber", "l_partkey", "l_quantity")
    items = F.array_sort(F.collect_list(item))
    html = lambda r: F.concat(F.lit('<tr><td colspan="2">L  '), r["l_linenumber"].cast("string"), F.lit("</td><td>"), r["l_partkey"].cast("string"), F.lit("</td></tr>"))
    pipe = lambda r: F.concat(F.lit("\n| L "), r["l_linenumber"].cast("string"), F.lit(" | "), r["l_partkey"].cast("string"), F.lit(" |"))
    found = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("table_id")).agg(items.alias("items"))
    source = F.when(F.col("table_id") % 2 == 0, F.concat(F.lit("<table><tr><th>A</th><th>B</th><th>C</th></tr>"), F.array_join(F.transform("items", html), ""), F.lit("</table>"))).otherwise(F.concat(F.lit("| A | B |\n| --- | --- |"), F.array_join(F.transform("items", pipe), "")))
    cells = F.array_sort(F.transform(layout.parsed_cells(source), lambda c: F.struct(c["row"].alias("r"), c["col"].alias("c"), c["col_span"].alias("w"), c["text"].alias("t"), c["is_header"].alias("h"))))
    said = F.transform("cells", lambda c: F.concat_ws(",", c["r"].cast("string"), c["c"].cast("string"), c["w"].cast("string"), c["t"], c["h"].cast("string")))
    return found.select("table_id", cells.alias("cells")).select("table_id", F.size("cells").cast("long").alias("n"), F.md5(F.array_join(said, ";")).alias("cells_md5"))
