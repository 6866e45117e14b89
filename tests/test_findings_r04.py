"""What the fourth round's findings were about, each on a small case."""

import re

import __spark_entry__
from pyspark.sql import functions as F

from siftspark import shared
from siftspark.functions import tables as tab
from siftspark.operators import evidence, validation

SMALL = "/root/testdata/sf0.001"


def plans(monkeypatch, run):
    """The plans of what a query stores, as they stand before they run, by name, and its result."""
    found, real = {}, shared.stored

    def stored(df, name, *args):
        found[name] = df._jdf.queryExecution().executedPlan().toString()
        return real(df, name, *args)

    monkeypatch.setattr(shared, "stored", stored)
    return found, run()


def test_rows_of_a_table_are_not_dealt_again_for_their_contexts(spark, monkeypatch):
    """rows with their texts were stored and dealt by chunk, by parent and by table."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    found, out = plans(monkeypatch, lambda: __spark_entry__.queries()["table_contexts"](spark, SMALL))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found["blocks"].count("Exchange hashpartitioning") == found["blocks"].count("Exchange hashpartitioning(table_id")
    # what is dealt after that are blocks of tables that have several
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2


def test_contexts_of_a_table_of_many_blocks(spark):
    """rows of a table of one block, of three and of none of its own parent's."""
    rows = spark.range(2, 170).selectExpr("if(id < 150, 'a', 'b') as parent_id", "id").selectExpr("parent_id", "concat(parent_id, '/', id) as chunk_id", "int(if(parent_id = 'a', id, id - 148)) as chunk_index", "concat('raw ', id % 40) as raw_content", "concat('Straße ', id % 7, ' w', id % 11) as said", "concat('STRASSE ', id % 7, if(id % 3 = 0, ' none', ' w1')) as query")
    parents = spark.createDataFrame([("a", 149, "Pa", "parent a"), ("b", 21, "Pb", "parent b")], "parent_id string, last int, chunk_id string, raw_content string")
    got = {r.hit_id: (r.content, r.chunk_ids) for r in tab.row_contexts(rows, parents).collect()}
    every = rows.select("chunk_id", "chunk_index", F.concat(F.lit("P"), "parent_id").alias("parent_chunk_id"), F.lit("table_row").alias("subtype"), "raw_content", F.col("said").alias("retrieval_content"), F.md5("raw_content").alias("content_hash"), F.lit("").alias("headers"))
    above = parents.select("chunk_id", F.lit(0).alias("chunk_index"), F.lit(None).cast("string").alias("parent_chunk_id"), F.lit("table_parent").alias("subtype"), "raw_content", F.lit("").alias("retrieval_content"), F.md5("raw_content").alias("content_hash"), F.lit("").alias("headers"))
    want = {r.hit_id: (r.content, r.chunk_ids) for r in tab.expand_context(rows.select(F.lit(0).alias("qid"), F.col("chunk_id").alias("hit_id"), "query"), every.unionByName(above)).collect()}
    assert len(got) == 168 and got == want


def test_rows_of_a_grid_meet_by_the_table_alone(spark, monkeypatch):
    """rows of grids were dealt by table and row, once for the Markdown and once for its check; five checks each made the cells."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    found, out = plans(monkeypatch, lambda: __spark_entry__.queries()["table_problems"](spark, SMALL))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plan = out._jdf.queryExecution().executedPlan().toString()
    for text in (found["shapes"], plan):
        assert text.count("Exchange hashpartitioning") == len(re.findall(r"Exchange hashpartitioning\(table_id#\d+, \d+\)", text)) <= 4


def test_markdown_of_tables_with_gaps_and_shared_places(spark):
    """rows and columns without cells are blank, the first cell on a place owns it, cells outside the shape aren't shown."""
    rows = [("t", "h", 0, 0, 1, 2, "H", True, True, False), ("t", "a", 3, 1, 1, 1, "x", False, False, False), ("t", "b", 3, 1, 1, 1, "y", False, False, False), ("t", "o", 9, 0, 1, 1, "out", False, False, False), ("t", "n", -1, 0, 1, 1, "neg", False, False, False), ("t", "s", 2, 0, 2, 1, "tall", False, False, False)]
    cells = spark.createDataFrame(rows, "table_id string, cell_id string, row int, col int, row_span int, col_span int, text string, is_header boolean, is_column_header boolean, is_row_header boolean")
    tables = spark.createDataFrame([("d", "t", 4, 3, [0], "?"), ("d", "none", 1, 2, [0], "|  |  |\n| --- | --- |"), ("d", "no rows", 0, 2, [], "z")], "document_id string, table_id string, row_count int, column_count int, header_rows array<int>, markdown string")
    got = {r.table_id: r.markdown for r in tab.markdown(cells, tables).collect()}
    assert got == {"t": "| H | H |  |\n| --- | --- | --- |\n|  |  |  |\n| tall |  |  |\n|  | x |  |", "none": "|  |  |\n| --- | --- |"}
    found = sorted((r.ref, r.code) for r in validation.tables(cells, tables).collect())
    assert found == [("n", "TABLE_CELL_OUT_OF_BOUNDS"), ("o", "TABLE_CELL_OUT_OF_BOUNDS"), ("t", "TABLE_MARKDOWN_MISMATCH"), ("t", "TABLE_OVERLAP")]


def test_quotes_on_crowded_and_loose_pages(spark, monkeypatch):
    """words of all chunks were dealt out for every quote; now only those of documents with crowded pages, with the same result."""
    chunk = "document_key long, chunk_id string, chunk_index int, page_start int, page_end int, section_path array<string>, subtype string, indexed boolean, raw_content string, retrieval_content string"
    text = lambda d, i: f"alpha w{d}x{i} beta w{i % 7} gamma"
    page = lambda d, i: (None if d == 3 or i == 9 else i // 5 if d == 1 else 0)
    rows = [(d, f"{d}/{i}", i, page(d, i), page(d, i), [], "text", True, text(d, i), text(d, i)) for d in (1, 2, 3, 4) for i in range(90 if d != 4 else 8)]
    asked = [("one", 1, 1, "alpha w1x6 beta"), ("two", 1, 1, "gamma alpha w1x6 beta w6 gamma alpha"), ("loose", 1, 0, "w1x9 beta"), ("crowded", 2, 0, "alpha w2x40 beta"), ("over", 2, 0, "w2x40 beta w5 gamma alpha w2x41"), ("alike", 2, 0, "gamma w2x50 w1 beta"), ("bare", 3, 5, "w3x70 beta"), ("no page", 3, None, "w3x7 beta w0"), ("none", 4, 0, "zz yy xx")]
    a = spark.createDataFrame([(k, d, p, [], q, None) for k, d, p, q in asked], "anchor_id string, document_key long, page int, section_path array<string>, quote string, quote_hash string")
    c = spark.createDataFrame(rows, chunk)
    show = lambda: sorted((r.anchor_id, r.status, r.method, tuple(r.chunk_ids)) for r in evidence.resolve_evidence(a, c).collect())
    found, got = plans(monkeypatch, show)
    assert "candidates" in found and {k: (m, ids) for k, _, m, ids in got}["crowded"] == ("exact", ("2/40",))
    monkeypatch.setattr(evidence, "PAGE_CHUNKS", 1000)
    assert show() == got
    few = c.filter("document_key = 4")
    found, got = plans(monkeypatch, lambda: evidence.resolve_evidence(a, few).collect())
    assert "candidates" not in found and len(got) == 9


def test_lines_of_pages_are_stored_once(spark, monkeypatch):
    """lines were stored a second time with their keys, and dealt again for the body's size and for sections."""
    found, out = plans(monkeypatch, lambda: __spark_entry__.queries()["page_elements"](spark, SMALL))
    assert set(found) == {"placed", "sheets", "bands"}
    assert not re.search(r"Join \[document_id#\d+L?, reading_order#", out._jdf.queryExecution().executedPlan().toString())
