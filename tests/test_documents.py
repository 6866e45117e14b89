"""Loading, chunking, tables, layout, validation, lifecycle and streaming."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from siftspark import sql_functions
from siftspark.config import ChunkConfig
from siftspark.functions import tables as tab
from siftspark.operators import chunking, indexing, lifecycle, retrieval, validation
from siftspark.sources import artifacts, layout, loaders, pdf
from siftspark.streaming import ingest

DATA = "/root/testdata/sf0.001"

MARKDOWN = """# Title

Intro *text* with ![alt](x.png).

## Part

| a | b |
| --- | --- |
| 1 | 2 |

```python
code()
```
"""


def test_markdown(spark):
    blocks = list(loaders.markdown_blocks(MARKDOWN))
    assert [(b["type"], b["content"]) for b in blocks] == [("markdown", "Title"), ("markdown", "Intro text with alt."), ("markdown", "Part"), ("table", "a\nb\n1\n2"), ("code", "code()")]
    assert [b["line_start"] for b in blocks] == [1, 3, 5, 7, 12] and blocks[4]["language"] == "python"
    df = loaders.load_markdown(spark.createDataFrame([(1, MARKDOWN), (2, ""), (3, None)], "doc_id long, text string"))
    assert df.count() == 5 and df.first().title == "Title"
    paths = {r.content: r.section_path for r in chunking.heading_paths(df).collect()}
    assert paths["code()"] == ["Title", "Part"] and paths["Intro text with alt."] == ["Title"]
    assert chunking.text_runs(chunking.heading_paths(df)).count() == 3
    assert chunking.chunk_paragraphs(df, ChunkConfig(small_document_chars=5)).count() == 5


def test_docx():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, s="": f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    body = p("T", "Title") + p("H", "Heading2") + p("x") + f"<w:tbl><w:tr>{cell('Metric')}{cell('Value')}</w:tr><w:tr>{cell('Accuracy')}{cell('0.95')}</w:tr></w:tbl>"
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    got = loaders.docx_blocks(raw.getvalue())
    assert [b.get("heading_level") for b in got] == [1, 2, None, None]
    assert got[3]["content"] == "| Metric | Value |\n| --- | --- |\n| Accuracy | 0.95 |"
    assert [(b["type"], b["line_start"], b["line_end"]) for b in got] == [("markdown", 1, 1), ("markdown", 3, 3), ("text", 5, 5), ("table", 7, 9)]
    whole = raw.getvalue()
    bad = io.BytesIO()
    with zipfile.ZipFile(bad, "w") as z:
        z.writestr("word/document.xml", "<w:document>")
    assert all(loaders.docx_blocks(x) == [{"type": "error", "content": "DOCX_UNREADABLE"}] for x in (None, b"", b"PK\x03\x04", whole[:-30], whole[:200], bad.getvalue()))


def test_table_functions(spark):
    sql_functions.register(spark)
    docs = spark.createDataFrame([(1, "One. Two.\r\nThree" + "x" * 40), (2, None), (3, "")], "id long, text string")
    ask = lambda what: [tuple(r) for r in spark.sql(f"select d.id, f.* from {{docs}} d, lateral {what} f", docs=docs).collect()]
    assert [(r[0], r[3]) for r in ask("sift_chunks(text, 20, 10)")] == [(1, "One. Two."), (1, "Threexxxxxxxxxxxxxxx"), (1, "x" * 20), (1, "x" * 5)]
    assert [r[1:3] for r in ask("sift_sentences(text, 10)")][:3] == [(0, "One."), (1, "Two."), (2, "Threexxxxx")]
    assert ask("sift_markdown('# A\n\nb')")[:2] == [(1, 0, "markdown", "A", 1, 1, 1), (1, 1, "markdown", "b", 3, 3, None)]
    assert spark.sql("select type, content from sift_docx(X'00')").first() == ("error", "DOCX_UNREADABLE")
    for wrong in ("sift_chunks(text, 0)", "sift_chunks(id)", "sift_sentences(text, 5, 6)", "sift_chunks(text, id)"):
        with pytest.raises(Exception, match="limit|first argument"):
            ask(wrong)


def test_version_map(spark):
    rows = spark.createDataFrame([(k, f"d{k % 5}", f"v{k % 5}") for k in range(20)], "index_id long, document_id string, version_id string")
    made, versions = indexing.manifest(rows, "s", 4), indexing.version_map(rows)
    ids = rows.select(F.col("index_id").alias("id"))
    assert made["versions"] == 5 and made == indexing.manifest(rows.repartition(7), "s", 4)
    assert indexing.manifest_problems(made, rows, ids, versions.repartition(3)).count() == 0
    assert [r.code for r in indexing.manifest_problems(made, rows, ids, versions.filter("version_id <> 'v1'")).collect()] == ["VERSIONS_MISMATCH"]


def test_pdf(spark):
    raw = pdf.made([["Hello (world) \\ é", "second line"], ["page two"]])
    assert [(b["content"], b["page"], b["line_start"]) for b in loaders.pdf_blocks(raw)] == [("Hello (world) \\ é\nsecond line", 1, 1), ("page two", 2, 4)]
    codes = {loaders.pdf_blocks(x)[0]["content"] for x in (b"%PDF-1.4 x", b"no", pdf.made([["a"]]).replace(b"trailer <<", b"trailer << /Encrypt 9 0 R"))}
    assert codes == {"PDF_UNSUPPORTED"} and loaders.pdf_blocks(pdf.made([[]] * 5))[0]["content"] == "OCR_REQUIRED"
    unicode_map = b"1 beginbfchar <0001> <4E2D> endbfchar 1 beginbfrange <0002> <0003> <0061> endbfrange"
    body = b"BT /F 10 Tf 1 0 0 1 30 700 Tm <000100020003> Tj 0 -12 Td [(\\101) -300 <42>] TJ ET".replace(b"(\\101) -300 <42>", b"<0002> -300 <0003>")
    objects = [b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[3 0 R]/MediaBox[0 0 600 800]>>", b"<</Type/Page/Contents[4 0 R]/Resources<</Font<</F 5 0 R>>>>>>", b"<<>>stream\n" + body + b"\nendstream", b"<</Subtype/Type0/ToUnicode 6 0 R>>", b"<<>>stream\n" + unicode_map + b"\nendstream"]
    file = b"%PDF-1.7\n" + b"".join(b"%d 0 obj %s endobj\n" % (k, x) for k, x in enumerate(objects, 1))
    assert pdf.blocks(file) == [[(30.0, 100.0, "中ab\nab")]]
    assert list(pdf.values(b"(a\\101\\n(b)) /N#20x [1 2.5 3 0 R] <</K <6A>>>")) == [b"aA\n(b)", "/N x", [1, 2.5, pdf.Ref(3)], {"/K": b"j"}]
    df = loaders.loader_for("A.PDF")(spark.createDataFrame([(1, bytearray(raw)), (2, None)], "doc_id long, content binary"))
    assert sorted((r.doc_id, r.type) for r in df.collect()) == [(1, "text"), (1, "text"), (2, "error")]


def test_uploads(spark, tmp_path):
    (tmp_path / "a.md").write_text("# x")
    (tmp_path / "b.pdf").write_bytes(b"no pdf")
    (tmp_path / "c.exe").write_bytes(b"MZ")
    got = {r.extension: r.problem for r in loaders.read_files(spark, str(tmp_path)).collect()}
    assert got == {".md": None, ".pdf": "BAD_MAGIC", ".exe": "UNSUPPORTED_MEDIA_TYPE"}
    with pytest.raises(ValueError):
        loaders.loader_for("x.exe")
    ok = spark.createDataFrame([("/r/a",), ("/r/../b",), ("/s/a",)], "p string").select(loaders.is_inside("/r", F.col("p")).alias("x"))
    assert [r.x for r in ok.collect()] == [True, False, False]


def test_chunks(spark):
    cfg = ChunkConfig()
    assert chunking.chunk([{"type": "text", "content": "x" * 2048}], cfg)[0]["raw_content"] == "x" * 2048
    two = "a" * 399 + ". " + "b" * 399 + "."
    assert [len(t) for t, _ in chunking.merge_sentences(two, cfg)] == [801]
    many = chunking.chunk([{"type": "text", "content": "x" * 2049}], cfg)
    assert [len(c["raw_content"]) for c in many] == [800, 800, 449] and many[0]["hard_split"]
    table = "h1 | h2\n--- | ---\n" + "\n".join("v" * 300 for _ in range(8))
    assert all(t.startswith("h1 | h2\n--- | ---\n") and f for t, f in chunking.table_parts(table, cfg))
    df = chunking.chunk_texts(spark.read.parquet(f"{DATA}/documents.parquet")).cache()
    assert chunking.chunk_problems(df).count() == 0 and df.agg(F.max("character_count")).first()[0] <= 2048
    again = chunking.chunk_texts(spark.read.parquet(f"{DATA}/documents.parquet").repartition(7))
    assert df.exceptAll(again).count() == 0
    small = chunking.small_documents(spark.read.parquet(f"{DATA}/documents.parquet"))
    one = df.groupBy("doc_id").agg(F.count("*").alias("n"), F.first("content_hash").alias("h")).filter("n = 1")
    assert small.join(one, "doc_id").filter("h <> content_hash").count() == 0


CELL = "table_id string, cell_id string, row int, col int, row_span int, col_span int, text string, is_header boolean, is_column_header boolean, is_row_header boolean"
SHAPE = "document_id string, table_id string, row_count int, column_count int, header_rows array<int>, document_title string, section string, label string, markdown string"


def cells(spark):
    return spark.createDataFrame([("t", "a", 0, 0, 1, 2, "H", True, True, False), ("t", "b", 1, 0, 1, 1, "1", False, False, False), ("t", "c", 1, 1, 1, 1, "2|3", False, False, False)], CELL)


def shapes(spark, md=""):
    return spark.createDataFrame([("d", "t", 2, 2, [0], "Doc", "S", "L", md)], SHAPE)


def test_tables(spark):
    want = "| H | H |\n| --- | --- |\n| 1 | 2\\|3 |"
    assert tab.markdown(cells(spark), shapes(spark)).first().markdown == want
    assert {r.col: r.path for r in tab.header_paths(cells(spark), shapes(spark)).collect()} == {0: ["H"], 1: ["H"]}
    row = tab.row_chunks(cells(spark), shapes(spark)).filter("subtype = 'table_row'").first()
    assert row.raw_content == "| Row | H |\n| --- | --- |\n| 1 | 2|3 |" and row.cell_ids == ["b", "c"]
    assert row.retrieval_content == "Document: Doc\nSection: S\nTable: L\nRow: 1\nH: 2|3"
    assert tab.parent_chunks(cells(spark), shapes(spark)).first().raw_content == "Document: Doc\nSection: S\nTable: L\nHeaders:\nH | H"
    assert validation.tables(cells(spark), shapes(spark, want)).count() == 0
    assert [r.code for r in validation.tables(cells(spark), shapes(spark, "x")).collect()] == ["TABLE_MARKDOWN_MISMATCH"]
    over = cells(spark).unionByName(spark.createDataFrame([("t", "e", 1, 1, 1, 5, "x", False, False, False)], CELL))
    assert {r.code for r in validation.tables(over, shapes(spark, want)).collect()} >= {"TABLE_OVERLAP", "TABLE_CELL_OUT_OF_BOUNDS"}
    assert layout.orphan_cells(cells(spark)).first().asDict() == {"table_id": "t", "orphans": 2, "total": 2}
    prints = tab.grid(cells(spark), shapes(spark)).groupBy("table_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "c", "text"))), lambda x: x["text"]).alias("flat"))
    assert len(prints.select(tab.fingerprint(F.lit(None).cast("string"), F.array(F.lit(0)), F.lit(2), F.lit(2), "flat")).first()[0]) == 64


def test_table_context(spark):
    chunks = spark.createDataFrame([("p", 0, None, "table_parent", "P", "", "hp", ""), ("r1", 1, "p", "table_row", "R1", "alpha", "h1", ""), ("r2", 2, "p", "table_row", "R2", "alpha beta", "h2", ""), ("r3", 3, "p", "table_row", "R3", "gamma", "h3", "")], "chunk_id string, chunk_index int, parent_chunk_id string, subtype string, raw_content string, retrieval_content string, content_hash string, headers string")
    got = tab.expand_context(spark.createDataFrame([(0, "r1", "alpha beta"), (1, "p", "x")], "qid int, hit_id string, query string"), chunks)
    assert {r.qid: r.content for r in got.collect()} == {0: "P\n\nR1\n\nR2", 1: "P"}


def test_layout(spark):
    pages = spark.createDataFrame([("d", k, 600.0, 800.0) for k in (1, 2)], "document_id string, page int, width double, height double")
    rows = [("d", p, 0, 50.0, 20.0, 300.0, 40.0, "Journal X") for p in (1, 2)] + [("d", 1, 1, 50.0, 100.0, 550.0, 160.0, "Heading\nbody one\nbody two")]
    blocks = spark.createDataFrame(rows, "document_id string, page int, block int, x0 double, y0 double, x1 double, y1 double, text string")
    line = [("d", 1, 1, 0, 50.0, 100.0, 200.0, 118.0, 16.0, "Heading"), ("d", 1, 1, 1, 50.0, 125.0, 540.0, 136.0, 10.0, "body one"), ("d", 1, 1, 2, 50.0, 138.0, 540.0, 149.0, 10.0, "body two")]
    lines = spark.createDataFrame(line, "document_id string, page int, block int, line int, x0 double, y0 double, x1 double, y1 double, size double, text string")
    got = layout.elements(pages, blocks, lines).orderBy("reading_order").collect()
    assert [(r.kind, r.text, r.section_path) for r in got] == [("header", "Journal X", []), ("heading", "Heading", ["Heading"]), ("paragraph", "body one\nbody two", ["Heading"]), ("header", "Journal X", ["Heading"])] or [r.kind for r in got] == ["header", "heading", "paragraph", "header"]
    assert layout.page_columns(blocks, pages).filter("columns <> 1").count() == 0
    assert layout.ocr_required(pages, blocks.filter("false"), blocks.filter("false").select("document_id", "page")).count() == 1
    raw = [["a\nb", "1\n2", "x"], ["9", " .46", ""], ["p\nq", "", "1"], ["p\nq", "1\r\n2\x0b3", "z"], [None, "٣", ".5\n"]]
    table = spark.createDataFrame([(raw, [[[float(k)]] for k in range(5)])], "rows array<array<string>>, boxes array<array<array<double>>>")
    done = table.select(layout.repaired(F.col("rows"), F.col("boxes")).alias("x")).first().x
    assert done.rows == [["a", "1", "x"], ["b", "2", ""], ["", "9.46", ""], ["p", "", "1"], ["p", "1", "z"], ["", "", "٣.5"]] and done.expanded
    assert done.boxes == [[[0.0]], [[0.0]], [[1.0]], [[2.0]], [[3.0]], [[4.0]]]
    assert [(c["row"], c["col"], c["text"]) for c in layout.table_cells("<table><tr><th rowspan=2>A</th><td>b</td></tr><tr><td>c</td></tr></table>")] == [(0, 0, "A"), (0, 1, "b"), (1, 1, "c")]
    sizes = spark.createDataFrame([([10.0, 10.0, 12.0, 16.0],), ([9.0],), ([],)], "s array<double>").select(layout.first_quartile(F.col("s")).alias("q"))
    assert [r.q for r in sizes.collect()] == [10.0, 9.0, 10.0]


def test_validation(spark):
    pages = spark.createDataFrame([("d", 1, 100.0, 100.0), ("d", 3, 100.0, 100.0)], "document_id string, page int, width double, height double")
    prov = "array<struct<page:int,x0:double,y0:double,x1:double,y1:double>>"
    rows = [("d", "a", 0, "x", "x", "b", [(1, 0.0, 0.0, 200.0, 5.0)]), ("d", "b", 2, "y\x00", "y", "a", [(9, 0.0, 0.0, 1.0, 1.0)]), ("d", "c", 3, "z", "z", "q", [])]
    el = spark.createDataFrame(rows, f"document_id string, element_id string, reading_order int, text string, normalized_text string, parent_id string, provenance {prov}")
    got = {(r.ref, r.code) for r in validation.all_problems(pages, el).collect()}
    assert got == {("3", "PAGE_SEQUENCE"), ("b", "READING_ORDER"), ("c", "READING_ORDER"), ("b", "ELEMENT_REF_MISSING"), ("c", "PROVENANCE_MISSING"), ("a", "BBOX_OUT_OF_BOUNDS"), ("a", "PARENT_CYCLE"), ("b", "PARENT_CYCLE"), ("c", "PARENT_MISSING"), ("b", "TEXT_NUL")}
    good = {"parser_id": "p", "parser_version": "1", "signature": indexing.parser_signature("p", "1")}
    assert validation.manifest_problems(good) == [] and validation.manifest_problems(good | {"signature": "x"}) == ["SIGNATURE_MISMATCH"]


def test_lifecycle(spark):
    docs = spark.createDataFrame([(k, "READY", k, "v") for k in range(30)], "document_id long, status string, created_at long, active_version_id string")
    first = [r.document_id for r in lifecycle.listed_documents(docs, 20).collect()]
    assert first == list(range(29, 8, -1))
    after = {"created_at": 10, "document_id": 10}
    assert [r.document_id for r in lifecycle.listed_documents(docs, 20, after=after).collect()] == list(range(9, -1, -1))
    jobs = spark.createDataFrame([(1, 1, "running", 1, 1), (2, 2, "failed", 2, 1)], "job_id long, document_id long, status string, attempt int, created_at long")
    asked = spark.createDataFrame([(1, "delete"), (2, "retry"), (3, "retry")], "document_id long, kind string")
    got = {r.document_id: (r.refused, r.attempt) for r in lifecycle.accepted_requests(asked, jobs).collect()}
    assert got == {1: ("DOCUMENT_BUSY", None), 2: (None, 3), 3: ("NOT_FAILED", None)}
    assert {r.job_id: r.status for r in lifecycle.reconciled_jobs(jobs).collect()} == {1: "failed", 2: "failed"}
    assert lifecycle.job_problems(spark.createDataFrame([(1, 101, 1, 1, 2)], "job_id long, progress int, attempt int, started_at int, finished_at int")).first().code == "PROGRESS_RANGE"
    assert retrieval.scope_problem("all", ["x"], None) and not retrieval.scope_problem("collection", None, "c")
    key = spark.createDataFrame([("ffffffff-ffff-ffff-0000-000000000000",)], "u string").select(lifecycle.lock_key(F.col("u")).alias("k")).first().k
    assert int(key) == 2**63 - 1


def test_artifacts(spark, tmp_path):
    root = f"file://{tmp_path}/art"
    store = artifacts.Artifacts(spark, root)
    parsed = spark.createDataFrame([("d", "t")], "document_id string, title string")
    store.stage(parsed, "v1")
    path = store.activate("v1")
    assert artifacts.read_documents(spark, path, "document_id string, title string").first().title == "t"
    assert store.quarantine_orphans({"v2"}) == ["v1"]
    el = spark.createDataFrame([("d", 1, "paragraph", "b", []), ("d", 0, "heading", "A", ["A"])], "document_id string, reading_order int, kind string, text string, section_path array<string>")
    assert artifacts.document_markdown(el, True).first().markdown == "## A\n\nb"


def test_snapshot(spark, tmp_path):
    root = f"file://{tmp_path}/ix"
    docs = spark.createDataFrame([(1, "a b"), (2, "b c")], "id long, text string")
    indexing.build_sparse(docs).write(f"{root}/_building/s1")
    indexing.activate(spark, root, "s1")
    assert indexing.active_snapshot(spark, root) == "s1"
    assert indexing.SparseIndex.read(spark, f"{root}/versions/s1").terms.count() == 3


def test_streaming(spark, tmp_path):
    src, root = str(tmp_path / "in"), str(tmp_path / "out")
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(20)
    docs.filter("doc_id % 2 = 0").coalesce(1).write.parquet(src)
    ingest.start(ingest.document_stream(spark, src), root).awaitTermination()
    docs.filter("doc_id % 2 = 1").coalesce(1).write.mode("append").parquet(src)
    ingest.start(ingest.document_stream(spark, src), root).awaitTermination()
    chunks = chunking.chunk_texts(docs)
    want = indexing.build_sparse(chunks.withColumnsRenamed({"chunk_id": "id"}).select("id", F.col("retrieval_content").alias("text")))
    index = ingest.read_index(spark, root)
    corpus = want.corpus.first()
    assert index.statistics() == (corpus.n_docs, round(corpus.avgdl * corpus.n_docs))
    assert ingest.read_chunks(spark, root).join(index.documents(), F.col("index_id") == F.col("id")).count() == corpus.n_docs
    held = index.blocks().groupBy("term").agg(F.sum("n").alias("df"))
    assert held.exceptAll(want.terms.select("term", "df")).count() == 0


def test_a_micro_batch_that_fails_or_comes_again(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/out"
    docs = spark.createDataFrame([(1, "one two"), (2, "two three")], "doc_id long, text string")
    ingest.write_batch(docs, 0, root)

    def fails(self, made, parts):
        self._write_blocks(made.filter("term is not null").drop("ids"), parts["blocks"])
        raise OSError("blocks are there, shards are not")

    with monkeypatch.context() as m:
        m.setattr(ingest.Index, "_write", fails)
        with pytest.raises(OSError):
            ingest.write_batch(docs, 1, root)
    assert ingest.read_index(spark, root).statistics()[0] == ingest.read_chunks(spark, root).count() == 2
    ingest.write_batch(docs, 1, root)
    ingest.write_batch(docs, 0, root)
    rows = ingest.read_chunks(spark, root).collect()
    assert ingest.read_index(spark, root).statistics()[0] == len(rows) == len({r.index_id for r in rows}) == 4


def test_job_stream(spark, tmp_path):
    from datetime import datetime, timedelta

    path, day = str(tmp_path / "events"), lambda n: datetime(2024, 1, 1) + timedelta(days=n)
    schema = "job_id string, event_id long, ts timestamp, stage string, progress int"
    # j's later event comes first, s is silent for long and comes back, k stays silent
    files = [[("j", 3, day(1), "chunking", 10), ("k", 2, day(0), "queued", 5), ("s", 1, day(0), "parsing", 120)], [("j", 1, day(0), "parsing", 20), ("j", 9, day(8), "ready", 0)], [("j", 10, day(9), "done", 7)], [("s", 8, day(8), "ready", 50)]]
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = []
    put = lambda batch, _: got.extend(batch.collect())
    ingest.job_progress(stream, "2 days").writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    last = {}
    for r in sorted(got, key=lambda r: r.version):
        last[r.job_id] = (r.progress, r.stage, r.events)
    assert last == {"j": (20, "done", 4), "k": (5, "failed", 1), "s": (100, "ready", 2)}
    assert ("s", "failed") in {(r.job_id, r.stage) for r in got}


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
