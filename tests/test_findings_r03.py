"""What the third round's findings were about, each on a small case."""

import hashlib
import re

import __spark_entry__
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from siftspark.config import ChunkConfig
from siftspark.functions import text as T
from siftspark.operators import chunking, evaluation, evidence, indexing, retrieval, segments
from siftspark.sources import loaders
from siftspark.streaming import answers, ingest

SMALL = "/root/testdata/sf0.001"
#: Shuffles of a query's plan.
LIMITS = {"table_row_chunks": 5, "table_markdown": 3, "table_parents": 4, "table_fingerprints": 3, "table_contexts": 4, "table_problems": 5}


def test_chunks_on_other_pages_are_left_before_their_texts_are_read(spark):
    anchors = spark.createDataFrame([("a", 1, 3), ("b", 1, 3), ("c", 2, None)], "anchor_id string, document_key long, page int")
    rows = [(1, "on", 3, 3), (1, "over", 2, 4), (1, "off", 4, 5), (1, "any", None, None), (1, "open", None, 3), (2, "none", 3, 3), (2, "any2", None, None), (3, "other", 3, 3)]
    chunks = spark.createDataFrame(rows, "document_key long, chunk_id string, page_start int, page_end int")
    assert sorted(r.chunk_id for r in evidence.on_asked_pages(anchors, chunks).collect()) == ["any", "any2", "on", "open", "over"]


def test_terms_in_lower_case_stay_words_of_their_own(spark):
    row = spark.createDataFrame([("Einß einss EINß",)], "t string").select(T.table_terms(F.col("t"), F.lower).alias("own"), T.table_terms(F.col("t")).alias("folded")).first()
    assert sorted(row.own) == ["einss", "einß"] and row.folded == ["einss"]


def test_an_anchor_agrees_in_any_case(spark):
    texts = spark.createDataFrame([(1, "ßen"), (2, "STRASSE"), (3, "the end"), (4, "ı")], "case_id int, text string")
    anchors = spark.createDataFrame([(1, "SS"), (2, "straße"), (3, "THE"), (3, "x"), (4, "I")], "case_id int, anchor string")
    assert sorted((r.case_id, r.found) for r in evaluation.anchor_check(texts, anchors).collect()) == [(1, 1), (2, 1), (3, 1), (4, 1)]


def test_all_windows_of_a_stream_are_given(spark):
    e = spark.read.parquet(f"{SMALL}/events.parquet")
    found = __spark_entry__.queries()["streamed_event_counts"](spark, SMALL)
    want = e.select(F.date_trunc("hour", "ts"), "event_type").distinct().count()
    assert found.agg(F.sum("n")).first()[0] == e.count() and found.count() == want


def exchanges(df):
    """Shuffles of the plan as it stands before it runs."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_cells_stay_with_their_table(spark):
    """Rows are dealt once; cells, header paths and shapes meet by the table's id alone (there were 20 shuffles of cells and rows and more)."""
    q = __spark_entry__.queries()
    for name, most in LIMITS.items():
        assert exchanges(q[name](spark, SMALL)) <= most, name


class Held:
    """A stand-in for a value that a stream keeps, and for what sets its timers."""

    def __init__(self):
        self.value, self.timers = None, set()

    def __getattr__(self, name):
        return {"exists": lambda: self.value is not None, "get": lambda: self.value, "registerTimer": self.timers.add, "deleteTimer": self.timers.remove, "getValueState": lambda *_: self}[name]

    def update(self, value):
        self.value = value


def test_a_call_takes_a_bucket_of_jobs():
    held, jobs = Held(), ingest.Jobs(10)
    jobs.init(held)
    call = lambda rows: next(jobs.handleInputRows((0,), iter([pd.DataFrame(rows, columns=["job_id", "event_id", "stage", "progress", "ts_ms"])]), None)).values.tolist()
    assert call([("a", 2, "x", 200, 100), ("b", 1, "y", -5, 103), ("a", 1, "z", 7, 99)]) == [["a", 100, "x", 2, 1], ["b", 0, "y", 1, 1]]
    assert held.timers == {110} and call([("a", 3, "w", 1, 120)]) == [["a", 100, "w", 3, 2]]
    at = lambda x: type("At", (), {"getExpiryTimeInMs": lambda _: x, "getCurrentWatermarkInMs": lambda _: x + 8})()
    held.timers.clear()
    # the timer was a's, which went on; b is stale by now
    assert next(jobs.handleExpiredTimer((0,), at(110), at(110))).values.tolist() == [["b", 0, "failed", 1, 2]] and held.timers == {130}
    assert call([("b", 9, "v", 3, 125)]) == [["b", 3, "v", 2, 3]] and held.timers == {130}


def test_a_call_takes_a_bucket_of_answers():
    held, gates = Held(), answers.Gates()
    gates.init(held)
    call = lambda rows: next(gates.handleInputRows((0,), iter([pd.DataFrame(rows, columns=["answer_id", "seq", "part", "last"])]), None)).values.tolist()
    assert call([("a", 1, "lation", True), ("b", 0, "So", False), ("c", 2, "!", True)]) == [["b", 0, "So", False]]
    assert call([("a", 0, "Insu", False), ("c", 1, "y", False)]) == [["a", 0, "", False], ["a", 1, "Insulation", True]]
    assert call([("c", 0, "wh", False), ("b", 0, "So", False), ("b", 1, " it is", True)]) == [["c", 0, "wh", False], ["c", 1, "y", False], ["c", 2, "!", True], ["b", 1, " it is", True]]


def test_many_documents_paragraphs_are_one_batch():
    block = {"type": "text", "content": "x" * 1000, "line_start": 1, "line_end": 1}
    (one,) = loaders._loaded((k, "t", [block, block]) for k in range(500))
    assert one.num_rows == 1000 and one.column("pos").to_pylist()[:3] == [0, 1, 0]
    many = [b.num_rows for b in loaders._loaded((k, "t", [block]) for k in range(10_000))]
    assert sum(many) == 10_000 and max(many) < 4000


def test_checks_of_documents_share_their_elements(spark):
    """Elements are made once, and no task holds the joins of all rounds (there were 393 shuffles)."""
    assert exchanges(__spark_entry__.queries()["document_problems"](spark, SMALL)) <= 5


def test_chunks_are_given_out_by_size():
    body = [{"type": "code", "content": "x" * 3000, "page": None, "line_start": 1, "line_end": 1, "heading_level": None, "heading": None}]
    rows = pa.RecordBatch.from_pylist([{"doc_id": k, "title": "t", "body": body} for k in range(2000)])
    found = [b.num_rows for b in chunking._run(iter([rows]), list, ChunkConfig())]
    assert sum(found) == 2000 and len(found) > 4 and max(found) < 400


def test_best_of_a_task_are_those_of_a_full_order():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 3, (5000, 4)).astype(float)  # many ties
    matrix, ids = rng.integers(0, 3, (7, 4)).astype(float), rng.permutation(5000)
    made = [pa.record_batch({"id": ids[a : a + 1700], "vector": pa.array(list(x[a : a + 1700]))}) for a in range(0, 5000, 1700)]
    for k in (1, 30, 6000):
        got = pa.Table.from_batches(retrieval._best(iter(made), np.arange(7) * 10, matrix, k)).to_pylist()
        scores = matrix @ x.T
        want = [(q * 10, int(ids[i])) for q in range(7) for i in np.lexsort((ids, -scores[q]))[:k]]
        assert [(r["qid"], r["id"]) for r in got] == want


def test_a_shard_ends_near_its_size_and_batches_are_bounded(spark):
    """1,024 documents were put in at a time, however long, and batches held 10,000."""
    docs = spark.range(40).select("id", F.array_repeat(F.concat(F.lit("w"), "id"), 20_000).alias("terms")).coalesce(1)
    found = segments.built(docs, "s", shard_tokens=100_000).filter("term is null").select("shard", "n").collect()
    assert sum(r.n for r in found) == 40 and max(r.n for r in found) <= 8
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20


def test_hashed_vectors_of_odd_texts(spark):
    texts = [None, "", "  ", " a  A\tb ", "ı ß\u0085x 漢"]
    found = indexing.hashed_vectors(spark.createDataFrame(list(enumerate(texts)), "id long, text string")).collect()
    for r in found:
        want = np.zeros(64)
        for w in re.split(r"[ \t\n\x0b\f\r]+", (texts[r.id] or "").lower()):
            if w:
                want[hashlib.md5(w.encode()).digest()[-1] % 64] += 1
        assert np.allclose(r.vector, want / (np.linalg.norm(want) or 1))


def test_placed_lines_are_made_once(spark):
    """Lines and pages were made anew from the documents wherever elements read them."""
    files = __spark_entry__.queries()["page_elements"](spark, SMALL).inputFiles()
    assert files and not any("documents.parquet" in f for f in files)


def test_band_posts_move_in_pieces_of_buckets(spark):
    """op2: a shuffled and sorted row was one post; now it holds a task's posts of a bucket, also where a bucket goes out in parts."""
    from siftspark.llm import line_dedup

    posts = spark.range(20_000, numPartitions=3).select(F.when(F.col("id") < 12_000, F.col("id") % 7).otherwise(F.col("id")).alias("key"), F.col("id").alias("line"))
    got = line_dedup._shared(posts)
    assert "hashpartitioning(key" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.line for r in got.collect()) == list(range(12_000))


def test_marks_and_capitals_share_the_ids_of_plain_words():
    """op4: a word with signs behind it or a capital of Latin-1 was learned anew, and a mark under a capital letter joined its small one."""
    import public_tokenizers
    from siftspark.llm import token_files

    store = token_files.WordStore(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["wort wort.*** WORT&&& \u00c4rger \u00e4rger## \u00c9T\u00c9", "H\u0331 x T\u0308", "A<|endoftext|>** don't'' \u00c0_ =\u0338", "\u00d7 a\u00d7 \u00df\u00de"]
    for text in texts:
        got = np.frombuffer(next(store.encode_column(pa.array([text]), 1)), store.kind).tolist()
        assert got == [*store.tok.encode(text, add_special_tokens=False).ids, 1], text
    assert "wort".encode() in store.new and not any(w.startswith(b"wort") and w != b"wort" for w in store.new)
