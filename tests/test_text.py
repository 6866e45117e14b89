"""Text functions on literals and against plain Python."""

import re
import unicodedata

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftspark.functions import sentences
from siftspark.functions import text as T
from siftspark.streaming import answers


def run(spark, expr, *texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    return [r.x for r in df.select("k", expr(F.col("text")).alias("x")).orderBy("k").collect()]


def test_tokens(spark):
    assert run(spark, T.tokens, "Deep-Learning BGE-M3 9.46 été 中文", "info nce", "e e g x", "", "clip a") == [["deep-learning", "bge-m3", "9", "46", "t", "中", "文"], ["infonce"], ["eeg", "x"], [], ["clip", "a"]]


NORMAL = {
    "archi-\ntecture": "architecture",
    "13.61-\n13.09": "13.61-13.09",
    "ﬁle": "file",
    "a—b  c\r\nd": "a-b c d",
    "\x00x\xady": "xy",
    "ｆｕｌｌ ², ½": "full 2, 1⁄2",
    " \t ": "",
    "x　y": "x y",
    "Größe-\nund": "Größeund",
    "a-\n1": "a- 1",
}


def test_for_retrieval(spark):
    assert dict(zip(NORMAL, run(spark, T.for_retrieval, *NORMAL), strict=True)) == NORMAL


def test_for_retrieval_on_documents(spark):
    """Normal texts have no line ends, no double spaces and nothing around them, and stay as they are."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", T.for_retrieval(F.col("text")).alias("x"))
    again = rows.select("text", "x", T.for_retrieval(F.col("x")).alias("y")).collect()
    assert all(r.y == r.x == r.x.strip() and not re.search(r"\s\s|[\n\t\xad]", r.x) and unicodedata.is_normalized("NFKC", r.x) for r in again)
    letters = lambda s: [c for c in s if c.isalnum()]
    assert all(letters(unicodedata.normalize("NFKC", r.text)) == letters(r.x) for r in again)


def test_sentences(spark):
    assert run(spark, T.sentences, "Value 13.61 ok. Next!", "一。二！", "a\n\nb", "") == [["Value 13.61 ok.", "Next!"], ["一。", "二！"], ["a", "b"], []]
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", T.sentences(F.col("text")).alias("x")).collect()
    assert all(r.x == [s for s, _ in sentences.split(r.text, 10**9)] for r in rows)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab.,; \n1！", max_size=120), st.integers(5, 40))
def test_sentences_have_a_limit(text, most):
    parts = sentences.split(text, most)
    assert all(0 < len(s) <= most for s, _ in parts)
    kept = lambda s: re.sub(r"[\s;,]", "", s)
    assert kept("".join(s for s, _ in parts)) == kept(text)


def test_pieces_of_long_sentences():
    """At semicolons, else commas, else spaces, joined as far as they fit; slices where nothing parts them."""
    assert sentences.pieces("one; two, three; four", 14) == [("one;two, three", False), ("four", False)]
    assert sentences.pieces("one, two, three", 8) == [("one,two", False), ("three", False)]
    assert sentences.pieces("aa bb cc", 5) == [("aa bb", False), ("cc", False)]
    assert sentences.pieces("abcdefgh ij", 3) == [("abc", True), ("def", True), ("gh", True), ("ij", False)]
    assert sentences.pieces("fits", 4) == [("fits", False)]


def test_digits_of_other_scripts(spark):
    assert run(spark, T.sentences, "a ٣.٤ b.") == [[s for s, _ in sentences.split("a ٣.٤ b.")]] == [["a ٣.٤ b."]]


def test_citations(spark):
    allowed = F.array(F.lit(1).cast("bigint"))
    got = run(spark, lambda c: T.final_answer(c, allowed), "x [1] y [7]", "  insufficient evidence in the provided sources. More [1]")
    assert (got[0].answer, got[0].citations, got[0].invalid) == ("x [1] y ", [1], [7])
    assert (got[1].answer, got[1].citations) == (T.REFUSAL, [])


def test_small_functions(spark):
    assert run(spark, T.formula_aliases, "μ and ε") == [["epsilon", "mu"]]
    assert run(spark, lambda c: T.hard_cut(c, 3), "abcdefg", "") == [["abc", "def", "g"], []]
    assert run(spark, lambda c: T.sentence_boundary(c, 10), "Ab. cd ef gh", "no end here") == [3, 10]
    assert run(spark, T.json_payload, '```json\n{"a": 1}\n```', "no json") == ['{"a": 1}', None]
    assert run(spark, lambda c: T.hinted_query(c, F.array(F.lit("B"), F.lit(" a "), F.lit("b"))), "A") == ["A B"]
    assert run(spark, T.file_name, "a b/c?.md") == ["a_b_c_.md"]
    assert run(spark, T.quote_hash, "x") == run(spark, lambda c: F.sha2(F.lit("x"), 256), "x")
    with pytest.raises(ValueError):
        T.quote_hash(F.lit("x"), "v9")


@pytest.mark.parametrize(("parts", "want"), [
    ((" insuff", "icient evidence in the", " provided sources. More"), ["", "", T.REFUSAL]),
    (("Insu", "lation is", " good"), ["", "Insulation is", " good"]),
    (("Insufficient", ""), ["", "Insufficient"]),
    (("", "  "), ["", "  "]),
    ((T.REFUSAL.upper(), " but", " no"), [T.REFUSAL, "", ""]),
])
def test_refusal_gate(parts, want):
    """What each part adds, by the operator's rule alone: state and keys are stand-ins."""

    class Value:
        held = None
        exists = lambda self: self.held is not None
        get = lambda self: self.held

        def update(self, x):
            self.held = x

    class Early(dict):
        containsKey = lambda self, k: k in self
        getValue = lambda self, k: self[k]
        updateValue = dict.__setitem__
        removeKey = dict.__delitem__

    for order in ([0, 1, 2], [2, 1, 0], [1, 2, 0]):
        gate = answers.Gate()
        gate.at, gate.early, out = Value(), Early(), {}
        for k in [k for k in order if k < len(parts)]:
            rows = pd.DataFrame({"seq": [k], "part": [parts[k]], "last": [k == len(parts) - 1]})
            for got in gate.handleInputRows(("a",), iter([rows, rows]), None):
                out |= dict(zip(got["seq"], got["shown"], strict=True))
        assert [out[k] for k in range(len(parts))] == want and not gate.early
