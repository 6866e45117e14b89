"""Text functions: Column in, Column out. Only Unicode normalisation and case folding leave the JVM."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Tokens, terms and phrases that results depend on.
TOKEN = r"[a-z0-9]+(?:[-/][a-z0-9]+)*"
CJK = "\\x{4e00}-\\x{9fff}\\x{3400}-\\x{4dbf}"
DOMAIN_TERMS = ("bge-m3", "ddpm", "ddim", "fid", "r-precision", "infonce", "clip", "eeg")
DASHES = "−‐‑‒–—―"
LETTERS = "A-Za-z\\x{00c0}-\\x{024f}\\x{0370}-\\x{03ff}"
GREEK = (("ε", "epsilon"), ("θ", "theta"), ("Σ", "sigma"), ("μ", "mu"))
CLOSERS = "）)」』\"'】　 "
REFUSAL = "Insufficient evidence in the provided sources."
REJECTIONS = ("insufficient evidence", "not enough evidence", "证据不足", "无法从")
CITATION = r"(?U)\[(\d+)\]"
EVIDENCE_TOKEN = r"(?U)[^\W_]+(?:[.-][^\W_]+)*|[%±≤≥=+×÷∥εθΣμ]+"
TABLE_TERM = r"(?U)[\w.+-]+"
BARS, TIGHT, HYPHEN = "[|`]+", r"(?U)\s*([,.;:()\[\]])\s*", r"(?U)(?<=\w)\s*-\s*(?=\w)"
OLD_DASHES, OLD_OTHERS = "[-‐‑‒–—−]+", r"(?U)[^\w%.]+"

_MARK = "\u0001"


def line_feeds(x: Column) -> Column:
    """CR LF and CR as LF, without NUL; null is empty."""
    return F.translate(F.regexp_replace(F.coalesce(x, F.lit("")), "\r\n?", "\n"), "\x00", "")


@F.pandas_udf(StringType())
def nfkc(x: pd.Series) -> pd.Series:
    return x.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


@F.pandas_udf(StringType())
def casefold(x: pd.Series) -> pd.Series:
    return x.map(lambda s: None if s is None else s.casefold())


def for_retrieval(x: Column) -> Column:
    """The text that is indexed: compatibility forms, joined line-end hyphens, one kind of dash and of space."""
    t = nfkc(line_feeds(x))
    t = F.translate(t, "­", "")
    t = F.regexp_replace(t, f"(?<=[{LETTERS}])-\n(?=[{LETTERS}])", "")
    t = F.regexp_replace(t, r"(?U)(?<=\d)-\n(?=\d)", "-")
    t = F.translate(t, DASHES, "-" * len(DASHES))
    return trim_space(F.regexp_replace(t, r"(?U)\s+", " "))


def trim_space(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def replacement_count(x: Column) -> Column:
    """Characters that stand for undecodable ones."""
    return F.length(x) - F.length(F.translate(x, "�", ""))


def broken_unicode_count(x: Column) -> Column:
    return F.length(x) - F.length(F.translate(x, "�￾￿", ""))


def formula_aliases(x: Column) -> Column:
    """Sorted spoken names of the Greek letters in a text."""
    names = F.array(*[F.when(F.contains(x, F.lit(symbol)), F.lit(name)) for symbol, name in GREEK])
    return F.array_sort(F.filter(names, lambda n: n.isNotNull()))


def tokens(x: Column) -> Column:
    """Lower-case words with inner hyphens and slashes, each CJK character alone, domain terms merged."""
    found = F.regexp_extract_all(F.lower(x), F.lit(f"{TOKEN}|[{CJK}]"), F.lit(0))
    return bound(found, lambda t: merge_terms(t))


def bound(value: Column, f) -> Column:
    """f of a value that is computed once: a lambda variable stands for it."""
    return F.get(F.transform(F.array(value), f), 0)


def _splits(term: str) -> list[str]:
    """The ways in which two or three tokens make a term, the tokens joined by spaces."""
    n = len(term)
    ways = [(i,) for i in range(1, n)] + [(i, j) for i in range(1, n) for j in range(i + 1, n)]
    cut = [[term[a:b] for a, b in zip((0, *w), (*w, n), strict=True)] for w in ways]
    return [" ".join(parts) for parts in cut if all(re.fullmatch(TOKEN, p) for p in parts)]


def merge_terms(found: Column, terms: tuple[str, ...] = DOMAIN_TERMS) -> Column:
    """Greedy from the left: three tokens, then two, whose concatenation is a term become one.

    The scan is a fold of (tokens so far, tokens to skip). It runs only for texts in which some
    neighbours make a term, which one pattern over the joined tokens tells, and that only where
    a term's letters stand one after the other at all.
    """
    letters = F.array_join(found, "")
    close = reduce(Column.__or__, [F.contains(letters, F.lit(t)) for t in terms])
    some = close & F.array_join(found, " ").rlike("(?:^| )(?:" + "|".join(re.escape(s) for t in terms for s in _splits(t)) + ")(?: |$)")
    n = F.size(found)
    at = lambda i: F.coalesce(F.get(found, i), F.lit(""))
    two = lambda i: F.concat(at(i), at(i + 1))
    three = lambda i: F.concat(two(i), at(i + 2))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("skip"))

    def step(s: Column, i: Column) -> Column:
        put = lambda word, skip: F.struct(F.concat(s["out"], F.array(word)).alias("out"), F.lit(skip).alias("skip"))
        skipping = F.struct(s["out"].alias("out"), (s["skip"] - 1).alias("skip"))
        three_fit, two_fit = (i + 2 < n) & three(i).isin(*terms), (i + 1 < n) & two(i).isin(*terms)
        return F.when(s["skip"] > 0, skipping).when(three_fit, put(three(i), 2)).when(two_fit, put(two(i), 1)).otherwise(put(at(i), 0))

    return F.when(some, F.aggregate(F.sequence(F.lit(0), n - 1), start, step, lambda s: s["out"])).otherwise(found)


def sentences(x: Column) -> Column:
    """Sentences with their end marks, trimmed, empty ones dropped; new lines end sentences too."""
    end = f"(?U)((?:(?<!\\d)\\.|\\.(?!\\d)|[!?。！？])[{CLOSERS}]*)"
    marked = F.regexp_replace(F.coalesce(x, F.lit("")), end, f"$1{_MARK}")
    return F.filter(F.transform(F.split(marked, f"[{_MARK}\n]"), trim_space), lambda s: s != "")


def hard_cut(x: Column, size: int) -> Column:
    """Slices of a fixed width."""
    return F.when(F.length(x) > 0, F.transform(F.sequence(F.lit(0), F.length(x) - 1, F.lit(size)), lambda i: F.substring(x, i + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def sentence_boundary(x: Column, most: int) -> Column:
    """Where to cut a text of at most ``most`` characters: after the last end mark, the first character not counting."""
    head = F.regexp_extract(F.substring(x, 1, most), "(?s)^.+[.!?。！？]", 0)
    return F.coalesce(F.nullif(F.length(head), F.lit(0)), F.lit(most))


def for_evidence(x: Column) -> Column:
    return casefold(for_retrieval(x))


def for_alignment(x: Column) -> Column:
    """Evidence text without table bars and back quotes, tight around punctuation and hyphens."""
    t = F.regexp_replace(for_evidence(x), BARS, " ")
    t = F.regexp_replace(t, TIGHT, "$1")
    t = F.regexp_replace(t, HYPHEN, "-")
    return trim_space(F.regexp_replace(t, r"(?U)\s+", " "))


def evidence_tokens(x: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(for_evidence(x), F.lit(EVIDENCE_TOKEN), F.lit(0)))


def quote_hash(x: Column, version: str = "unicode-v2") -> Column:
    t = for_evidence(x)
    if version == "legacy-v1":
        t = F.regexp_replace(t, OLD_DASHES, "")
        t = trim_space(F.regexp_replace(F.regexp_replace(t, OLD_OTHERS, " "), r"(?U)\s+", " "))
    elif version != "unicode-v2":
        raise ValueError(f"unknown version {version}")
    return F.sha2(t, 256)


def table_terms(x: Column, fold: Callable[[Column], Column] = casefold) -> Column:
    """Distinct terms; folded they match in any case and spelling (ß as ss), by F.lower they stay words of their own."""
    return F.array_distinct(F.regexp_extract_all(fold(x), F.lit(TABLE_TERM), F.lit(0)))


def retrieval_content(title: Column, path: Column, raw: Column, most: int = 30_000) -> Column:
    """Title, section path and text on lines of their own; empty parts are left out."""
    return F.substring(F.concat_ws("\n", F.nullif(title, F.lit("")), F.nullif(F.array_join(path, " > "), F.lit("")), F.nullif(raw, F.lit(""))), 1, most)


def citation_numbers(x: Column) -> Column:
    """Sorted distinct numbers of the [n] marks."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(x, F.lit(CITATION), F.lit(1)), lambda n: n.cast("bigint"))))


def valid_citations(x: Column, allowed: Column) -> Column:
    return F.filter(citation_numbers(x), lambda n: F.array_contains(allowed, n))


def invalid_citations(x: Column, allowed: Column) -> Column:
    return F.filter(citation_numbers(x), lambda n: ~F.array_contains(allowed, n))


def without_marks(x: Column, numbers: Column) -> Column:
    return F.aggregate(numbers, x, lambda t, n: F.replace(t, F.concat(F.lit("["), n.cast("string"), F.lit("]")), F.lit("")))


def is_refusal(x: Column) -> Column:
    """The answer begins with the refusal sentence, in any case."""
    return F.startswith(F.lower(F.regexp_replace(x, r"(?U)^\s+", "")), F.lit(REFUSAL.lower()))


def final_answer(x: Column, allowed: Column) -> Column:
    """Struct of the visible answer, its valid citations and the invalid numbers."""
    bad = invalid_citations(x, allowed)
    clean = without_marks(x, bad)
    no = is_refusal(clean)
    return F.struct(F.when(no, F.lit(REFUSAL)).otherwise(clean).alias("answer"), F.when(no, F.array().cast("array<bigint>")).otherwise(valid_citations(x, allowed)).alias("citations"), bad.alias("invalid"))


def is_rejection(answer: Column, citations: Column) -> Column:
    text = F.lower(answer)
    said = F.contains(text, F.lit(REJECTIONS[0]))
    for phrase in REJECTIONS[1:]:
        said = said | F.contains(text, F.lit(phrase))
    return (F.size(citations) == 0) & said


def json_payload(x: Column) -> Column:
    """The JSON text inside a code fence, or the text itself; null if it isn't JSON."""
    inner = F.regexp_extract(x, r"(?s)^\s*```[A-Za-z]*\s*(.*?)\s*```\s*$", 1)
    body = F.when(inner != "", inner).otherwise(trim_space(x))
    return F.when(F.try_parse_json(body).isNotNull(), body)


def hinted_query(query: Column, hints: Column) -> Column:
    """Query and hints, trimmed, without case-insensitive repetitions, in order."""
    parts = F.filter(F.transform(F.concat(F.array(query), hints), trim_space), lambda s: s != "")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("seen"))
    put = lambda s, p: F.struct(F.concat(s["out"], F.array(p)).alias("out"), F.concat(s["seen"], F.array(F.lower(p))).alias("seen"))
    return F.array_join(F.aggregate(parts, start, lambda s, p: F.when(F.array_contains(s["seen"], F.lower(p)), s).otherwise(put(s, p)), lambda s: s["out"]), " ")


def needs_english(x: Column, strategy: str) -> Column:
    return F.lit(strategy == "english_for_cjk") & x.rlike(f"[{CJK}\\x{{f900}}-\\x{{faff}}]")


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def redacted_key(x: Column, shown: int = 4) -> Column:
    return F.when(F.length(x) > 2 * shown, F.concat(F.substring(x, 1, shown), F.lit("***"), F.right(x, F.lit(shown)))).otherwise(F.lit("***"))


def excerpt(text: Column, quote: Column, width: int = 700) -> Column:
    """A window of ``width`` characters around the first place of a quote, else the beginning."""
    at = F.instr(text, quote)
    start = F.greatest(F.lit(1), at - ((F.lit(width) - F.length(quote)) / 2).cast("int"))
    return F.substring(text, F.when(at > 0, start).otherwise(F.lit(1)), F.lit(width))


def file_name(x: Column) -> Column:
    """A display name of safe characters, 200 at most."""
    return F.substring(F.regexp_replace(x, "[^A-Za-z0-9._-]+", "_"), 1, 200)


def has_extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))
