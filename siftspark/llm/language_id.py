"""Language identification by Bayesian evidence fusion.

For every document log P(language | evidence) is the sum of
  - the text's log-likelihood under a byte-trigram model of each language, tempered, as
    neighbouring trigrams aren't independent;
  - log P(declared language | language) and log P(address language | language), from smoothed
    counts over the corpus, the address language being a path part or host ending that names one;
  - the log prior of the host, smoothed to its domain's, which is smoothed to the corpus's.
Counts are grouped aggregations over all documents of what the texts alone say. A uniform
model of trigrams stands for "no language" (``und``). A document is rejected if that is the
likeliest, if its text has no letters, or if the best language has less than LEAST posterior.

The text models are fitted on a bounded sample of documents with a declared language.

Defined results: null and empty texts, and texts without letters, are ``und`` and rejected;
null declarations, addresses and hosts are no evidence; each row gives one result row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftspark.llm import storage, textscan

#: Documents of each language that the text models are fitted on, and characters of all.
SAMPLE_DOCS, SAMPLE_CHARS = 800, 24 << 20
BUCKETS = 1 << 16
SMOOTHING = 0.05
#: The share of the uniform model in each language's: a key or a number in a text doesn't make it no language.
UNIFORM = 0.05
TEMPER = 0.3
LEAST = 0.5
#: Pseudo-counts of the upper level in a host's and a domain's prior, and in the tables of declarations.
HOST_WEIGHT, DOMAIN_WEIGHT, TABLE_WEIGHT = 20.0, 100.0, 2.0
UND_PRIOR = 1e-3

_CLASS = np.zeros(256, np.uint32)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = np.arange(1, 27)
_CLASS[128:] = np.arange(27, 155)


def _buckets(data: np.ndarray) -> np.ndarray:
    """The bucket of the trigram that starts at each byte but the last two; -1 where it has no letter first in it."""
    c = _CLASS[data]
    if len(c) < 3:
        return np.zeros(0, np.int64)
    key = (c[:-2] * np.uint32(155) + c[1:-1]) * np.uint32(155) + c[2:]
    out = ((key * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64)
    out[(c[1:-1] == 0)] = -1
    return out


@dataclass
class TextModel:
    languages: list[str]
    weights: np.ndarray  # (languages, buckets + 1), the last bucket weighs nothing
    und: float

    def likelihoods(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean log-likelihoods (documents, languages) per trigram, and the numbers of trigrams."""
        b = _buckets(data)
        b[b < 0] = BUCKETS
        # trigrams over two documents weigh nothing
        for o in offsets[1:-1]:
            b[max(0, o - 2) : o] = BUCKETS
        total = np.zeros(len(b) + 1)
        np.cumsum(b < BUCKETS, out=total[1:])
        at = np.minimum(offsets, len(b))
        counts = total[at[1:]] - total[at[:-1]]
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        for k, w in enumerate(self.weights):
            np.cumsum(w[b], out=total[1:])
            out[:, k] = (total[at[1:]] - total[at[:-1]]) / np.maximum(counts, 1)
        return out, counts


def fit(rows: list[tuple[str | None, str]]) -> TextModel:
    """Models of (text, language) rows."""
    languages = sorted({x for _, x in rows})
    counts = np.zeros((len(languages), BUCKETS))
    place = {x: k for k, x in enumerate(languages)}
    for text, x in rows:
        b = _buckets(np.frombuffer((text or "").encode(), np.uint8))
        counts[place[x]] += np.bincount(b[b >= 0], minlength=BUCKETS)
    p = (counts + SMOOTHING) / (counts.sum(1, keepdims=True) + SMOOTHING * BUCKETS)
    p = (1 - UNIFORM) * p + UNIFORM * 4 / BUCKETS
    weights = np.concatenate((np.log(p), np.zeros((len(languages), 1))), axis=1).astype(np.float32)
    return TextModel(languages, weights, -math.log(BUCKETS / 4))


def sample(documents: DataFrame, lang: Column, id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> list[tuple[str | None, str]]:
    """At most ``most`` documents of each declared language, those of the smallest id hashes; in all at most ``chars`` characters, the longest of each language left out whole, but never its shortest."""
    marked = documents.select(F.col(id_col).cast("long").alias("doc_id"), lang.alias("y")).filter("doc_id is not null and y is not null")
    counts = marked.groupBy("y").agg(F.count("*").alias("n")).orderBy("y").collect()  # tags of two or three letters
    if not counts:
        return []
    # languages of few documents are taken whole, at once
    chosen = marked.filter(F.col("y").isin([r.y for r in counts if r.n <= most]))
    for r in counts:
        if r.n > most:
            chosen = chosen.unionByName(marked.filter(F.col("y") == r.y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    found = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen.dropDuplicates(["doc_id"])), "doc_id")
    found = found.withColumn("place", F.row_number().over(Window.partitionBy("y").orderBy(F.length("text"), "doc_id", "text")))
    out, left = [], chars
    for r in found.orderBy("place", F.length("text"), "doc_id", "text").toLocalIterator():
        left -= len(r.text or "")
        if left < 0 and r.place > 1:
            break
        out.append((r.text, r.y))
    return out


def declared_language(column: Column) -> Column:
    """The primary part of a language tag, lower case; null if it is none."""
    tag = F.lower(F.regexp_extract(column.cast("string"), r"^\s*([A-Za-z]{2,3})(?:[-_].*)?\s*$", 1))
    return F.nullif(tag, F.lit(""))


def url_host(column: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(column.cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit(""))


def host_domain(host: Column) -> Column:
    """The last two labels of a host; of a plain source name, its letters."""
    return F.when(host.contains("."), F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)).otherwise(F.regexp_replace(host, r"\d+$", ""))


def address_language(url: Column, languages: list[str]) -> Column:
    """The language that the first path part names, else that the host's ending names."""
    path = F.lower(F.regexp_extract(url.cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([A-Za-z]{2})(?:[-_][A-Za-z]+)?(?:[/?#]|$)", 1))
    ending = F.regexp_extract(url_host(url), r"\.([a-z]{2})$", 1)
    return F.when(path.isin(languages), path).when(ending.isin(languages), ending)


def _scored(rows: DataFrame, model: TextModel) -> DataFrame:
    held = rows.sparkSession.sparkContext.broadcast(model)
    others = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for b in batches:
            textscan.forget()
            data, offsets = textscan.spans(b.column("text"))
            for i, j in textscan.slices(offsets, 1 << 18):
                part = b.slice(i, j - i)
                mean, count = own.likelihoods(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                used = TEMPER * count
                evidence = np.concatenate((mean * used[:, None], (own.und * used)[:, None]), axis=1)
                best = np.where(count > 0, mean.argmax(1), len(own.languages)) if own.languages else np.zeros(j - i, int)
                best = np.where(evidence[np.arange(j - i), best] >= evidence[:, -1], best, len(own.languages))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in others], pa.array(count.astype(np.int64)), textscan.list_column(evidence.ravel(), np.arange(j - i + 1) * evidence.shape[1], pa.float64()), pa.array(best, pa.int32())], names=[*others, "n_trigrams", "evidence", "text_best"])
            textscan.release()

    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes if c != "text")
    return rows.select(*others, "text").mapInArrow(run, f"{kinds}, n_trigrams long, evidence array<double>, text_best int")


def _table(scored: DataFrame, column: str, languages: list[str]) -> np.ndarray:
    """log P(what column says | language), (languages + und, languages + other), from counts over all rows. Bounded by the number of languages."""
    n = len(languages)
    said = F.when(F.col(column).isNull(), F.lit(-1))
    for k, x in enumerate(languages):
        said = said.when(F.col(column) == x, F.lit(k))
    counts = np.full((n + 1, n + 1), 0.0)
    for r in scored.groupBy("text_best", said.otherwise(F.lit(n)).alias("said")).agg(F.count("*").alias("n")).collect():
        if r.said >= 0:
            counts[r.text_best, r.said] += r.n
    total = counts.sum(0) + 1e-9
    smooth = counts + TABLE_WEIGHT * total / total.sum()
    return np.log(smooth / smooth.sum(1, keepdims=True))


def fused(rows: DataFrame, model: TextModel) -> DataFrame:
    """Rows (doc_id, text, declared, address, host) -> doc_id, lang, posterior, text_lang, n_trigrams, accepted."""
    languages, n = model.languages, len(model.languages)
    scored = storage.stored(_scored(rows.withColumn("domain", host_domain(F.col("host"))), model), "language")
    tables = {c: _table(scored, c, languages) for c in ("declared", "address")}
    hits = [F.sum((F.col("text_best") == k).cast("double")).alias(f"n{k}") for k in range(n)]
    everywhere = scored.agg(*hits).first() if n else ()
    total = sum(x or 0 for x in everywhere)
    prior = [((x or 0) + 1) / (total + n) for x in everywhere]
    mean = lambda row, up, weight: [(F.col(f"{row}.n{k}") + weight * up[k]) / (sum((F.col(f"{row}.n{j}") for j in range(n)), F.lit(0.0)) + weight) for k in range(n)]
    domains = scored.filter("domain is not null").groupBy("domain").agg(*hits).select("domain", F.struct(*[f"n{k}" for k in range(n)]).alias("d")) if n else None
    if n:
        domains = domains.select("domain", F.array(*mean("d", [F.lit(p) for p in prior], DOMAIN_WEIGHT)).alias("up"))
        hosts = scored.filter("host is not null").groupBy("host", "domain").agg(*hits).join(domains, "domain").withColumn("h", F.struct(*[f"n{k}" for k in range(n)]))
        hosts = storage.stored(hosts.select("host", F.array(*mean("h", [F.col("up")[k] for k in range(n)], HOST_WEIGHT)).alias("prior")), "hosts")
        scored = scored.join(hosts, "host", "left")
    else:
        scored = scored.withColumn("prior", F.lit(None).cast("array<double>"))
    base = F.array(*[F.lit(float(p)) for p in prior]) if n else F.array().cast("array<double>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {x: k for k, x in enumerate(languages)}
        names = np.array([*languages, "und"])
        for b in batches:
            e = np.array(b.column("evidence").flatten()).reshape(b.num_rows, n + 1).copy()
            for c, t in tables.items():
                said = [None if x is None else place.get(x, n) for x in b.column(c).to_pylist()]
                at = [k for k, x in enumerate(said) if x is not None]
                e[at] += t[:, [said[k] for k in at]].T
            p = np.array(b.column("prior").flatten()).reshape(b.num_rows, n)
            e[:, :n] += np.log(p * (1 - UND_PRIOR))
            e[:, n] += math.log(UND_PRIOR)
            best = e.argmax(1)
            post = np.exp(e - e.max(1, keepdims=True))
            post = post.max(1) / post.sum(1)
            count = b.column("n_trigrams").to_numpy()
            best = np.where(count > 0, best, n)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(names[best].tolist(), pa.string()), pa.array(np.where(count > 0, post, 1.0)), pa.array(names[b.column("text_best").to_numpy()].tolist(), pa.string()), b.column("n_trigrams"), pa.array((best < n) & (post >= LEAST))],
                names=["doc_id", "lang", "posterior", "text_lang", "n_trigrams", "accepted"],
            )

    ready = scored.select("doc_id", "declared", "address", "n_trigrams", "evidence", "text_best", F.coalesce("prior", base).alias("prior"))
    return ready.mapInArrow(run, "doc_id long, lang string, posterior double, text_lang string, n_trigrams long, accepted boolean")


def identified(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The languages of documents whose declared language and source are columns: the source stands for the host."""
    declared = declared_language(F.col(lang_col))
    model = fit(sample(documents, declared, id_col, text_col))
    source = F.col(source_col).cast("string")
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), declared.alias("declared"), address_language(source, model.languages).alias("address"), F.coalesce(url_host(source), source).alias("host"))
    return fused(rows, model)


def identified_pages(pages: DataFrame, documents: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The languages of web pages, one row per row: main text, the markup's declared language, the address and its host. Text models come from documents."""
    from siftspark.llm import html_extract

    model = fit(sample(documents, declared_language(F.col("lang"))))
    markup = F.regexp_extract(F.col(html_col).cast("string"), r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z_-]+)""", 1)
    texts = html_extract.extracted(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), declared_language(markup).alias("declared")), also=("declared",))
    rows = texts.select(F.col("page_id").alias("doc_id"), "text", "declared", address_language(F.col("url"), model.languages).alias("address"), url_host(F.col("url")).alias("host"))
    return fused(rows, model).withColumnRenamed("doc_id", "page_id")


def accepted(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The documents, all columns kept, without those that the identification rejects. Rows with the same id stay if one of them is accepted."""
    found = identified(documents, id_col, text_col, lang_col, source_col)
    gone = found.groupBy("doc_id").agg(F.max("accepted").alias("ok")).filter("not ok").select("doc_id")
    gone = storage.small(gone)
    return documents.join(gone, documents[f"`{id_col}`"].cast("long").eqNullSafe(gone["doc_id"]), "left_anti")
