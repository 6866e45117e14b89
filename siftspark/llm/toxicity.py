"""Toxicity by compression distance under two zstandard dictionaries.

From a bounded sample of labelled documents two dictionaries are trained: one on windows of
ordinary documents, and one on the words of toxic documents that set them apart (dictionaries
of all their windows tell toxic documents far worse, see the README). A window of a document is
compressed with the ordinary dictionary, and with the toxic one before it. The bytes that the
toxic dictionary saves are the window's distance; a logistic model of the windows' distances,
fitted on folds that trained neither dictionary, gives the document's score, and its threshold
is 0.5.

Only the text is scored. Texts are lower-cased and cut into windows of about WINDOW bytes
between words; whole texts are scored, however long or short. Defined results: null and empty
texts get the score of a document without any distance; rows that repeat score alike; with no
toxic or no ordinary document in the sample, or where distances tell the kinds apart no better
than chance, every score is the share of toxic labels (0 without labels).
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled documents of each kind that the fit may use, and characters of all of them.
SAMPLE_DOCS, SAMPLE_CHARS = 3000, 24 << 20
WINDOW = 64
#: Compression levels: the one whose distances tell the kinds apart best on the folds is taken.
LEVELS = (12, 9)
ORDINARY_BYTES, TOXIC_BYTES = 32_768, 8192
#: Word parts of so many bytes that so much likelier occur in a toxic document, and in that share of them, set it apart.
GRAMS, LIKELIER, LEAST_SHARE = (6, 8, 10), 12.0, 0.015
#: Parts of the sample of which each is scored by dictionaries of the others, and the least area under the curve there.
FOLDS, LEAST_AUC = 4, 0.55
#: Stands before each window and at the end of each dictionary: a window then never goes out uncompressed, and short ones show savings too.
ANCHOR = bytes(range(1, 9)) * 4


def windows(raw: bytes, size: int = WINDOW) -> list[bytes]:
    """Cuts between words; a longer word is cut at size."""
    out, n, a = [], len(raw), 0
    while a < n:
        e = min(n, a + size)
        if e < n:
            k = raw.rfind(b" ", a + 1, e)
            e = k if k > a else e
        out.append(raw[a:e])
        a = e
    return out


def _prepared(text: str | None) -> bytes:
    return " ".join((text or "").lower().split()).encode()


def _grams(raw: bytes) -> set[bytes]:
    out = set()
    for w in raw.split():
        out.update(_parts(b" " + w))
    return out


def _parts(w: bytes) -> Iterator[bytes]:
    """Every part of the shortest length, and the word's beginnings of the longer ones."""
    if len(w) > 4:
        n = GRAMS[0]
        yield from (w[i : i + n] for i in range(max(1, len(w) - n + 1)))
        yield from (w[:n] for n in GRAMS[1:] if len(w) >= n)


def _distinctive(toxic: list[bytes], many: Counter, few: Counter, n_ordinary: int) -> list[bytes]:
    """The words of toxic documents that hold a part hardly found in ordinary ones, with repetitions, most frequent last.

    many, few: in how many toxic and ordinary documents each part stands.
    """
    least = max(3, LEAST_SHARE * len(toxic))
    own = {g for g, k in many.items() if k >= least and k / len(toxic) > LIKELIER * (few[g] + 0.5) / n_ordinary}
    words: Counter[bytes] = Counter()
    for raw in toxic:
        for w in raw.split():
            x = b" " + w.rstrip(b".,;:!?")
            if any(part in own for part in _parts(x)):
                words[x + b" "] += 1
    return [w for w, k in sorted(words.items(), key=lambda x: (x[1], x[0])) for _ in range(k)]


def _trained(samples: list[bytes], size: int, k: int) -> bytes:
    """A trained dictionary, or the end of the samples themselves where there are too few to train on."""
    if not samples:
        return b""
    samples = samples * max(1, min(200, 8000 // len(samples)))
    try:
        return zstandard.train_dictionary(size, samples, k=k, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


@dataclass
class Model:
    """Both dictionaries and the logistic weights: bias, then one per feature."""

    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]
    level: int = LEVELS[0]

    def __getstate__(self):
        return self.ordinary, self.toxic, self.weights, self.level

    def __setstate__(self, state):
        self.ordinary, self.toxic, self.weights, self.level = state

    def _pair(self) -> list[zstandard.ZstdCompressor]:
        if "_made" not in self.__dict__:
            self._made = [_compressor(self.ordinary, self.level), _compressor(self.toxic + self.ordinary, self.level)]
        return self._made

    def features(self, text: str | None) -> tuple[float, float, float]:
        """The largest saving, the mean of the three largest, and the share of windows with one of 2 bytes or more."""
        plain, both = (c.compress for c in self._pair())
        saved = [len(plain(ANCHOR + w)) - len(both(ANCHOR + w)) for w in windows(_prepared(text))]
        if not saved:
            return 0.0, 0.0, 0.0
        top = sorted(saved)[-3:]
        return float(max(top[-1], 0)), max(sum(top) / 3, 0.0), math.sqrt(sum(s >= 2 for s in saved) / len(saved))

    def score(self, text: str | None) -> float:
        if len(self.weights) == 1:
            return self.weights[0]
        z = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def _compressor(raw: bytes, level: int) -> zstandard.ZstdCompressor:
    raw += ANCHOR
    params = zstandard.ZstdCompressionParameters.from_level(level, dict_size=len(raw), source_size=WINDOW + len(ANCHOR), write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    held = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=params)


def fit(rows: list[tuple[str | None, int]]) -> Model:
    """A model of (text, label) rows, whatever their order. All of them train the dictionaries; they calibrate by folds."""
    rows = sorted(rows, key=lambda r: (zlib.crc32((r[0] or "").encode()), r[0] or "", r[1]))
    kinds = [list(dict.fromkeys(_prepared(t) for t, y in rows if y == label)) for label in (0, 1)]
    y = np.array([y for _, y in rows], float)
    if not all(kinds):
        return Model(b"", b"", (float(bool(kinds[1])),))
    folds = [{raw: k % FOLDS for k, raw in enumerate(kind)} for kind in kinds]
    counts = [[Counter() for _ in range(FOLDS)] for _ in kinds]
    for fold, count in zip(folds, counts, strict=True):
        for raw, f in fold.items():
            count[f].update(_grams(raw))

    def trained(without: int | None) -> Model:
        """The dictionaries of all folds but one."""
        ordinary, toxic = ([raw for raw, f in fold.items() if f != without] for fold in folds)
        few, many = (sum((c for f, c in enumerate(count) if f != without), Counter()) for count in counts)
        own = _distinctive(toxic, many, few, max(1, len(ordinary))) if toxic else []
        pool = [w for raw in ordinary for w in windows(raw)]
        listed = b"".join(dict.fromkeys(own))[-TOXIC_BYTES:]
        return Model(_trained(pool[:: max(1, len(pool) // 60_000)], ORDINARY_BYTES, WINDOW), _trained(own, TOXIC_BYTES // 2, 16) + listed, (0.0,) * 4)

    x = {level: np.ones((len(rows), 4)) for level in LEVELS}
    for f in range(FOLDS):
        part = trained(f)
        own = [k for k, (text, label) in enumerate(rows) if folds[label][_prepared(text)] == f]
        for level, features in x.items():
            scorer = Model(part.ordinary, part.toxic, part.weights, level)
            for k in own:
                features[k, 1:] = scorer.features(rows[k][0])
    found = [(_area(features @ (w := _logistic(features, y)), y), level, w) for level, features in x.items()]
    area, level, w = max(found, key=lambda t: t[0])
    if area < LEAST_AUC:
        return Model(b"", b"", (float(y.mean()),))
    w[0] -= _best_threshold(x[level] @ w, y)
    model = trained(None)
    return Model(model.ordinary, model.toxic, tuple(w.tolist()), level)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights by Newton steps with a small ridge; both kinds weigh alike."""
    share = float(y.mean())
    w = np.zeros(x.shape[1])
    each = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
        g = x.T @ (each * (y - p)) - 0.5 * w
        h = (x * (each * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(w))
        w = w + np.clip(np.linalg.solve(h, g), -4, 4)
    return w


def _area(z: np.ndarray, y: np.ndarray) -> float:
    """How often a toxic row scores above an ordinary one; ties count half."""
    ordinary = np.sort(z[y == 0])
    below = np.searchsorted(ordinary, z[y == 1], "left") + np.searchsorted(ordinary, z[y == 1], "right")
    return float(below.mean()) / (2 * len(ordinary))


def _best_threshold(z: np.ndarray, y: np.ndarray) -> float:
    """The middle of the gap that gives the best F1 on the sample."""
    order = np.argsort(-z, kind="stable")
    zs, ys = z[order], y[order]
    hit = np.cumsum(ys)
    f1 = 2 * hit / (np.arange(1, len(ys) + 1) + ys.sum())
    last = np.append(zs[:-1] != zs[1:], True)
    f1 = np.where(last, f1, -1)
    k = int(f1.argmax())
    return float(zs[k] + zs[k + 1]) / 2 if k + 1 < len(zs) else float(zs[k]) - 1


def sample(documents: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> list[tuple[str | None, int]]:
    """At most ``most`` labelled documents of each kind that aren't held out, those of the smallest id hashes, with ``chars`` characters in all at most (a document that would exceed them is left out whole)."""
    marked = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter("y in (0, 1) and doc_id is not null").filter(~held_out(F.col("doc_id")))
    best = [marked.filter(F.col("y") == y).groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for y in (0, 1)]
    chosen = best[0].unionByName(best[1])  # at most 2 * most short rows
    found = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    out, left = [], chars
    for r in found.orderBy(F.length("text"), "doc_id", "text").toLocalIterator():
        left -= len(r.text or "")
        if left < 0:
            break
        out.append((r.text, r.y))
    return out


def held_out(doc_id):
    """crc32 of the id as text, mod 5, is 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def scored(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of each document. The model is of bounded size and goes to every worker."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                scores = [own.score(x.as_py()) for x in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    key = F.col(id_col).cast("long")
    rows = documents.select(key.alias("doc_id"), F.coalesce(held_out(key), F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
