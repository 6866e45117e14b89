"""A term-bucketed index of segments: written once, added to, deleted from, merged, and searched with score bounds.

A segment is what one batch of documents adds. Its documents stand in shards of a bounded
size, numbered from 0; a block holds the postings of one term in one shard, with the largest
frequency and the shortest length in it, which bound its scores under any corpus statistics. Blocks
lie in folders by hash of the term, so that a search reads the folders of its terms only.
Deleted documents are tombstones by shard until a merge drops them; statistics are always those
of the documents that live, as after a rebuild. What is visible is decided by the log of
``commits``.

A search reads the blocks of all asked terms once. The statistics of the terms follow from
them. A first pass scores, in each shard, the best documents that a query's rarest terms name; the
k-th of these scores is one to beat in every shard. Then, shard by shard, each query adds up its
lists from the highest bound down; as soon as the lists that are left can't lift a new document
over that score, they are only looked up for the documents that still can get there.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark import shared
from siftspark.functions import text as T
from siftspark.operators import indexing, retrieval
from siftspark.operators.commits import Log, State

BUCKETS = 32
#: Documents and tokens of a shard.
SHARD_DOCS, SHARD_TOKENS = 1 << 14, 1 << 20
#: Tokens that are put into a shard at a time.
PART_TOKENS = 1 << 16
#: Queries that one pass may broadcast.
QUERY_BLOCK = 4096
#: Postings of a query's rarest terms that the first pass reads, in numbers of results.
LEAD = 16
#: Sums of floats in another order differ by less.
SLACK = 1e-6

BLOCKS = "term string, shard string, n int, max_tf int, min_dl int, docs array<int>, tfs array<int>, bucket int"
SHARDS = "shard string, ids array<bigint>, dls array<int>"
DEAD = "shard string, docs array<int>"
_BUILT = "term string, shard string, n int, max_tf int, min_dl int, docs array<int>, tfs array<int>, ids array<bigint>"
_STREAM = "shard string, kind int, term string, ids array<bigint>, docs array<int>, tfs array<int>"
_DOCUMENTS, _DEAD, _ALLOWED, _BLOCK = range(4)
_HITS = "qid long, id long, score double, postings long, read long"


def bucket(term: Column, buckets: int = BUCKETS) -> Column:
    """Of a term; ``zlib.crc32`` gives the same."""
    return (F.crc32(term.cast("binary")) % buckets).cast("int")


def _lists(values: np.ndarray, starts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), pa.array(values, kind))


def _shard(name: str, ids: np.ndarray, sizes: np.ndarray, coded: pa.DictionaryArray) -> pa.RecordBatch:
    """The blocks of some documents by term, and one row without a term that has their ids and lengths."""
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    keys, tfs = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(ids) + np.repeat(place, sizes), return_counts=True)
    own, docs, dls = keys // len(ids), keys % len(ids), sizes[order]
    starts = np.flatnonzero(np.diff(own, prepend=-1))
    n = np.diff(np.append(starts, len(keys)))
    most = np.maximum.reduceat(tfs, starts) if len(starts) else starts
    least = np.minimum.reduceat(dls[docs], starts) if len(starts) else starts
    none = pa.nulls(len(starts), pa.list_(pa.int64()))
    blocks = pa.RecordBatch.from_arrays(
        [coded.dictionary.take(pa.array(own[starts])).cast(pa.string()), pa.array([name] * len(starts), pa.string()), pa.array(n, pa.int32()), pa.array(most, pa.int32()), pa.array(least, pa.int32()), _lists(docs, starts, pa.int32()), _lists(tfs, starts, pa.int32()), none],
        names=[x.split()[0] for x in _BUILT.split(", ")],
    )
    whole = pa.RecordBatch.from_pylist([{"term": None, "shard": name, "n": len(ids), "max_tf": None, "min_dl": None, "docs": dls.tolist(), "tfs": None, "ids": ids[order].tolist()}], schema=blocks.schema)
    return pa.concat_batches([whole, blocks])


def _parts(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of some thousand tokens, so that a shard ends near its size; a longer document stands alone."""
    ends = b.column("terms").offsets.to_numpy()
    at = 0
    while at < b.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, ends[at] + PART_TOKENS, "right")) - 1)
        yield b.slice(at, end - at)
        at = end


def built(tokens: DataFrame, segment: str, shard_docs: int = SHARD_DOCS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Blocks and shards of (id, terms). Postings are counted where the documents are; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        ids, sizes, terms, docs, count = [], [], [], 0, 0

        def out() -> pa.RecordBatch:
            coded = pa.chunked_array(terms).unify_dictionaries().combine_chunks()
            terms.clear()
            return _shard(f"{segment}-{task}-{number}", np.concatenate(ids), np.concatenate(sizes), coded)

        for b in batches:
            for part in _parts(b):
                own = part.column("terms")
                ids.append(part.column("id").to_numpy().astype(np.int64))
                sizes.append(np.diff(own.offsets.to_numpy()).astype(np.int64))
                terms.append(own.flatten().dictionary_encode())  # each term of a part once, not its words
                docs, count = docs + part.num_rows, count + int(sizes[-1].sum())
                if docs >= shard_docs or count >= shard_tokens:
                    yield out()
                    number += 1
                    pa.default_memory_pool().release_unused()
                    ids, sizes, terms, docs, count = [], [], [], 0, 0
        if docs:
            yield out()

    shared.bounded_batches(tokens.sparkSession)
    return tokens.select(F.col("id").cast("long").alias("id"), "terms").filter("id is not null").mapInArrow(run, _BUILT)


@dataclass
class Index:
    """An index of the documents that a root's log lists. ids are unique among those that live."""

    spark: SparkSession
    root: str
    buckets: int = BUCKETS
    state: State = field(init=False)

    def __post_init__(self) -> None:
        self.log = Log(self.spark, self.root)
        self.state = self.log.state()

    def refresh(self) -> Index:
        self.state = self.log.state()
        return self

    # tables

    def blocks(self, buckets: list[int] | None = None) -> DataFrame:
        """Blocks, of some buckets only: the others' folders are not even listed."""
        parts = self.state.tables.get("blocks", [])
        if not parts:
            return self.spark.createDataFrame([], BLOCKS)
        read = [self.spark.read.schema(BLOCKS).parquet(f"{self.root}/{p}") for p in parts]
        out = read[0]
        for r in read[1:]:
            out = out.unionByName(r)
        return out if buckets is None else out.filter(F.col("bucket").isin(buckets))

    def shards(self) -> DataFrame:
        return self.log.read("shards", SHARDS, self.state)

    def dead(self) -> DataFrame:
        """One row per shard that has tombstones."""
        found = self.log.read("dead", DEAD, self.state)
        return found.groupBy("shard").agg(F.array_distinct(F.flatten(F.collect_list("docs"))).alias("docs"))

    def documents(self) -> DataFrame:
        """(id, dl, shard, doc) of the documents that live."""
        flat = self.shards().select("shard", F.posexplode(F.arrays_zip("ids", "dls")).alias("doc", "x")).select(F.col("x.ids").alias("id"), F.col("x.dls").cast("long").alias("dl"), "shard", "doc")
        if not self.state.tables.get("dead"):
            return flat
        return flat.join(self.dead().select("shard", F.explode("docs").alias("doc")), ["shard", "doc"], "left_anti")

    def statistics(self) -> tuple[int, int]:
        """Number of documents that live, and of their tokens: sums over the facts of parts."""
        facts = [self.state.facts[p] for t in ("shards", "dead") for p in self.state.tables.get(t, [])]
        return sum(f["docs"] for f in facts), sum(f["tokens"] for f in facts)

    # changes

    def add(self, documents: DataFrame, batch: str, id_col: str = "id", text_col: str = "text", replace: bool = True, also: dict[str, DataFrame] | None = None) -> Index:
        """Indexes a batch; documents whose ids are there already take their place. A batch that is in already changes nothing.

        also: parts of other tables that become visible with it.
        """
        facts: dict[str, dict] = {}

        def write(state: State) -> dict[str, str]:
            self.state = state
            parts = {t: self.log.part(t) for t in ("blocks", "shards", "dead")}
            segment = parts["blocks"].rsplit("/", 1)[1][:12]
            made = shared.stored(built(indexing.tokenised(documents, id_col, text_col), segment), "built")
            self._write(made, parts)
            facts[parts["shards"]] = self._facts(parts["shards"])
            if replace and state.tables.get("shards") and facts[parts["shards"]]["docs"]:
                ids = made.filter("term is null").select(F.explode("ids").alias("id"))
                facts[parts["dead"]] = self._tombstones(ids, parts["dead"])
            if not facts.get(parts["dead"], {}).get("docs"):
                parts.pop("dead")
            for name, rows in (also or {}).items():
                parts[name] = self.log.part(name)
                rows.write.parquet(f"{self.root}/{parts[name]}")
            return parts

        self.state = self.log.commit(batch, write, facts)
        return self

    def delete(self, ids: DataFrame, batch: str) -> Index:
        """Tombstones for documents (id); those that aren't there are passed over."""
        facts: dict[str, dict] = {}

        def write(state: State) -> dict[str, str]:
            self.state = state
            part = self.log.part("dead")
            facts[part] = self._tombstones(ids, part)
            return {"dead": part} if facts[part]["docs"] else {}

        self.state = self.log.commit(batch, write, facts)
        return self

    def merge(self, most_docs: int | None = None, shard_docs: int = SHARD_DOCS) -> Index:
        """One segment of all that have ``most_docs`` documents at most (None: of all), without what is deleted; small shards become whole ones."""
        state = self.state
        small = [k for k, p in enumerate(state.tables.get("shards", [])) if most_docs is None or state.facts[p]["docs"] <= most_docs]
        if len(small) < 2 and not state.tables.get("dead"):
            return self
        old = {t: [state.tables[t][k] for k in small] for t in ("blocks", "shards")}
        old["dead"] = state.tables.get("dead", []) if len(small) == len(state.tables["shards"]) else []
        view = Index.__new__(Index)
        view.__dict__.update(self.__dict__, state=State(state.version, {**old, "dead": state.tables.get("dead", [])}, facts=state.facts))
        parts = {t: self.log.part(t) for t in ("blocks", "shards")}
        segment = parts["blocks"].rsplit("/", 1)[1][:12]
        # where each living document goes: shards of about the same size, by id
        live = view.documents()
        n = live.count()
        shards = max(1, -(-n // shard_docs))
        moved = live.withColumn("to", F.concat(F.lit(f"{segment}-"), F.pmod(F.xxhash64("id"), F.lit(shards)).cast("string")))
        new = moved.groupBy("to").agg(F.array_sort(F.collect_list(F.struct("id", "shard", "doc", "dl"))).alias("all"))
        new = shared.stored(new, "merged")
        whole = new.select(F.col("to").alias("shard"), F.col("all.id").alias("ids"), F.transform("all.dl", lambda x: x.cast("int")).alias("dls"))
        place = shared.stored(new.select(F.col("to"), F.posexplode("all").alias("new", "x")).select("to", "new", "x.shard", "x.doc", "x.dl"), "places")
        flat = view.blocks().select("term", "shard", F.explode(F.arrays_zip("docs", "tfs")).alias("x")).select("term", "shard", F.col("x.docs").alias("doc"), F.col("x.tfs").alias("tf"))
        again = flat.join(place, ["shard", "doc"]).groupBy("term", "to").agg(F.array_sort(F.collect_list(F.struct("new", "tf"))).alias("all"), F.max("tf").alias("max_tf"), F.min("dl").cast("int").alias("min_dl"), F.count("*").cast("int").alias("n"))
        made = again.select("term", F.col("to").alias("shard"), "n", "max_tf", "min_dl", F.col("all.new").alias("docs"), F.col("all.tf").alias("tfs"))
        self._write_blocks(made, parts["blocks"])
        whole.write.parquet(f"{self.root}/{parts['shards']}")
        # tombstones that also name documents of other segments stay; those of shards that are gone say nothing any more
        facts = {parts["shards"]: self._facts(parts["shards"])}
        if old["dead"] == [] and state.tables.get("dead"):
            kept = self.log.part("dead")
            gone = view.shards().select("shard")
            left = self.dead().join(gone, "shard", "left_anti")
            rest = Index.__new__(Index)
            rest.__dict__.update(self.__dict__, state=State(state.version, {"shards": [p for p in state.tables["shards"] if p not in old["shards"]]}, facts=state.facts))
            left.write.parquet(f"{self.root}/{kept}")
            facts[kept] = rest._dead_facts(kept)
            if facts[kept]["docs"]:
                parts["dead"] = kept
            old["dead"] = state.tables["dead"]
        self.state = self.log.replace(old, parts, facts, state)
        return self

    def _write_blocks(self, made: DataFrame, part: str) -> None:
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        placed = made.withColumn("bucket", bucket(F.col("term"), self.buckets))
        # a frequent term's blocks go to several tasks, by shard, and so many that no bucket is much to one of them
        spread = F.pmod(F.xxhash64("shard"), F.lit(max(4, -(-4 * n // self.buckets))))
        placed.repartition(n, "bucket", spread).sortWithinPartitions("bucket", "term", "shard").write.partitionBy("bucket").parquet(f"{self.root}/{part}")

    def _write(self, made: DataFrame, parts: dict[str, str]) -> None:
        self._write_blocks(made.filter("term is not null").drop("ids"), parts["blocks"])
        made.filter("term is null").select("shard", "ids", F.col("docs").alias("dls")).write.parquet(f"{self.root}/{parts['shards']}")

    def _facts(self, part: str) -> dict:
        found = self.spark.read.schema(SHARDS).parquet(f"{self.root}/{part}")
        row = found.agg(F.sum(F.size("ids")).alias("docs"), F.sum(F.aggregate("dls", F.lit(0).cast("long"), lambda a, x: a + x)).alias("tokens")).first()
        return {"docs": row.docs or 0, "tokens": row.tokens or 0}

    def _tombstones(self, ids: DataFrame, part: str) -> dict:
        found = self.documents().join(ids.select(F.col("id").cast("long").alias("id")).distinct(), "id", "left_semi")
        found.groupBy("shard").agg(F.array_sort(F.collect_list("doc")).alias("docs")).write.parquet(f"{self.root}/{part}")
        return self._dead_facts(part)

    def _dead_facts(self, part: str) -> dict:
        """Negative numbers of documents and tokens, so that facts add up."""
        gone = self.spark.read.schema(DEAD).parquet(f"{self.root}/{part}").withColumnRenamed("docs", "gone")
        row = self.shards().join(gone, "shard").agg(F.sum(F.size("gone")).alias("docs"), F.sum(F.aggregate("gone", F.lit(0).cast("long"), lambda a, x: a + F.get("dls", x))).alias("tokens")).first()
        return {"docs": -(row.docs or 0), "tokens": -(row.tokens or 0)}

    # search

    def search(self, queries: DataFrame, k: int | None = 30, k1: float = 1.5, b: float = 0.75, minimum: int = 1, scope: DataFrame | None = None) -> DataFrame:
        """(qid, id, score, rank) as ``retrieval.bm25`` gives them over a rebuilt index."""
        return retrieval.ranked(self._hits(queries, k, k1, b, minimum, scope).select("qid", "id", "score").filter("id is not null"), k)

    def postings_read(self, queries: DataFrame, k: int | None = 30, k1: float = 1.5, b: float = 0.75, minimum: int = 1) -> DataFrame:
        """(qid, postings, read): postings of the query's terms, and how many of them the search added up or looked up."""
        return self._hits(queries, k, k1, b, minimum, None).groupBy("qid").agg(F.sum("postings").alias("postings"), F.sum("read").alias("read"))

    def _hits(self, queries: DataFrame, k: int | None, k1: float, b: float, minimum: int, scope: DataFrame | None) -> DataFrame:
        n_docs, n_tokens = self.statistics()
        none = self.spark.createDataFrame([], _HITS)
        if not n_docs or not n_tokens:
            return none
        out = None
        allowed = None if scope is None else shared.stored(self.documents().join(scope.select(F.col("id").cast("long").alias("id")).distinct(), "id", "left_semi").groupBy("shard").agg(F.collect_list("doc").alias("docs")), "allowed")
        asked = queries.select("qid", F.array_distinct(T.tokens(F.coalesce("text", F.lit("")))).alias("terms")).filter("size(terms) > 0")
        for block in _query_blocks(asked):
            part = self._block_hits(block, n_docs, n_tokens / n_docs, k, k1, b, minimum, allowed)
            out = part if out is None else out.unionByName(part)
        return none if out is None else out

    def _block_hits(self, block: list, n_docs: int, avgdl: float, k: int | None, k1: float, b: float, minimum: int, allowed: DataFrame | None) -> DataFrame:
        terms = sorted({t for r in block for t in r.terms})
        wanted = self.spark.createDataFrame(pa.table({"term": pa.array(terms, pa.string())}))
        folders = sorted({zlib.crc32(t.encode()) % self.buckets for t in terms})
        blocks = shared.stored(self.blocks(folders).join(F.broadcast(wanted), "term").drop("bucket"), "asked")
        dead = self.dead() if self.state.tables.get("dead") else None
        counted = blocks.select("term", "shard", "n", "docs")
        if dead is not None:
            counted = counted.join(dead.withColumnRenamed("docs", "gone"), "shard", "left").withColumn("n", F.col("n") - F.when(F.col("gone").isNull(), 0).otherwise(F.size(F.array_intersect("docs", "gone"))))
        df = {r.term: r.df for r in counted.groupBy("term").agg(F.sum("n").alias("df")).filter("df > 0").toLocalIterator()}  # a row per asked term
        idf = {t: float(np.log((n_docs - n + 0.5) / (n + 0.5) + 1)) for t, n in df.items()}
        plan = []
        for r in block:
            own = [(t, idf[t]) for t in sorted(r.terms, key=lambda t: (-idf.get(t, 0), t)) if t in idf]
            plan.append((r.qid, own, min(minimum, len(r.terms)), _leading([df[t] for t, _ in own], k or 0)))
        column = lambda c: F.lit(None).cast(c)
        rows = self.shards().select("shard", F.lit(_DOCUMENTS).alias("kind"), column("string").alias("term"), "ids", F.col("dls").alias("docs"), column("array<int>").alias("tfs"))
        for kind, marks in ((_DEAD, dead), (_ALLOWED, allowed)):
            if marks is not None:
                rows = rows.unionByName(marks.select("shard", F.lit(kind).alias("kind"), column("string").alias("term"), column("array<bigint>").alias("ids"), "docs", column("array<int>").alias("tfs")))
        posted = blocks.select("shard", F.lit(_BLOCK).alias("kind"), "term", column("array<bigint>").alias("ids"), "docs", "tfs")
        least: dict[int, float] = {}
        if k is None:
            return self._pass(rows, posted, plan, {}, avgdl, k, k1, b, allowed is not None)
        first = shared.stored(self._pass(rows, posted, plan, {}, avgdl, k, k1, b, allowed is not None, True), "first")
        top = retrieval.ranked(first.filter("id is not null").select("qid", "id", "score"), k).filter(F.col("rank") == k)
        least = {r.qid: r.score - SLACK for r in top.select("qid", "score").toLocalIterator()}  # a row per query of the block
        found = self._pass(rows, posted, plan, least, avgdl, k, k1, b, allowed is not None)
        return found.unionByName(first.filter("id is null").withColumn("postings", F.lit(0).cast("long")))

    def _pass(self, rows: DataFrame, posted: DataFrame, plan: list, least: dict[int, float], avgdl: float, k: int | None, k1: float, b: float, limited: bool, lead: bool = False) -> DataFrame:
        """Each task's best of some shards; with ``lead`` only of the documents that the rarest terms name first. A task gets whole shards, one after the other."""
        held = self.spark.sparkContext.broadcast((plan, least))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, floor = held.value
            found = _Found([q for q, *_ in own], k, floor)
            for shard in _shards(batches, k1, b, avgdl, limited):
                for place, (_, lists, need, leading) in enumerate(own):
                    if lead:
                        shard.lead(place, lists, need, found, leading)
                    else:
                        shard.search(place, lists, need, found)
                if k is None:
                    yield from found.taken()
            yield from found.taken()

        shared.bounded_batches(self.spark)
        return rows.unionByName(posted).repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(run, _HITS)


def _query_blocks(asked: DataFrame) -> Iterator[list]:
    held = []
    for r in asked.toLocalIterator():
        held.append(r)
        if len(held) == QUERY_BLOCK:
            yield held
            held = []
    if held:
        yield held


def _leading(counts: list[int], k: int) -> int:
    """How many of a query's terms, rarest first, the first pass reads: those with LEAD postings a result together, and so many that there are k."""
    seen = 0
    for n, count in enumerate(counts):
        if seen >= k and seen + count > LEAD * k:
            return n
        seen += count
    return len(counts)


class _Found:
    """The best so far of each query in a task (all, without k), and what was read for it."""

    def __init__(self, qids: list[int], k: int | None, floor: dict[int, float]):
        self.qids, self.k = qids, k
        self.floor = [floor.get(q, 0.0) for q in qids]
        self.ids = [np.zeros(0, np.int64)] * len(qids)
        self.scores = [np.zeros(0)] * len(qids)
        self.postings, self.read = np.zeros(len(qids), np.int64), np.zeros(len(qids), np.int64)

    def bar(self, place: int) -> float:
        """No document below it gets into the result."""
        own = self.scores[place]
        return max(self.floor[place], float(own[-1]) - SLACK if self.k is not None and len(own) >= self.k else 0.0)

    def add(self, place: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate((self.ids[place], ids)), np.concatenate((self.scores[place], scores))
        if self.k is not None:
            order = np.lexsort((ids, -np.round(scores, 9)))[: self.k]
            ids, scores = ids[order], scores[order]
        self.ids[place], self.scores[place] = ids, scores

    def taken(self) -> Iterator[pa.RecordBatch]:
        """All that was found, and a row without id for what was read for each query."""
        sizes = [len(x) for x in self.ids]
        qids = np.array(self.qids, np.int64)
        zeros = pa.array(np.zeros(sum(sizes), np.int64))
        names = [x.split()[0] for x in _HITS.split(", ")]
        if len(qids):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, sizes)), pa.array(np.concatenate(self.ids)), pa.array(np.concatenate(self.scores)), zeros, zeros], names=names)
            yield pa.RecordBatch.from_arrays([pa.array(qids), pa.nulls(len(qids), pa.int64()), pa.nulls(len(qids), pa.float64()), pa.array(self.postings), pa.array(self.read)], names=names)
        self.ids, self.scores = [np.zeros(0, np.int64)] * len(sizes), [np.zeros(0)] * len(sizes)
        self.postings, self.read = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)


class _Shard:
    """Asked postings of some documents, with bounds."""

    def __init__(self, ids: np.ndarray, dls: np.ndarray, k1: float, b: float, avgdl: float):
        self.ids, self.k1 = ids, k1
        self.norm = k1 * (1 - b + b * dls / avgdl)
        self.may = np.ones(len(ids), bool)
        self.lists: dict[str, tuple[np.ndarray, np.ndarray, float]] = {}
        self.score, self.hits = np.zeros(len(ids)), np.zeros(len(ids), np.int32)

    def put(self, term: str, docs: np.ndarray, tfs: np.ndarray) -> None:
        keep = self.may[docs]
        if not keep.all():
            docs, tfs = docs[keep], tfs[keep]
        if len(docs):
            part = tfs * (self.k1 + 1) / (tfs + self.norm[docs])
            self.lists[term] = docs, part, float(part.max())

    def lead(self, place: int, lists: list[tuple[str, float]], need: int, found: _Found, leading: int) -> None:
        """Whole scores of the best documents that a query's ``leading`` rarest lists name; lists: rarest first."""
        own = [(w, *self.lists[t][:2]) for t, w in lists[:leading] if t in self.lists]
        if not own:
            return
        score, hits = self.score, self.hits
        for w, docs, part in own:
            score[docs] += w * part
            hits[docs] += 1
            found.read[place] += len(docs)
        touched = np.flatnonzero(hits)
        kept = touched[np.argsort(-score[touched], kind="stable")[: 2 * found.k]]
        kept.sort()
        found.read[place] += sum(self._look_up(kept, w, *self.lists[t][:2]) for t, w in lists[leading:] if t in self.lists)
        self._take(place, kept[hits[kept] >= need], found)
        score[touched] = 0
        hits[touched] = 0

    def search(self, place: int, lists: list[tuple[str, float]], need: int, found: _Found) -> None:
        own = sorted(((w * self.lists[t][2], w, *self.lists[t][:2]) for t, w in lists if t in self.lists), key=lambda x: -x[0])
        if not own:
            return
        # what the lists after each one can bring at the most
        left = np.append(np.cumsum([x[0] for x in own][::-1])[::-1][1:], 0.0)
        found.postings[place] += sum(len(x[2]) for x in own)
        score, hits, bar, at = self.score, self.hits, found.bar(place), 0
        if own[0][0] + left[0] < bar:
            return  # not even all lists together reach the bar
        # lists that can bring new documents in are added up whole
        while at < len(own) and (at == 0 or left[at - 1] >= bar):
            _, w, docs, part = own[at]
            score[docs] += w * part
            hits[docs] += 1
            found.read[place] += len(docs)
            at += 1
            if found.k is not None and at < len(own):
                fit = score[hits >= need]
                if len(fit) >= found.k and left[at - 1] < float(fit.max()):
                    bar = max(bar, float(np.partition(fit, -found.k)[-found.k]) - SLACK)
        touched = np.flatnonzero(hits)
        kept = touched
        # the others are looked up for documents that still can get there
        for k in range(at, len(own)):
            kept = kept[score[kept] + left[k - 1] >= bar]
            if not len(kept):
                break
            found.read[place] += self._look_up(kept, *own[k][1:])
        self._take(place, kept[(hits[kept] >= need) & (score[kept] >= bar)], found)
        score[touched] = 0
        hits[touched] = 0

    def _look_up(self, kept: np.ndarray, w: float, docs: np.ndarray, part: np.ndarray) -> int:
        """Adds a list's scores for some documents; returns how many places were looked at, on the shorter side."""
        near = np.minimum(np.searchsorted(docs, kept), len(docs) - 1)
        hit = docs[near] == kept
        self.score[kept[hit]] += w * part[near[hit]]
        self.hits[kept[hit]] += 1
        return min(len(kept), len(docs))

    def _take(self, place: int, kept: np.ndarray, found: _Found) -> None:
        if len(kept):
            found.add(place, self.ids[kept], self.score[kept])


def _shards(batches: Iterator[pa.RecordBatch], k1: float, b: float, avgdl: float, limited: bool) -> Iterator[_Shard]:
    """Shards of a stream of rows in order of shard and kind."""
    name, shard = None, None
    for batch in batches:
        kinds, shards, terms = batch.column("kind").to_numpy(), batch.column("shard").to_pylist(), batch.column("term").to_pylist()
        docs, tfs = batch.column("docs"), batch.column("tfs")
        for i, kind in enumerate(kinds.tolist()):
            if shards[i] != name:
                if shard is not None:
                    yield shard
                name, shard = shards[i], None
            own = docs[i].values.to_numpy().astype(np.int64)
            if kind == _DOCUMENTS:
                shard = _Shard(batch.column("ids")[i].values.to_numpy(), own, k1, b, avgdl)
                if limited:
                    shard.may[:] = False
                gone = np.zeros(0, np.int64)
            elif kind == _DEAD:
                gone = own
                if not limited:
                    shard.may[own] = False
            elif kind == _ALLOWED:
                shard.may[own] = True
                shard.may[gone] = False
            else:
                shard.put(terms[i], own, tfs[i].values.to_numpy())
    if shard is not None:
        yield shard
