"""Structured Streaming: documents that arrive are normalised, chunked and indexed batch by batch.

A micro-batch writes its chunks and its part of the index where no reader looks and publishes
both by one line of the index's log, so a batch that fails half-way, or is run again, leaves
nothing half or twice. Statistics are those of all published parts, as after a rebuild.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from siftspark import shared
from siftspark.config import ChunkConfig
from siftspark.operators import indexing
from siftspark.operators.chunking import chunk_texts
from siftspark.operators.segments import Index
from siftspark.streaming.answers import BUCKETS, ROCKSDB

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def document_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


CHUNKS = "chunks"


def write_batch(batch: DataFrame, batch_id: int, root: str, cfg: ChunkConfig | None = None) -> None:
    """The chunks of one micro-batch and their index, published together; a batch that is in already changes nothing."""
    index = Index(batch.sparkSession, root)
    name = f"batch-{batch_id}"
    if name in index.state.batches:
        return
    # chunks are numbered on from those that any version has had
    base = sum(f["docs"] for p, f in index.state.facts.items() if p.startswith("shards/"))
    rows = chunk_texts(batch, cfg).withColumn("index_id", F.lit(None).cast("long"))
    numbered = indexing.allocate_ids(shared.stored(rows, "chunks"), ["doc_id", "chunk_index"]).withColumn("index_id", F.col("index_id") + base)
    chunks = shared.stored(numbered, "chunks")
    index.add(chunks, name, "index_id", "retrieval_content", replace=False, also={CHUNKS: chunks})


def start(stream: DataFrame, root: str, cfg: ChunkConfig | None = None, once: bool = True) -> StreamingQuery:
    """Ingests what there is (once), or goes on; the checkpoint under root remembers what was read."""
    writer = stream.writeStream.foreachBatch(lambda batch, batch_id: write_batch(batch, batch_id, root, cfg)).option("checkpointLocation", f"{root}/_checkpoint")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def read_index(spark: SparkSession, root: str) -> Index:
    """The index over all published batches; its ids are the chunks' index_id."""
    return Index(spark, root)


def read_chunks(spark: SparkSession, root: str) -> DataFrame:
    """The chunks of all published batches."""
    index = Index(spark, root)
    parts = [f"{root}/{p}" for p in index.state.tables.get(CHUNKS, [])]
    return spark.read.parquet(*parts) if parts else spark.createDataFrame([], "doc_id long, chunk_id string, index_id long")


SHOWN = "job_id string, progress int, stage string, events long, version long"
_SHOWN = [x.split()[0] for x in SHOWN.split(", ")]
FAILED = "failed"


class Jobs(StatefulProcessor):
    """The jobs of a bucket, whose states are one row of arrays: each one's largest progress and the stage of its latest event by id.

    A timer, for the first that can be stale, fails the jobs for which nothing comes.
    """

    def __init__(self, stale_ms: int):
        self.stale_ms = stale_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("jobs", "job_id array<string>, progress array<int>, stage array<string>, latest array<long>, events array<long>, version array<long>, last array<long>, failed array<boolean>, timer long")

    def _held(self) -> tuple[dict[str, list], int | None]:
        if not self.state.exists():
            return {}, None
        *own, timer = self.state.get()
        return {job: list(x) for job, *x in zip(*own, strict=True)}, timer

    def _keep(self, jobs: dict[str, list], timer: int | None) -> None:
        self.state.update((list(jobs), *(list(x) for x in zip(*jobs.values(), strict=True)), timer))

    def _shown(self, jobs: dict[str, list], changed: Iterable[str]) -> pd.DataFrame:
        rows = ((job, *jobs[job]) for job in changed)
        return pd.DataFrame([(job, progress, FAILED if failed else stage, events, version) for job, progress, stage, _, events, version, _, failed in rows], columns=_SHOWN)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        (jobs, timer), changed = self._held(), {}
        for pdf in rows:
            for job, event, stage, progress, ts in zip(*(pdf[c].tolist() for c in ("job_id", "event_id", "stage", "progress", "ts_ms")), strict=True):
                own = jobs.setdefault(job, [0, "queued", -1, 0, 0, 0, False])
                changed[job] = True
                own[0] = max(own[0], min(int(progress), 100))
                if event > own[2]:
                    own[2], own[1] = event, str(stage)
                own[3] += 1
                own[5] = max(own[5], ts)  # an event that comes late moves nothing
        for job in changed:
            jobs[job][4] += 1
            jobs[job][6] = False
        due = min(jobs[job][5] for job in changed) + self.stale_ms
        if timer is None or due < timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = due
            self.handle.registerTimer(timer)
        self._keep(jobs, timer)
        yield self._shown(jobs, changed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        expired, watermark = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        (jobs, _), failed, timer = self._held(), [], None
        for job, own in jobs.items():
            due = own[5] + self.stale_ms
            if own[6]:
                continue
            if due <= expired or due < watermark:
                own[4], own[6] = own[4] + 1, True
                failed.append(job)
            else:
                timer = due if timer is None else min(due, timer)
        if timer is not None:
            self.handle.registerTimer(timer)
        self._keep(jobs, timer)
        yield self._shown(jobs, failed)

    def close(self) -> None:
        pass


def job_progress(events: DataFrame, delay: str = "1 day", stale: timedelta = timedelta(days=2), buckets: int = BUCKETS) -> DataFrame:
    """A stream of job events (job_id, event_id, ts, stage, progress) to the jobs' states, each with a version that grows.

    Progress never falls, and the stage is that of the largest event id, in whatever batch it
    came. A job for which nothing has come until ``stale`` after its last event is shown as
    failed; an event after that shows it again. Events later than ``delay`` are dropped. Python is
    called for a bucket of jobs, not for each, and reads and writes their states together, so the buckets should
    be so many that some thousand jobs fall in each.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = events.withWatermark("ts", delay).withColumn("ts_ms", F.unix_millis("ts")).withColumn("bucket", F.pmod(F.xxhash64("job_id"), F.lit(buckets)))
    return rows.groupBy("bucket").transformWithStateInPandas(Jobs(int(stale.total_seconds() * 1000)), outputStructType=SHOWN, outputMode="update", timeMode="eventTime")


def event_counts(events: DataFrame, delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums of events (ts, event_type, value) per window and type; events later than the delay are dropped by the watermark, which also ends the state of windows."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
