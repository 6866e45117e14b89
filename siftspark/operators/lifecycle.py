"""Lifecycle and relational operators over the tables of a document store.

documents: (document_id, title, filename, status, active_version_id, created_at, file_sha256);
jobs: (job_id, document_id, kind, status, stage, progress, attempt, created_at, started_at,
finished_at); collections and memberships; snapshots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STAGES = (("queued", 5), ("parsing", 20), ("chunking", 45), ("embedding", 70), ("indexing", 90), ("finalizing", 99))
ACTIVE = ("queued", "running")


# jobs


def monotone_progress(events: DataFrame) -> DataFrame:
    """Adds the progress a job shows after each event (job_id, event_id, progress): it never falls."""
    w = Window.partitionBy("job_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("shown", F.max(F.least(F.greatest("progress", F.lit(0)), F.lit(100))).over(w))


def job_states(events: DataFrame) -> DataFrame:
    """(job_id, progress, stage, started_at, finished_at) after all events (job_id, event_id, stage, progress, ts)."""
    done = F.col("stage").isin("succeeded", "failed")
    return events.groupBy("job_id").agg(F.max("progress").alias("progress"), F.max_by("stage", "event_id").alias("stage"), F.min("ts").alias("started_at"), F.max(F.when(done, F.col("ts"))).alias("finished_at"))


def stage_progress(stage: Column) -> Column:
    out = F.when(stage == "succeeded", F.lit(100))
    for name, p in STAGES:
        out = out.when(stage == name, F.lit(p))
    return out


def job_problems(jobs: DataFrame) -> DataFrame:
    """Progress, attempts and times that can't be."""
    code = F.when(~F.col("progress").between(0, 100), F.lit("PROGRESS_RANGE")).when(F.col("attempt") < 1, F.lit("ATTEMPT_RANGE")).when(F.col("started_at") > F.col("finished_at"), F.lit("TIME_ORDER"))
    return jobs.select("job_id", code.alias("code")).filter("code is not null")


def reconciled_jobs(jobs: DataFrame) -> DataFrame:
    """After a restart: what was running failed; what had succeeded stays."""
    stale = F.col("status") == "running"
    return jobs.withColumn("error", F.when(stale, F.lit("STALE_JOB"))).withColumn("status", F.when(stale, F.lit("failed")).otherwise(F.col("status")))


def reconciled_builds(versions: DataFrame) -> DataFrame:
    stale = F.col("status") == "building"
    return versions.withColumns({"quarantine": stale, "status": F.when(stale, F.lit("failed")).otherwise(F.col("status"))})


def accepted_requests(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Reindex, delete and retry requests (document_id, kind): busy documents are refused, a retry needs a failed job and counts up."""
    w = Window.partitionBy("document_id").orderBy(F.col("created_at").desc(), F.col("job_id").desc())
    latest = jobs.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("document_id", "status", "attempt")
    both = requests.join(latest, "document_id", "left")
    busy = F.coalesce(F.col("status").isin(*ACTIVE), F.lit(False))
    code = F.when(busy, F.lit("DOCUMENT_BUSY")).when((F.col("kind") == "retry") & ~F.coalesce(F.col("status") == "failed", F.lit(False)), F.lit("NOT_FAILED"))
    return both.select("document_id", "kind", code.alias("refused"), F.when(code.isNull(), F.when(F.col("kind") == "retry", F.col("attempt") + 1).otherwise(F.lit(1))).alias("attempt"))


def lock_key(document_id: Column) -> Column:
    """The upper 64 bits of a UUID without the sign, as a number."""
    high = F.substring(F.translate(document_id, "-", ""), 1, 16)
    return F.conv(high, 16, 10).cast("decimal(20,0)") % F.lit(str(2**63)).cast("decimal(20,0)")


def deleted(documents: DataFrame, chunks: DataFrame, jobs: DataFrame, memberships: DataFrame, gone: DataFrame) -> dict[str, DataFrame]:
    """All tables without the gone documents: what depends on them goes with them."""
    drop = lambda t: t.join(gone.select("document_id"), "document_id", "left_anti")
    return {"documents": drop(documents), "chunks": drop(chunks), "jobs": drop(jobs), "memberships": drop(memberships)}


def inconsistent_documents(documents: DataFrame, versions: DataFrame) -> DataFrame:
    """Ready documents whose active version is missing or isn't ready."""
    v = versions.select(F.col("version_id").alias("active_version_id"), F.col("status").alias("version_status"))
    both = documents.filter("status = 'READY'").join(v, "active_version_id", "left")
    return both.filter("version_status is null or version_status <> 'READY'").select("document_id", F.coalesce("version_status", F.lit("MISSING")).alias("version_status"))


def index_health(snapshots: DataFrame, pointer: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(code) of an active snapshot that is missing, not ready, or empty; by: columns of the pointer that go along."""
    both = pointer.join(snapshots, pointer.active_snapshot_id == snapshots.snapshot_id, "left")
    code = F.when(F.col("active_snapshot_id").isNull(), F.lit("NO_ACTIVE_SNAPSHOT")).when(F.col("snapshot_id").isNull(), F.lit("SNAPSHOT_MISSING")).when(F.col("status") != "active", F.lit("SNAPSHOT_NOT_ACTIVE")).when(F.col("chunk_count") < 1, F.lit("SNAPSHOT_EMPTY"))
    return both.select(*(by or []), code.alias("code")).filter("code is not null")


def activated(snapshots: DataFrame, new: str) -> DataFrame:
    """The new snapshot is active, the one before superseded and remembered."""
    prior = F.max(F.when(F.col("status") == "active", F.col("snapshot_id"))).over(Window.partitionBy(F.lit(0)))
    status = F.when(F.col("snapshot_id") == new, F.lit("active")).when(F.col("status") == "active", F.lit("superseded")).otherwise(F.col("status"))
    return snapshots.withColumn("prior_snapshot_id", F.when(F.col("snapshot_id") == new, prior).otherwise(F.col("prior_snapshot_id"))).withColumn("status", status)


def rolled_back(documents: DataFrame, failures: DataFrame) -> DataFrame:
    """Failed documents (document_id, prior_version_id) point to their prior version; without one they are failed."""
    both = documents.join(failures.withColumn("_failed", F.lit(True)), "document_id", "left")
    failed = F.coalesce("_failed", F.lit(False))
    return both.withColumn("active_version_id", F.when(failed, F.col("prior_version_id")).otherwise(F.col("active_version_id"))).withColumn("status", F.when(failed & F.col("prior_version_id").isNull(), F.lit("FAILED")).otherwise(F.col("status"))).select(documents.columns)


# lists


def page_of(rows: DataFrame, order: list[tuple[str, bool]], size: int, after: dict | None = None) -> DataFrame:
    """A page by keyset: size + 1 rows after a row, in an order of (column, descending); the last row only tells that there is more."""
    if not 1 <= size <= 100:
        raise ValueError("a page has 1 to 100 rows")
    if after is not None:
        later, equal = F.lit(False), F.lit(True)
        for name, down in order:
            at = F.lit(after[name])
            later = later | (equal & ((F.col(name) < at) if down else (F.col(name) > at)))
            equal = equal & (F.col(name) == at)
        rows = rows.filter(later)
    w = [F.col(n).desc() if d else F.col(n).asc() for n, d in order]
    return rows.orderBy(*w).limit(size + 1)


def listed_documents(documents: DataFrame, size: int = 20, status: str | None = None, memberships: DataFrame | None = None, collection_id: object = None, after: dict | None = None) -> DataFrame:
    if status is not None:
        documents = documents.filter(F.col("status") == status)
    if collection_id is not None:
        documents = documents.join(memberships.filter(F.col("collection_id") == collection_id).select("document_id"), "document_id", "left_semi")
    return page_of(documents, [("created_at", True), ("document_id", True)], size, after)


def listed_chunks(chunks: DataFrame, document_id: object, size: int = 20, kind: str | None = None, after: int | None = None) -> DataFrame:
    own = chunks.filter(F.col("document_id") == document_id)
    own = own if kind is None else own.filter(F.col("kind") == kind)
    return page_of(own, [("chunk_index", False)], size, None if after is None else {"chunk_index": after})


def collection_counts(collections: DataFrame, memberships: DataFrame) -> DataFrame:
    counts = memberships.groupBy("collection_id").agg(F.count("*").alias("n_documents"))
    return collections.join(counts, "collection_id", "left").withColumn("n_documents", F.coalesce("n_documents", F.lit(0)))


def added_members(memberships: DataFrame, new: DataFrame) -> DataFrame:
    return memberships.select("collection_id", "document_id").unionByName(new.select("collection_id", "document_id")).distinct()


def removed_members(memberships: DataFrame, gone: DataFrame) -> DataFrame:
    return memberships.join(gone.select("collection_id", "document_id"), ["collection_id", "document_id"], "left_anti")


def collection_problems(collections: DataFrame) -> DataFrame:
    """Names that repeat, are empty, or exceed 120 characters: (name, code)."""
    long = collections.filter(~F.length("name").between(1, 120)).select("name", F.lit("NAME_LENGTH").alias("code"))
    return long.unionByName(collections.groupBy("name").count().filter("count > 1").select("name", F.lit("NAME_TAKEN").alias("code")))


def latest_per_group(rows: DataFrame, by: str, at: str, value: str, where: Column | None = None) -> DataFrame:
    """(by, value): the value of the newest row of each group, the largest on ties. One aggregation, no window."""
    rows = rows if where is None else rows.filter(where)
    return rows.groupBy(by).agg(F.max_by(value, F.struct(at, value)).alias(value))


def active_jobs(jobs: DataFrame) -> DataFrame:
    return latest_per_group(jobs, "document_id", "created_at", "job_id", F.col("status").isin(*ACTIVE))


def documents_by_hash(documents: DataFrame) -> DataFrame:
    return latest_per_group(documents, "file_sha256", "created_at", "document_id", F.col("status") != "DELETED")


def last_messages(messages: DataFrame, n: int = 4) -> DataFrame:
    """The last n messages of each conversation, oldest first (position from 1)."""
    down = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").desc()))
    kept = messages.withColumn("_n", down).filter(F.col("_n") <= n).drop("_n")
    return kept.withColumn("position", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
