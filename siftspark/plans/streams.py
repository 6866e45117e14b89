"""Queries that run as streams: what there is goes through in micro-batches, and what they wrote is read."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from siftspark import shared
from siftspark.functions import text as T
from siftspark.plans.queries import query, rounded, table
from siftspark.plans.records import PIECES
from siftspark.plans.structure import longs
from siftspark.streaming import answers, ingest


def stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table's files as they come: those of its folder, or the one file of its name."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
    reader = spark.readStream.schema(spark.read.parquet(f"{d}/{name}.parquet").schema)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(f"{d}/{name}.parquet")
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(d)


def written(out: DataFrame, mode: str, root: str | None = None) -> DataFrame:
    """All rows that a stream gave out for what there is, with the number of their batch; under the same root it goes on where it was."""
    spark = out.sparkSession
    root = root or f"{shared.shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    put = lambda rows, n: rows.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{root}/rows/part={n}")
    out.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/rows").drop("part")


def arriving(rows: DataFrame, place: Column, n: int, run: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """What a stream gives out for rows that arrive in n parts, in order of their place from 0. It is stopped and started again between them; each part is as many files as tasks write."""
    spark = rows.sparkSession
    root = f"{shared.shared_dir(spark)}/arriving-{uuid.uuid4().hex}"
    rows.withColumn("place", place).write.partitionBy("place").parquet(f"{root}/held")
    held = spark.read.schema(S.StructType([*rows.schema, S.StructField("place", S.IntegerType())])).parquet(f"{root}/held")
    for k in range(n):
        held.filter(F.col("place") == k).drop("place").write.mode("append").parquet(f"{root}/came")
        out = written(run(spark.readStream.schema(rows.schema).parquet(f"{root}/came")), mode, root)
    return out


@query("select date_trunc('hour', ts)::timestamp as start, event_type, count(*) as n, round(sum(value), 6) as total from events group by 1, 2")
def streamed_event_counts(spark, d):
    """Counts per hour and type, every window as it stands after the last batch, those that are still open too."""
    rows = written(ingest.event_counts(stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))), "complete")
    last = rows.groupBy("start", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("s")).select("start", "event_type", "s.*")
    return rounded(last).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("select user_id || '-' || event_id % 5 as job_id, max(least(greatest(floor(value)::bigint, 0), 100)) as progress, case when max(ts) + interval 2 day < (select max(ts) - interval 1 day from events) then 'failed' else arg_max(event_type, event_id) end as stage, count(*) as events from events group by 1")
def streamed_job_progress(spark, d):
    """Jobs' states, kept over five arrivals with events up to twelve hours out of order; jobs for which nothing came for two days have failed."""
    e = table(spark, d, "events").select(F.concat_ws("-", "user_id", F.col("event_id") % 5).alias("job_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("stage"), F.floor("value").cast("int").alias("progress"))
    span = e.agg(F.min("ts").cast("long").alias("first"), F.max("ts").cast("long").alias("last")).first()
    # seconds from the start, moved to and fro by up to six hours
    moved = F.col("ts").cast("long") - span.first + F.pmod(F.xxhash64("event_id"), F.lit(43_200)) - 21_600
    place = F.greatest(F.lit(0), F.least(F.lit(4), F.floor(5 * moved / (span.last - span.first + 1)))).cast("int")
    rows = arriving(shared.spread(e), place, 5, ingest.job_progress, "update")
    return longs(rows.groupBy("job_id").agg(F.max_by(F.struct("progress", "stage", "events"), "version").alias("s")).select("job_id", "s.*"))


@query(f"select conv_id, turn, md5(case when turn % 3 = 0 then '{T.REFUSAL}' when turn % 3 = 1 then 'Insufficient evidence in the sourc' || text else text end) as shown_md5 from conversations where length(text) > 0")
def streamed_answers(spark, d):
    """Answers in parts of eleven characters that come in four arrivals in any order: refusals are shown alone, others whole."""
    t = shared.spread(table(spark, d, "conversations")).filter("length(text) > 0")
    text = F.when(F.col("turn") % 3 == 0, F.concat(F.lit(f"\n {T.REFUSAL.upper()} But "), "text")).when(F.col("turn") % 3 == 1, F.concat(F.lit("Insufficient evidence in the sourc"), "text")).otherwise(F.col("text"))
    cut = F.regexp_extract_all(text, F.lit("(?s).{1,11}"), F.lit(0))
    parts = t.select(F.concat_ws("/", "conv_id", "turn").alias("answer_id"), F.size(cut).alias("n"), F.posexplode(cut).alias("seq", "part"))
    deltas = parts.select("answer_id", "seq", "part", (F.col("seq") == F.col("n") - 1).alias("last"))
    rows = arriving(deltas, F.pmod(F.xxhash64("answer_id", "seq"), F.lit(4)).cast("int"), 4, answers.shown, "append")
    whole = rows.groupBy("answer_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "shown"))), lambda x: x["shown"]), "").alias("text"))
    at = F.split("answer_id", "/")
    return whole.select(F.get(at, 0).cast("long").alias("conv_id"), F.get(at, 1).cast("long").alias("turn"), F.md5("text").alias("shown_md5"))


@query(f"with {PIECES}, z as (select doc_id, count(*) filter (where x <> '') as n, sum(length(x)) as total from (select doc_id, unnest(string_split(text, chr(10))) as x from documents) group by 1) select doc_id, count(*) as n_chunks, sum(length(raw))::bigint as n_chars from text group by 1 union all select doc_id, 1, total::bigint + 2 * (n - 1) from z where total between 1 and 2048")
def ingested_chunks(spark, d):
    """Documents that came as a stream, chunked and indexed: what the index then holds."""
    root = f"{shared.shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    ingest.start(stream(spark, d, "documents"), root).awaitTermination()
    chunks = ingest.read_chunks(spark, root).select("doc_id", "index_id", "character_count")
    indexed = ingest.read_index(spark, root).documents().select(F.col("id").alias("index_id"))
    return chunks.join(indexed, "index_id").groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum("character_count").cast("long").alias("n_chars"))
