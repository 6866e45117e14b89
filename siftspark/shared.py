"""Intermediate tables in the shared folder that the session names in spark.checkpoint.dir."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few numbers or words each (some MB) that may be broadcast.
FEW = 200_000
#: Bytes of rows that one Arrow batch holds at most; a longer row stands alone.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Only where none is set and all runs in one process (tests), one is made and set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='siftspark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def bounded_batches(spark: SparkSession) -> None:
    """Sees to it that Arrow batches are bounded by bytes, as 10,000 long texts would not fit a worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    # a plain number of bytes, or with a unit
    number, unit = re.fullmatch(r"(-?\d+)([bkmgt]?)b?", (spark.conf.get(key, None) or "-1").strip().lower()).groups()
    if not 0 < int(number) << 10 * " kmgt".find(unit.replace("b", " ") or " ") <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def stored(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """df, written to the shared folder and read again: it is computed once, and lost executors lose nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Removes tables made by stored() that no later result reads."""
    for df in tables:
        spark = df.sparkSession
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(conf).delete(path, True)


def few(df: DataFrame, most: int = FEW) -> DataFrame:
    """A table of short rows, marked for a broadcast if it has at most ``most`` rows; else it is joined by a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def spread(df: DataFrame) -> DataFrame:
    """A table in fewer pieces than there are cores, dealt out to all of them; others stay as they are read."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)
