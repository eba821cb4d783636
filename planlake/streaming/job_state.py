"""The latest state of each job as a table in buckets of jobs.

A batch writes only the latest states it brings, to the buckets of its own jobs. Reading takes the latest state of each job over all
parts of its bucket. That is the same whatever parts are merged, read twice or left over after a crash, so there is nothing to
commit: a part is written whole before the parts it replaces go.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: A table's rows, and its folders part=.../bucket=... .
SCHEMA = "job_id string, ts timestamp, event_id long, status string"
STORED = SCHEMA + ", part string, bucket int"


def latest_state(rows: DataFrame) -> DataFrame:
    """One batch: the latest status of each job (job_id, ts, event_id, status); of equal times the largest event_id, then status."""
    return rows.groupBy("job_id").agg(F.max(F.struct("ts", "event_id", "status")).alias("last")).select("job_id", "last.*")


def upsert(batch: DataFrame, path: str, number: int, buckets: int = 64, parts: int = 16) -> None:
    """Bring in a batch (job_id, ts, event_id, status), numbered from 0. A repeated batch writes the same part again.

    Every bucket that then has ``parts`` parts or more is compacted. ``buckets`` may not change over a table's life; it bounds the
    files of a batch, and a bucket should fit a task. Rows without a job_id are one job; an empty batch changes nothing.
    """
    new = latest_state(batch.select(F.col("job_id").cast("string"), "ts", F.col("event_id").cast("long"), "status"))
    new = new.withColumn("bucket", F.pmod(F.xxhash64("job_id"), F.lit(buckets)).cast("int"))
    new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/part=batch-{number}")
    compact(batch.sparkSession, path, parts)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Merge on read: one row per job (job_id, ts, event_id, status)."""
    return latest_state(spark.read.schema(STORED).option("basePath", path).parquet(path))


def compact(spark: SparkSession, path: str, parts: int = 16) -> int:
    """Merge the small parts of each bucket that has ``parts`` or more and say how many parts went.

    A part over four times as large as all smaller ones stays as it is, so the bulk of a bucket is rewritten only when new states
    have grown to a quarter of it. The driver sees folder names and sizes, never rows. Readers that started before may have to
    read again, since parts they listed go.
    """
    fs, found = _parts(spark, path)
    old = [p for of in found.values() if len(of) >= parts for p in _smaller(of)]
    if not old:
        return 0
    stored = spark.read.schema(STORED).option("basePath", path).parquet(*old)
    merged = latest_state(stored.withColumn("job_id", F.struct("bucket", "job_id"))).select("job_id.*", "ts", "event_id", "status")
    merged.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/part=merged-{uuid.uuid4().hex}")
    for p in old:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        fs.delete(folder, True)
        if not any(f.isDirectory() for f in fs.listStatus(folder.getParent())):
            fs.delete(folder.getParent(), True)
    return len(old)


def _smaller(sized: list[tuple[int, str]]) -> list[str]:
    """Parts in order of size, up to one that outweighs those before it."""
    total, taken = 0, []
    for size, name in sorted(sized):
        if len(taken) > 1 and size > 4 * total:
            break
        total += size
        taken.append(name)
    return taken


def _parts(spark: SparkSession, path: str) -> tuple:
    """The file system, and of each bucket (size, folder) of its parts."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found: dict[str, list[tuple[int, str]]] = {}
    for part in fs.listStatus(root):
        for bucket in fs.listStatus(part.getPath()):
            if bucket.isDirectory() and bucket.getPath().getName().startswith("bucket="):
                size = fs.getContentSummary(bucket.getPath()).getLength()
                found.setdefault(bucket.getPath().getName(), []).append((size, bucket.getPath().toString()))
    return fs, found
