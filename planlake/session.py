"""Session helpers: a tuned builder, shared scratch folder, written intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "planlake", cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with AQE on; a cluster's own session works just as well."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir where set; on a single machine (tests) an own one. A cluster must set it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = os.path.join(tempfile.gettempdir(), "planlake-checkpoints")
    return found.rstrip("/")


#: Paths written by this process, one list per open scope; results that aren't written yet may still read them.
_scopes: list[list[str]] = [[]]


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder, which goes with the scope that is open now."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _scopes[-1].append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage and survives lost executors.

    The table stays until its ``scratch`` scope ends or, outside of scopes, until ``drop_materialized``, since results read it
    when they are computed.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, paths: list[str]) -> int:
    n = len(paths)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(conf).delete(path, True)
    return n


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside the scope go when it ends: write or count results before. Scopes may be nested."""
    own: list[str] = []
    _scopes.append(own)
    try:
        yield
    finally:
        _scopes[:] = [s for s in _scopes if s is not own]
        _delete(spark, own)


def drop_materialized(spark: SparkSession) -> int:
    """Delete what this process has written outside of scopes and say how many; call it once all results are written."""
    return _delete(spark, _scopes[0])


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """A broadcast hint if ``df`` has at most ``max_rows`` rows (counted, not guessed), else ``df`` for a shuffle join."""
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df
