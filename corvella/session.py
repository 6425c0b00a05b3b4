"""Session factory and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "corvella", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution; only what the engine needs is set."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }.items():
        b = b.config(k, v)
    return b.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only a local master gets one of its own where that is unset."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="corvella-"))
    return sc.getCheckpointDir().rstrip("/")


def staged(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, and survives lost executors."""
    return _staged(df, what)[0]


def _staged(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


@contextmanager
def scratch(spark: SparkSession):
    """``staged`` for tables that nothing reads any more afterwards; their folders are deleted then."""
    paths: list[str] = []

    def keep(df: DataFrame, what: str) -> DataFrame:
        out, path = _staged(df, what)
        paths.append(path)
        return out

    try:
        yield keep
    finally:
        for path in paths:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def wide(spark: SparkSession, rows: int, per: int = 20_000):
    """Shuffles of the jobs run inside have a partition for each ``per`` of ``rows``, or the session's number if that is more; adaptive execution joins small ones.

    So a task's share stays the same however large the table is.  It holds for jobs that run inside, not for a lazy result that is read later.
    """
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(max(int(before), -(-rows // per))))
    try:
        yield
    finally:
        spark.conf.set(key, before)
