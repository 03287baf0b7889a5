"""Session helpers: building a session, finding the shared folder, reading tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app_name: str = "millrace", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every job here relies on (UTC, AQE, dynamic overwrite)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_LOCAL_FOLDERS: dict[str, str] = {}


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, the folder every executor can reach.

    Only a local session (tests, a laptop) may go without the setting and gets a temporary folder.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        if context.applicationId not in _LOCAL_FOLDERS:
            _LOCAL_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="millrace-")
        base = _LOCAL_FOLDERS[context.applicationId]
    return f"{base.rstrip('/')}/millrace/{purpose}-{uuid.uuid4().hex}"


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Scan one Parquet table."""
    return spark.read.parquet(f"{root}/{name}.parquet")


MANY_SPLITS = 64
ROWS_A_TASK = 50_000  # of a scan that is dealt out
CROWDED = 4  # a scan stays as it is up to so many times as many rows a split


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-heavy work on a *scan* even tasks, of a bounded number of rows, and a partition per core at least.

    Splits go by bytes, and narrow rows are well compressed: millions of them may come as one split. The rows are counted,
    which for a plain scan reads the files' footers only. A table that came in enough splits (`MANY_SPLITS`, or the number
    of cores) of no more than `CROWDED * ROWS_A_TASK` rows on average is left alone, so no large texts are shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits, rows = df.rdd.getNumPartitions(), df.count()
    if splits >= min(cores, MANY_SPLITS) and rows <= splits * CROWDED * ROWS_A_TASK:
        return df
    return df.repartition(max(cores, -(-rows // ROWS_A_TASK)))


def explode_once(df: DataFrame, keep: list[str], array: Column, name: str) -> DataFrame:
    """`explode` for arrays that are costly to compute. The plain form is given a filter on the array's size, which
    makes Spark compute the array again."""
    return df.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


MAX_BROADCAST_BYTES = 32 * 1024 * 1024


def is_small(df: DataFrame) -> bool:
    """Whether a rule table may be broadcast: its size as text is measured, not estimated."""
    row_bytes = F.length(F.to_json(F.struct(*df.columns))) + 100
    return (df.agg(F.sum(row_bytes)).first()[0] or 0) <= MAX_BROADCAST_BYTES
