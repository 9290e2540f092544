"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Date functions work in UTC; AQE re-plans shuffles from real sizes. Shuffle
# partitions are left to the cluster: AQE coalesces them when data is small.
# Rows that go to Python may hold long texts, so few of them go at a time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}

# Folders made in this process, by application, for `clear_scratch`.
_made: dict[str, list[str]] = {}


def prepare_session(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder for an intermediate table, on storage every executor sees.

    The parent is the folder in ``spark.checkpoint.dir``. Where that is unset,
    it is ``_scratch`` in the warehouse folder, which a cluster shares as well.
    """
    parent = spark.conf.get("spark.checkpoint.dir", None)
    if not parent:
        parent = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    path = f"{parent.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stored(df: DataFrame, label: str = "stored", by: tuple[str, ...] = ()) -> DataFrame:
    """The frame written once to the scratch folder and read back, which cuts its lineage.
    It is partitioned by the columns ``by``, so that filters on them leave other files unread."""
    path = scratch_path(df.sparkSession, label)
    df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a ``stored`` frame that nothing reads any more."""
    files = df.inputFiles()
    if files:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside, a query's shuffle files go when it ends, not when the driver collects its garbage.
    For rounds of queries of which none runs twice; what they leave is ``stored``."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def clear_scratch(spark: SparkSession) -> int:
    """Delete the intermediate tables made so far, and return how many there were.

    Lazy results that still read them can't be used afterwards.
    """
    paths = _made.pop(spark.sparkContext.applicationId, [])
    jvm = spark.sparkContext._jvm
    for path in paths:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return len(paths)
