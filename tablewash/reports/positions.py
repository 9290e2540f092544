"""Dense row positions without a single-partition window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewash.session import scratch_path
from tablewash.table import Table

IN_PARTITION = (1 << 33) - 1


def dense_positions(table: Table) -> DataFrame:
    """Rows ``(row id columns, position)``, position counting from 0 in row order.

    The keys are sorted across the cluster and written with each row's
    partition and place in it, so the numbers stay valid if an executor is lost
    later. The offsets are one number per partition of the sorted table.
    """
    spark = table.df.sparkSession
    names = list(dict.fromkeys(list(table.row_id) + [k.column for k in table.order]))
    path = scratch_path(spark, "positions")
    keys = table.df.select(*names)
    (
        (keys if table.in_order else keys.orderBy(*table.order_columns()))
        .select(
            *table.row_id,
            F.spark_partition_id().alias("__part"),
            F.monotonically_increasing_id().bitwiseAND(F.lit(IN_PARTITION)).alias("__place"),
        )
        .write.parquet(path)
    )
    placed = spark.read.parquet(path)
    sizes = sorted((r["__part"], r["count"]) for r in placed.groupBy("__part").count().collect())
    offsets, total = [], 0
    for part, size in sizes:
        offsets.append((part, total))
        total += size
    # One row per sort partition, so its size follows the shuffle, not the data.
    per_part = spark.createDataFrame(offsets, "__part int, __offset bigint")
    return placed.join(F.broadcast(per_part), "__part").select(
        *table.row_id, (F.col("__offset") + F.col("__place")).alias("position")
    )
