"""Sharding by proportional stratified interleaving.

The rows of each source are put in a seeded random order, and the k-th of n rows
gets the fractional rank (k - 1/2) / n. Sorting all rows by that rank interleaves
the sources in proportion, so any stretch of the order has the mixture of the
whole, and cutting it at equal row counts gives shards that match it.

Both rankings are made without a global sort: rows fall into buckets by the
leading bits of their key, whose counts are summed up in order; a row's rank
is what lies in the buckets before its own plus its place in that one. Random
keys and fractional ranks both fill buckets evenly, whatever a source's share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewash.session import stored

SEED = "interleave-1"
# Leading hexadecimal digits of a row's key: 65,536 buckets for each source.
KEY_DIGITS = 4
RANK_BUCKETS = 65_536


def row_key(doc_id: Column) -> Column:
    """The seeded shuffle's key: rows of a source go by it."""
    return F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def interleaved_shards(
    docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """``(doc_id, size, text_crc32, source, rank, shard, slot)`` for every row of ``docs``.

    Row counts of shards differ by one at most, and ``slot`` counts from 0 without
    gaps in each. ``size`` is the text's length in bytes plus 1; a null text is empty.
    A null source is a source of its own, and a null id is the empty id. Rows that
    repeat an id go by the text's checksum and size, and equal rows in any order, so
    ranks don't depend on the partitions. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stored(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.col(source_col).alias("source"),
            row_key(F.col(id_col)).alias("key"),
        ).withColumns(
            {"stratum": F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")), "bucket": F.substring("key", 1, KEY_DIGITS)}
        ),
        "rows",
    )
    within = ["key", "doc_id", "text_crc32", "size"]
    counts = rows.groupBy("stratum", "bucket").agg(F.count("*").alias("here"))
    by_source = Window.partitionBy("stratum")
    before = counts.select(
        "stratum",
        "bucket",
        (F.sum("here").over(by_source.orderBy("bucket")) - F.col("here")).alias("before"),
        F.sum("here").over(by_source).alias("total"),
    )
    place = F.row_number().over(Window.partitionBy("stratum", "bucket").orderBy(*within))
    ranked = (
        rows.withColumn("place", place)
        .join(before, ["stratum", "bucket"])
        .withColumn("rank", (2 * (F.col("before") + F.col("place")) - 1) / (2 * F.col("total")))
        .withColumn("bucket", F.least(F.floor(F.col("rank") * RANK_BUCKETS), F.lit(RANK_BUCKETS - 1)).cast("int"))
        .drop("place", "before", "total")
    )
    ranked = stored(ranked, "ranked")
    # One row per bucket, so at most RANK_BUCKETS rows meet in the running sum.
    counts = ranked.groupBy("bucket").agg(F.count("*").alias("here"))
    everything = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = counts.select(
        "bucket", (F.sum("here").over(everything) - F.col("here")).alias("before"), F.sum("here").over(whole).alias("total")
    )
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("rank", "stratum", *within))
    position = F.col("before") + F.col("place") - 1
    return (
        ranked.withColumn("place", place)
        .join(before, "bucket")
        .withColumn("position", position)
        .withColumn("shard", F.expr(f"cast(position * {shards} div total as int)"))
        .withColumn("first", F.expr(f"(shard * total + {shards - 1}) div {shards}"))
        .select("doc_id", "size", "text_crc32", "source", "rank", "shard", (F.col("position") - F.col("first")).alias("slot"))
    )
