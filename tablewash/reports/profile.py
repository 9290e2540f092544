"""Column reports: logical types and missing values, one aggregation for all columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewash.functions import cells
from tablewash.table import ColumnInfo, Table


# What a cell can be, one bit each. A cell that fits none, such as an infinite
# number, has a bit of its own, which makes the column mixed.
CODE = {"boolean": 1, "number": 2, "date": 4, "datetime": 8, "text": 16, "opaque": 32}
NO_KIND = 64
TEXTUAL = CODE["text"] | CODE["date"] | CODE["datetime"]


def text_kind(text: Column) -> Column:
    """Code of a text cell: date, datetime or other text. Cheap tests come first."""
    date = (F.length(text) == 10) & text.rlike(cells.ISO_DATE) & text.try_cast("date").isNotNull()
    moment = (F.substring(text, 11, 1) == "T") & cells.iso_instant(text).isNotNull()
    return F.when(date, CODE["date"]).when(moment, CODE["datetime"]).when(text.isNotNull(), CODE["text"])


def _kind(c: ColumnInfo) -> Column:
    """Code of a cell of this column, null for null cells."""
    col = F.col(c.id)
    if c.type == "mixed":
        return (
            F.when(col["k"] == "b", CODE["boolean"])
            .when(col["k"] == "n", CODE["number"])
            .otherwise(text_kind(col["s"]))
        )
    if isinstance(c.spark, T.StringType):
        return text_kind(col)
    known = F.when(col.isNotNull(), CODE.get(c.type, NO_KIND))
    if isinstance(c.spark, (T.DoubleType, T.FloatType)):
        infinite = F.isnan(col) | (F.abs(col) == float("inf"))
        return F.when(infinite, NO_KIND).otherwise(known)
    return known


def type_from_kinds(found: Column) -> Column:
    """The column's type from the bits of the kinds its cells have."""
    case = F.when(found.isNull(), F.lit("unknown"))
    for kind in ("boolean", "number", "date", "datetime", "opaque"):
        case = case.when(found == CODE[kind], F.lit(kind))
    return case.when(found.bitwiseAND(F.lit(TEXTUAL)) == found, F.lit("string")).otherwise(F.lit("mixed"))


def column_types(df: DataFrame, kinds: dict[str, Column]) -> DataFrame:
    """Rows ``(column_id, logical_type)`` from the kind codes of each column.

    The codes are computed in a projection below the aggregation, once per
    cell, and one integer per column gathers which of them occur: wide tables
    keep a small aggregation buffer.
    """
    coded = df.select(*[kind.alias(f"k{i}") for i, kind in enumerate(kinds.values())])
    found = coded.agg(*[F.bit_or(f"k{i}").alias(f"k{i}") for i in range(len(kinds))])
    rows = [
        F.struct(F.lit(column_id).alias("column_id"), type_from_kinds(F.col(f"k{i}")).alias("logical_type"))
        for i, column_id in enumerate(kinds)
    ]
    return found.select(F.inline(F.array(*rows)))


def infer_types(table: Table) -> DataFrame:
    """Rows ``(column_id, logical_type)``, from the values rather than the schema."""
    return column_types(table.df, {c.id: _kind(c) for c in table.columns})


def profile(table: Table) -> DataFrame:
    """Rows ``(column_id, nullable, missing_count)``. Null and empty text are
    missing; whitespace is not."""
    measures, rows = [], []
    for i, info in enumerate(table.columns):
        col = F.col(info.id)
        missing = col.isNull()
        if info.type == "mixed":
            missing = missing | F.coalesce(col["s"] == "", F.lit(False))
        elif isinstance(info.spark, T.StringType):
            missing = missing | (col == "")
        measures += [F.count_if(col.isNull()).alias(f"n{i}"), F.count_if(missing).alias(f"m{i}")]
        rows.append(
            F.struct(
                F.lit(info.id).alias("column_id"),
                (F.col(f"n{i}") > 0).alias("nullable"),
                F.col(f"m{i}").alias("missing_count"),
            )
        )
    return table.df.agg(*measures).select(F.inline(F.array(*rows)))
