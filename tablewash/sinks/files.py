"""Writing tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewash.functions import cells
from tablewash.functions.cells import Cell
from tablewash.functions.colors import readable_text_color
from tablewash.table import FILL, Table


def _csv_field(text: Column) -> Column:
    """Quoted if it is empty, holds a comma, quote or line break, or has white space at an edge."""
    space = F.array(*map(F.lit, cells.WHITESPACE))
    edge = F.array_contains(space, F.substring(text, 1, 1)) | F.array_contains(space, F.substring(text, -1, 1))
    needed = (text == "") | text.rlike('[",\\r\\n]') | edge
    return F.when(needed, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_lines(table: Table, keep_nulls: bool = False) -> DataFrame:
    """``(value)``: the rows as CSV lines in row order, without a header."""
    fields = []
    for c in table.columns:
        text = cells.text(Cell(F.col(c.id), c.type, c.spark))
        fields.append(F.coalesce(_csv_field(text), F.lit("" if keep_nulls else '""')))
    return table.sorted_df().select(F.concat_ws(",", *fields).alias("value"))


def write_csv(table: Table, path: str, keep_nulls: bool = False, mode: str = "errorifexists") -> None:
    """CSV files in row order, each with a header, fills ignored. Null and empty text are
    both written ``""``; with ``keep_nulls`` a null is an unquoted empty field. Lines end
    with CRLF; line breaks inside a field stay as they are."""
    spark = table.df.sparkSession
    names = spark.createDataFrame([tuple(c.name for c in table.columns)], ", ".join(f"c{i} string" for i in range(len(table.columns))))
    header = names.select(F.concat_ws(",", *[_csv_field(F.col(c)) for c in names.columns])).first()[0]
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    first = F.when(place == 0, F.array(F.lit(header), F.col("value"))).otherwise(F.array("value"))
    lines = csv_lines(table, keep_nulls).select(F.explode(first).alias("value"))
    lines.write.mode(mode).option("lineSep", "\r\n").text(path)
    if spark.read.text(path).isEmpty():
        alone = spark.createDataFrame([(header,)], "value string").coalesce(1)
        alone.write.mode("append").option("lineSep", "\r\n").text(path)


def write_parquet(table: Table, path: str, ordered: bool = False, mode: str = "errorifexists") -> None:
    """The visible columns; ``ordered`` sorts the files into row order."""
    source = table.sorted_df() if ordered else table.df
    replace(table, df=source).to_df().write.mode(mode).parquet(path)


def cell_formats(table: Table) -> DataFrame:
    """Rows ``(row id columns, column_id, fill_color, font_color)``, one per filled cell."""
    filled = [c for c in table.ids if c in table.fills]
    if not filled:
        empty = F.lit(None).cast("string")
        none = table.df.select(*table.row_id, *[empty.alias(n) for n in ("column_id", "fill_color", "font_color")])
        return none.limit(0)
    pairs = F.array(*[F.struct(F.lit(c).alias("column_id"), F.col(FILL + c).alias("fill_color")) for c in filled])
    kept = F.filter(pairs, lambda p: p["fill_color"].isNotNull())
    return table.df.select(*table.row_id, F.inline(kept)).withColumn(
        "font_color", readable_text_color(F.col("fill_color"))
    )


def write_formats(table: Table, path: str, mode: str = "errorifexists") -> None:
    cell_formats(table).write.mode(mode).parquet(path)
