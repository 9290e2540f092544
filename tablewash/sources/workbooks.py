"""Fleets of XLSX workbooks as DataFrames.

One Python stage turns each file into one record per sheet row, whose cells are an array
by column. What is known of a sheet (its size, header, columns and types) comes
from aggregations over the records by sheet, and is joined to them once per sheet: no
row is put together from cells again. All this covers any number of files and sheets.
"""

from __future__ import annotations

from typing import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewash.functions import cells as kinds
from tablewash.functions.cells import number_text
from tablewash.errors import StepError
from tablewash.session import stored
from tablewash.reports.profile import CODE, text_kind, type_from_kinds
from tablewash.sources import xlsx_cells
from tablewash.table import Table

# The reading helper travels with the job: executors need no installed package.
cloudpickle.register_pickle_by_value(xlsx_cells)

CELL = "k string, s string, n double, b boolean, had_formula boolean, missing_value boolean"
ROWS = f"path string, sheet_index int, sheet string, row int, cells array<struct<{CELL.replace(' ', ':').replace(',:', ',')}>>"
_TYPES = {"string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
_CELL = pa.struct([(c.split()[0], _TYPES[c.split()[1]]) for c in CELL.split(", ")])
ARROW_ROWS = pa.schema(
    [("path", pa.string()), ("sheet_index", pa.int32()), ("sheet", pa.string()), ("row", pa.int32()), ("cells", pa.list_(_CELL))]
)
SHEET = ["path", "sheet"]
CELLS_PER_BATCH = 20_000
# Columns of a fleet's table, whose schema the driver builds.
MAX_COLUMNS = 20_000
HEADER_CANDIDATES = 10
# The score of a header candidate, per cell.
FILLED, SHORT, SHORT_LENGTH, BRACES, METADATA, BLANK = 2, 1, 40, -3, -2, -1
MACHINE_METADATA = r"""(?i)["']?(?:UniqueId|DisplayName|Name)["']?\s*[:=]"""


def read_workbook_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows ``(path, content)``, one per workbook file."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.[xX][lL][sS][xX]").load(path).select("path", "content")


def workbook_rows(files: DataFrame) -> DataFrame:
    """One record per row of a sheet's used range, blank rows included, from ``(path, content)``."""

    sheet_rows, schema = xlsx_cells.sheet_rows, ARROW_ROWS

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                name = path.as_py()
                for found in sheet_rows(content.as_py()):
                    rows.append((name, *found))
                    size += 1 + len(found[-1])
                    if size >= CELLS_PER_BATCH:
                        yield as_batch(rows)
                        rows, size = [], 0
        if rows:
            yield as_batch(rows)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return files.select("path", "content").mapInArrow(parse, ROWS)


def parsed_workbooks(files: DataFrame) -> DataFrame:
    """The records of ``workbook_rows``, parsed once and stored by sheet."""
    return stored(workbook_rows(files), "sheets", by=("sheet",))


def _text(cell: Column) -> Column:
    return (
        F.when(cell["k"] == "s", cell["s"])
        .when(cell["k"] == "n", number_text(cell["n"]))
        .when(cell["k"] == "b", cell["b"].cast("string"))
        .otherwise(F.lit(""))
    )


def first_line(text: Column) -> Column:
    """The first non-blank line of a header cell, trimmed."""
    lines = F.transform(F.split(text, "\r?\n"), lambda line: F.btrim(line, F.lit(kinds.WHITESPACE)))
    return F.coalesce(F.get(F.filter(lines, lambda line: line != ""), F.lit(0)), F.lit(""))


def _points(cell: Column) -> Column:
    """What a cell adds to its row's score as a header; a filled cell takes back its own blank."""
    text = _text(cell)
    raw, shown = F.btrim(text, F.lit(kinds.WHITESPACE)), first_line(text)
    return (
        F.when(shown != "", FILLED - BLANK + F.when(F.length(shown) <= SHORT_LENGTH, SHORT).otherwise(0)).otherwise(0)
        + F.when(raw.startswith("{") & raw.endswith("}"), BRACES).otherwise(0)
        + F.when(text.rlike(MACHINE_METADATA), METADATA).otherwise(0)
    )


def choose_header_rows(rows: DataFrame, header_rows: dict[str, int] | None = None) -> DataFrame:
    """Rows ``(path, sheet, sheet_index, width, height, header_row, header, auto_detected)``.

    The header is the best of the first ten rows, the earliest of equal ones; or the row that
    ``header_rows`` names for the sheet. A chosen row past the end of a sheet fails the
    job. One aggregation by sheet, to which only candidates bring their cells.
    """
    chosen = F.lit(None).cast("int")
    if header_rows:
        chosen = F.create_map(*[F.lit(x) for pair in header_rows.items() for x in pair])[F.col("sheet")]
    row = F.col("row")
    candidate = row < HEADER_CANDIDATES
    # Blanks take the same from all rows of a sheet, whose width is one.
    score = F.when(candidate, F.aggregate("cells", F.lit(0), lambda total, cell: total + F.coalesce(_points(cell), F.lit(0))))
    scored = rows.select(
        *SHEET,
        "sheet_index",
        "row",
        F.size("cells").alias("size"),
        chosen.alias("chosen"),
        F.when(candidate, F.struct(score.alias("score"), (-row).alias("early"))).alias("rank"),
        F.when(candidate | row.eqNullSafe(chosen), F.col("cells")).alias("cells"),
    )
    found = scored.groupBy(*SHEET).agg(
        F.min("sheet_index").alias("sheet_index"),
        F.max("size").alias("width"),
        (F.max("row") + 1).alias("height"),
        F.max("chosen").alias("chosen"),
        F.max_by(F.struct("row", "cells"), "rank").alias("best"),
        F.max_by("cells", F.when(row == F.col("chosen"), row)).alias("named"),
    )
    auto = F.col("chosen").isNull()
    inside = auto | F.col("chosen").between(0, F.col("height") - 1)
    problem = F.concat(F.lit("header row out of range for sheet "), F.col("sheet"))
    number = F.when(auto, F.col("best.row")).when(inside, F.col("chosen")).otherwise(F.raise_error(problem).cast("int"))
    return found.select(
        *SHEET,
        "sheet_index",
        "width",
        "height",
        number.alias("header_row"),
        F.when(auto, F.col("best.cells")).otherwise(F.col("named")).alias("header"),
        auto.alias("auto_detected"),
    )


def sheet_columns(sheets: DataFrame) -> DataFrame:
    """Rows ``(path, sheet, col, column_id, display_name, base_name, blank, repeat)`` from headers."""
    spaces = f"[{kinds.WHITESPACE_CLASS}]+"
    clean = F.coalesce(F.btrim(F.regexp_replace("text", spaces, " "), F.lit(kinds.WHITESPACE)), F.lit(""))
    named = (
        sheets.filter("width > 0")
        .select(*SHEET, "header", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("col"))
        .select(*SHEET, "col", first_line(_text(F.get("header", F.col("col")))).alias("text"))
        .withColumn("blank", clean == "")
        .withColumn("label", F.when(clean == "", F.lit("Column")).otherwise(clean))
        .withColumn("label_key", F.lower("label"))
    )
    # A sheet has at most 16,384 columns, which bounds these windows.
    same_label = Window.partitionBy(*SHEET, "label_key").orderBy("col")
    based = named.withColumn("repeat", F.row_number().over(same_label)).withColumn(
        "base_name", F.first("label").over(same_label)
    )
    stem = F.regexp_replace(F.lower("base_name"), "[^a-z0-9]+", "_")
    stem = F.btrim(stem, F.lit("_"))
    stemmed = based.withColumn("stem", F.concat(F.lit("col_"), F.when(stem == "", F.lit("column")).otherwise(stem)))
    use = F.row_number().over(Window.partitionBy(*SHEET, "stem").orderBy("col"))
    return stemmed.select(
        *SHEET,
        "col",
        F.when(use == 1, F.col("stem")).otherwise(F.concat("stem", F.lit("_"), use.cast("string"))).alias("column_id"),
        F.when(F.col("repeat") == 1, F.col("base_name"))
        .otherwise(F.concat("base_name", F.lit(" ("), F.col("repeat").cast("string"), F.lit(")")))
        .alias("display_name"),
        "base_name",
        "blank",
        "repeat",
    )


def body_rows(rows: DataFrame, sheets: DataFrame) -> DataFrame:
    """Records below the header: ``(path, sheet, row_id, cells)``, row ids counting from 1."""
    number = (F.col("row") - F.col("header_row")).alias("row_id")
    return rows.join(sheets.select(*SHEET, "header_row"), SHEET).filter(F.col("row") > F.col("header_row")).select(*SHEET, number, "cells")


def sheet_types(body: DataFrame, columns: DataFrame) -> DataFrame:
    """Rows ``(path, sheet, column_id, logical_type)``."""

    def kind(cell: Column) -> Column:
        known = F.when(cell["k"] == "b", CODE["boolean"]).when(cell["k"] == "n", CODE["number"])
        return known.otherwise(text_kind(cell["s"]))

    found = (
        body.select(*SHEET, F.posexplode(F.transform("cells", kind)).alias("col", "kind"))
        .groupBy(*SHEET, "col")
        .agg(F.bit_or("kind").alias("kinds"))
    )
    every = columns.select(*SHEET, "col", "column_id").join(found, [*SHEET, "col"], "left")
    return every.select(*SHEET, "column_id", type_from_kinds(F.col("kinds")).alias("logical_type"))


def sheet_table(rows: DataFrame, sheet: str, header_rows: dict[str, int] | None = None) -> Table:
    """All sheets of one name as one table, rows identified by file and number, from
    the records of ``parsed_workbooks``.

    The columns are those of all the files together, matched by column id; a
    column whose type differs between files is mixed.
    """
    mine = rows.filter(F.col("sheet") == sheet)
    sheets = stored(choose_header_rows(mine, header_rows), "headers")
    columns = stored(sheet_columns(sheets), "columns")
    body = body_rows(mine, sheets)
    kinds_found = (
        sheet_types(body, columns)
        .filter("logical_type <> 'unknown'")
        .groupBy("column_id")
        .agg(F.collect_set("logical_type").alias("kinds"))
    )
    # The column list of a sheet layout, which the driver needs to build the schema.
    layout = (
        columns.groupBy("column_id")
        .agg(F.min("col").alias("col"), F.min_by("display_name", F.struct("col", "path")).alias("name"))
        .join(kinds_found, "column_id", "left")
        .orderBy("col", "column_id")
        .limit(MAX_COLUMNS + 1)
        .collect()
    )
    if len(layout) > MAX_COLUMNS:
        raise StepError("tooManyColumns", f"the sheets {sheet!r} have over {MAX_COLUMNS} different columns")
    types = {r["column_id"]: _merged(r["kinds"]) for r in layout}
    # Where each of the table's columns is in a sheet, one array per sheet.
    own = columns.groupBy(*SHEET).agg(F.map_from_entries(F.collect_list(F.struct("column_id", "col"))).alias("own"))
    places = own.select(*SHEET, F.transform(F.array(*map(F.lit, types)), lambda c: F.try_element_at("own", c)).alias("places"))
    wide = body.join(places, SHEET).select(
        F.col("path").alias("__path"),
        F.col("row_id").alias("__number"),
        *[_typed(F.get("cells", F.get("places", F.lit(i))), kind).alias(c) for i, (c, kind) in enumerate(types.items())],
    )
    return Table.of(wide, ("__path", "__number"), names={r["column_id"]: r["name"] for r in layout}, types=types)


def _merged(found: list[str] | None) -> str:
    if not found:
        return "unknown"
    if len(found) == 1:
        return found[0]
    return "string" if set(found) <= {"string", "date", "datetime"} else "mixed"


def _typed(cell: Column, kind: str) -> Column:
    if kind == "number":
        return cell["n"]
    if kind == "boolean":
        return cell["b"]
    if kind == "mixed":
        return F.when(cell["k"].isNotNull(), F.struct(*[cell[f].alias(f) for f in "ksnb"])).cast(kinds.MIXED)
    return cell["s"]
