"""Import warnings as DataFrames: (code, scope, path, sheet, column_id, detail, cell_count)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewash.sources.csv import CsvImport
from tablewash.sources.workbooks import SHEET

WARNINGS = "code string, scope string, path string, sheet string, column_id string, detail string, cell_count bigint"


def csv_warnings(spark: SparkSession, imported: CsvImport) -> DataFrame:
    """Header and type warnings of a CSV import, one row each."""
    rows = []
    for header, column in zip(imported.headers, imported.table.columns):
        found = []
        if header.blank:
            found.append("blankHeaderGenerated")
        if header.repeat > 1:
            found.append("duplicateHeaderNormalized")
        if column.type == "mixed":
            found.append("mixedTypeColumn")
        rows += [(code, "column", None, None, header.id, header.name, None) for code in found]
    return spark.createDataFrame(rows, WARNINGS)


def workbook_warnings(sheets: DataFrame, columns: DataFrame, body: DataFrame, types: DataFrame) -> DataFrame:
    """Warnings of a workbook fleet, from the frames the import is built of."""

    def rows(df: DataFrame, code: str, scope: str, column: Column, detail: Column, count: Column) -> DataFrame:
        nothing = F.lit(None).cast("string")
        sheet = nothing if scope == "workbook" else F.col("sheet")
        return df.select(
            F.lit(code).alias("code"),
            F.lit(scope).alias("scope"),
            F.col("path"),
            sheet.alias("sheet"),
            column.alias("column_id"),
            detail.alias("detail"),
            count.cast("bigint").alias("cell_count"),
        )

    none = F.lit(None).cast("string")
    books = sheets.select("path").distinct()
    formulas = body.groupBy(*SHEET).agg(
        F.sum(F.size(F.filter("cells", lambda c: c["had_formula"]))).alias("formulas"),
        F.sum(F.size(F.filter("cells", lambda c: c["missing_value"]))).alias("missing"),
    )
    named = F.col("column_id"), F.col("display_name")
    parts = [
        rows(books, "xlsxValueOnlyImport", "workbook", none, none, none),
        rows(columns.filter("blank"), "blankHeaderGenerated", "column", *named, none),
        rows(columns.filter("repeat > 1"), "duplicateHeaderNormalized", "column", *named, none),
        rows(types.filter("logical_type = 'mixed'"), "mixedTypeColumn", "column", F.col("column_id"), none, none),
        rows(formulas.filter("formulas > 0"), "formulaImportedAsValue", "table", none, none, F.col("formulas")),
        rows(formulas.filter("missing > 0"), "formulaValueUnavailable", "table", none, none, F.col("missing")),
        rows(
            sheets.filter("auto_detected and header_row > 0"),
            "xlsxHeaderRowAutoDetected",
            "table",
            none,
            (F.col("header_row") + 1).cast("string"),
            none,
        ),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
