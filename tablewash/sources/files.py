"""Choosing a source by the file name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewash.errors import StepError
from tablewash.sources.csv import read_csv
from tablewash.sources.workbooks import parsed_workbooks, read_workbook_files, sheet_table
from tablewash.table import Table


def read_file(spark: SparkSession, path: str, sheet: str | None = None, header_rows: dict[str, int] | None = None) -> Table:
    """A ``.csv`` file, or one sheet (by default the first) of ``.xlsx`` files.

    ``path`` may be a folder or pattern of workbooks with that suffix. Without ``sheet``, all of
    them must begin with a sheet of the same name. ``header_rows`` chooses a sheet's
    header row, counting from zero, by the sheet's name.
    """
    if _format(path) == "csv":
        return read_csv(spark, path)
    rows = parsed_workbooks(read_workbook_files(spark, path))
    if sheet is None:
        sheet = _sheet_names(rows, first=True)[0]
    return sheet_table(rows, sheet, header_rows)


def read_workbook(spark: SparkSession, path: str, header_rows: dict[str, int] | None = None) -> dict[str, Table]:
    """Every sheet that holds cells, by name in the workbook's order, from one parse.

    A ``.csv`` file is one sheet without a name. Workbooks of a folder or pattern must
    have the same sheets in the same order; their rows are one table for each.
    """
    if _format(path) == "csv":
        return {"": read_csv(spark, path)}
    return workbook_tables(read_workbook_files(spark, path), header_rows)


def workbook_tables(files: DataFrame, header_rows: dict[str, int] | None = None) -> dict[str, Table]:
    """Like ``read_workbook``, from ``(path, content)`` of workbook files."""
    rows = parsed_workbooks(files)
    return {name: sheet_table(rows, name, header_rows) for name in _sheet_names(rows)}


def _format(path: str) -> str:
    suffix = path.lower().rsplit(".", 1)[-1]
    if suffix not in ("csv", "xlsx"):
        raise StepError("unsupportedFormat", f"{path!r} is neither a .csv nor a .xlsx file")
    return suffix


def _sheet_names(rows: DataFrame, first: bool = False) -> list[str]:
    """The names of the sheets, or of the first one, which all files must share."""
    books = rows.groupBy("path").agg(F.array_sort(F.collect_set(F.struct("sheet_index", "sheet"))).alias("sheets"))
    names = F.transform("sheets", lambda s: s["sheet"])
    found = books.select((F.slice(names, 1, 1) if first else names).alias("names")).distinct().limit(2).collect()
    if not found:
        raise StepError("emptyWorkbook", "the workbooks hold no cells")
    if len(found) > 1:
        raise StepError("sheetMismatch", f"the workbooks have different sheets: {found[0]['names']} and {found[1]['names']}")
    return list(found[0]["names"])
