from tablewash.sources.csv import CsvImport, import_csv, read_csv
from tablewash.sources.files import read_file, read_workbook, workbook_tables
from tablewash.sources.headers import normalize_headers
from tablewash.sources.warnings import csv_warnings, workbook_warnings
from tablewash.sources.workbooks import (
    body_rows,
    choose_header_rows,
    parsed_workbooks,
    read_workbook_files,
    sheet_columns,
    sheet_table,
    sheet_types,
    workbook_rows,
)
