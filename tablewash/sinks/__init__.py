from tablewash.sinks.files import cell_formats, csv_lines, write_csv, write_formats, write_parquet
