"""CSV files and workbooks written from the tables and read back."""

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F

from registry import xlsx_bytes
from registry.common import MESSY_CUSTOMERS, messy_customers, query, scan, table
from registry.xlsx_bytes import DATETIME_STYLE, Formula, Serial, workbook_bytes
from tablewash import Table
from tablewash.functions.cells import number_text
from tablewash.operators import sort_rows
from tablewash.session import scratch_path
from tablewash.sinks import write_csv, write_parquet
from tablewash.sources import (
    body_rows,
    choose_header_rows,
    csv_warnings,
    import_csv,
    parsed_workbooks,
    read_csv,
    read_file,
    sheet_columns,
    sheet_table,
    sheet_types,
    workbook_rows,
    workbook_tables,
    workbook_warnings,
)
from tablewash.session import stored

cloudpickle.register_pickle_by_value(xlsx_bytes)


def _csv(spark, source: Table, **settings) -> str:
    path = scratch_path(spark, "csv")
    write_csv(source, path, **settings)
    return path


@query(
    f"""with m as ({MESSY_CUSTOMERS})
    select c_custkey::double as col_c_custkey, coalesce(email, '') as col_email, coalesce(email_2, '') as col_email_2,
      coalesce(status, '') as col_status, case when balance <> 'n/a' then balance::double end as number,
      case when balance is null or balance = 'n/a' then coalesce(balance, '') end as text, vip as col_vip,
      full_name as col_full_name, nation::double as col_nation from m"""
)
def csv_roundtrip(spark, sf_dir):
    """Nulls come back as empty text, and a column of numbers and texts as both."""
    return _apart(read_csv(spark, _csv(spark, messy_customers(spark, sf_dir))).to_df())


def _apart(df):
    """The mixed balance as its two kinds."""
    number, text = F.col("col_balance.n").alias("number"), F.col("col_balance.s").alias("text")
    return df.select("*", number, text).drop("col_balance")


@query(
    f"""with m as ({MESSY_CUSTOMERS})
    select c_custkey::double as col_c_custkey, email as col_email, email_2 as col_email_2, status as col_status, vip as col_vip,
      case when balance <> 'n/a' then balance::double end as number, case when balance = 'n/a' then balance end as text,
      full_name as col_full_name, nation::double as col_nation from m"""
)
def csv_roundtrip_keeping_nulls(spark, sf_dir):
    return _apart(read_csv(spark, _csv(spark, messy_customers(spark, sf_dir), keep_nulls=True)).to_df())


@query(
    """select doc_id::double as col_doc_id, lang as col_lang, source as col_source, n_chars::double as col_n_chars,
      md5(text) as text_md5, length(text)::bigint as text_length from documents"""
)
def csv_roundtrip_of_texts(spark, sf_dir):
    """Whole texts with line breaks, quotes and commas."""
    df = read_csv(spark, _csv(spark, table(spark, sf_dir, "documents", "doc_id"))).to_df()
    return df.select("col_doc_id", "col_lang", "col_source", "col_n_chars", F.md5("col_text").alias("text_md5"), F.length("col_text").cast("bigint").alias("text_length"))


def _lines(spark, df, header: str) -> str:
    """A folder of text files of the lines in ``df``, each file under the header."""
    path = scratch_path(spark, "lines")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    first = F.array(F.lit(header), F.col("line"))
    written = df.select(F.explode(F.when(place == 0, first).otherwise(F.array("line"))).alias("value"))
    written.write.text(path)
    return path


@query(
    """select case when p_partkey % 9 > 0 then p_partkey::double end as col_id,
      case when p_partkey % 9 > 0 and p_partkey % 5 > 0 and p_partkey % 4 > 0 then p_retailprice end as col_price,
      case when p_partkey % 9 > 0 and p_partkey % 5 > 0 then p_size > 25 end as col_flag,
      case when p_partkey % 9 > 0 and p_partkey % 5 > 0 then case when p_partkey % 7 = 0 then '007' else p_name end end as col_column,
      case when p_partkey % 9 > 0 and p_partkey % 5 > 0 and p_partkey % 7 = 0 then 'extra, quoted' end as col_column_2 from part"""
)
def csv_ragged_lines(spark, sf_dir):
    """Blank lines, short rows and rows wider than the header."""
    key = F.col("p_partkey")
    price = F.when(key % 4 > 0, F.col("p_retailprice").cast("string")).otherwise(F.lit(""))
    flag = F.when(F.col("p_size") > 25, F.lit("TRUE")).otherwise(F.lit("false"))
    line = (
        F.when(key % 9 == 0, F.lit(""))
        .when(key % 5 == 0, key.cast("string"))
        .when(key % 7 == 0, F.concat_ws(",", key, price, flag, F.lit("007"), F.lit('"extra, quoted"')))
        .otherwise(F.concat_ws(",", key, price, flag, F.col("p_name")))
    )
    path = _lines(spark, scan(spark, sf_dir, "part").select(line.alias("line")), "id,price,flag")
    return read_csv(spark, path).to_df()


# The kind of each cell of the file by the columns it is made of, and a column's type from its kinds.
UNTIDY_KINDS = """with k as (select
    unnest(['col_id', 'col_mail', 'col_mail_2', 'col_column', 'col_seen_at', 'col_column_2', 'col_ok']) as column_id,
    unnest(['id', 'Mail', 'Mail (2)', 'Column', 'seen at', 'Column (2)', 'ok']) as display_name,
    unnest([case when regexp_matches(event_id::varchar, '^-?(0|[1-9][0-9]*)$') then 'number' else 'string' end,
      case when event_type = '' then null when lower(event_type) in ('true', 'false') then 'boolean'
        when try_cast(event_type as double) is not null then 'number' else 'string' end,
      case event_id % 3 when 0 then 'boolean' when 1 then 'number' else 'string' end,
      case when ts is not null then 'date' end, case when ts is not null then 'datetime' end, null, 'boolean']) as kind
    from events),
    t as (select column_id, display_name, case when count(kind) = 0 then 'unknown' when count(distinct kind) = 1 then max(kind) else 'mixed' end as logical_type
      from k group by all)"""


@query(f"{UNTIDY_KINDS} select column_id, display_name, logical_type from t")
def csv_column_types(spark, sf_dir):
    imported = _untidy_import(spark, sf_dir)
    rows = [(c.id, c.name, c.type) for c in imported.table.columns]
    return spark.createDataFrame(rows, "column_id string, display_name string, logical_type string")


@query(
    f"""{UNTIDY_KINDS} select 'mixedTypeColumn' as code, column_id, display_name as detail from t where logical_type = 'mixed'
    union all select 'duplicateHeaderNormalized', column_id, display_name from t where display_name like '% (%)'
    union all select 'blankHeaderGenerated', column_id, display_name from t where display_name like 'Column%'"""
)
def csv_import_warnings(spark, sf_dir):
    return csv_warnings(spark, _untidy_import(spark, sf_dir)).select("code", "column_id", "detail")


def _untidy_import(spark, sf_dir):
    key, ts = F.col("event_id"), F.col("ts")
    mixed = F.when(key % 3 == 0, F.lit("true")).when(key % 3 == 1, key.cast("string")).otherwise(F.col("event_type"))
    line = F.concat_ws(
        ",",
        key,
        F.col("event_type"),
        mixed,
        F.date_format(ts, "yyyy-MM-dd"),
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.lit(""),
        F.when(key % 2 == 0, F.lit("True")).otherwise(F.lit("FALSE")),
    )
    path = _lines(spark, scan(spark, sf_dir, "events").select(line.alias("line")), "id,Mail, mail ,,seen  at,  ,ok")
    return import_csv(spark, path)


@query("select c_custkey::double as col_key, c_name as col_name, c_acctbal as col_balance from customer")
def csv_columns_in_any_order(spark, sf_dir):
    """Files that name the same columns in different orders."""
    customers = scan(spark, sf_dir, "customer")
    orders = (("key,name,balance", ["c_custkey", "c_name", "c_acctbal"]), ("balance,key,name", ["c_acctbal", "c_custkey", "c_name"]))
    paths = []
    for k, (header, names) in enumerate(orders):
        line = F.concat_ws(",", *[F.col(n).cast("decimal(20,2)") if n == "c_acctbal" else F.col(n) for n in names])
        paths.append(_lines(spark, customers.filter(F.col("c_custkey") % 2 == k).select(line.alias("line")), header))
    return read_csv(spark, paths).to_df()


@query("select s_suppkey::double as col_s_suppkey, s_name as col_s_name, s_nationkey::double as col_s_nationkey, s_acctbal as col_s_acctbal from supplier")
def file_by_suffix(spark, sf_dir):
    """A table read by the suffix of its name."""
    path = f"{scratch_path(spark, 'files')}/Suppliers.CSV"
    write_csv(table(spark, sf_dir, "supplier", "s_suppkey"), path)
    return read_file(spark, path).to_df()


@query("select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer")
def parquet_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "parquet")
    write_parquet(sort_rows([("c_acctbal", "desc")])(table(spark, sf_dir, "customer", "c_custkey")), path, ordered=True)
    return Table.read_parquet(spark, path).to_df()


# --- workbooks --------------------------------------------------------------------

ROWS_PER_BOOK = 400


def _books(spark, sf_dir):
    """Workbooks of customers, one per nation and range of 400 keys, so that no
    group grows with the data. Two sheets; the first starts with machine metadata."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["c_custkey", "c_name", "c_acctbal", "c_mktsegment"])
        book = f"n{rows['c_nationkey'].iloc[0]}-{rows['book'].iloc[0]}.xlsx"
        people = [
            ['{"UniqueId":"key"}', '{"UniqueId":"name"}', '{"UniqueId":"balance"}', '{"UniqueId":"double"}', '{"UniqueId":"none"}', '{"UniqueId":"day"}'],
            ["Key\nnumber", "Customer  name\nstring", "Balance", "Double", "None", "Day"],
        ]
        for key, name, balance in zip(rows["c_custkey"].tolist(), rows["c_name"].tolist(), rows["c_acctbal"].tolist()):
            people.append([key, name, balance, Formula(f"C{key}*2", balance * 2), Formula("1/0"), Serial(45292 + key % 365)])
        flags = [["Key", "Flag", "flag", None, "At"]]
        for key, segment in zip(rows["c_custkey"].tolist(), rows["c_mktsegment"].tolist()):
            flags.append([key, segment if key % 2 else key % 3 == 0, None, "x", Serial(45292.25 + key % 365, DATETIME_STYLE)])
            if key % 7 == 0:
                flags.append([])
        content = workbook_bytes({"People": people, "Flags": flags})
        return pd.DataFrame({"path": [book], "content": [content]})

    customers = scan(spark, sf_dir, "customer").withColumn("book", F.floor(F.col("c_custkey") / ROWS_PER_BOOK))
    # A fixed number of partitions, so that the small groups are not put into one task.
    spread = customers.repartition(spark.sparkContext.defaultParallelism, "c_nationkey", "book")
    return spread.groupBy("c_nationkey", "book").applyInPandas(build, "path string, content binary")


BOOKS = f"select *, 'n' || c_nationkey || '-' || (c_custkey // {ROWS_PER_BOOK}) || '.xlsx' as path from customer"


@query(
    f"""with b as ({BOOKS})
    select path, c_custkey::double as key, c_name as name, c_acctbal as balance, c_acctbal * 2 as double_balance, null::varchar as none,
      strftime(date '2024-01-01' + (c_custkey % 365)::int, '%Y-%m-%d') as day from b"""
)
def workbook_fleet_table(spark, sf_dir):
    people = sheet_table(parsed_workbooks(_books(spark, sf_dir)), "People")
    found = ["col_key", "col_customer_name", "col_balance", "col_double", "col_none", "col_day"]
    names = ["key", "name", "balance", "double_balance", "none", "day"]
    return people.df.select(F.col("__path").alias("path"), *[F.col(c).alias(n) for c, n in zip(found, names)])


@query(
    f"""with b as ({BOOKS}),
    f as (select *, count(*) over (partition by path) + count_if(c_custkey % 7 = 0) over (partition by path)
      - (case when max(c_custkey) over (partition by path) % 7 = 0 then 1 else 0 end) as n from b)
    select path, 'People' as sheet, 6 as width, 2 + count(*)::int as height, 1 as header_row from b group by path
    union all select path, 'Flags', 5, 1 + max(n)::int, 0 from f group by path"""
)
def workbook_header_detection(spark, sf_dir):
    sheets = choose_header_rows(workbook_rows(_books(spark, sf_dir)))
    return sheets.select("path", "sheet", "width", "height", "header_row")


@query(
    f"""with b as ({BOOKS}), k as (select path, count(*) as n, count_if(c_custkey % 2 = 1) as odd from b group by path)
    select path, 'xlsxValueOnlyImport' as code, null::varchar as sheet, null::varchar as column_id, null::bigint as cell_count from k
    union all select path, 'formulaImportedAsValue', 'People', null, 2 * n from k
    union all select path, 'formulaValueUnavailable', 'People', null, n from k
    union all select path, 'xlsxHeaderRowAutoDetected', 'People', null, null from k
    union all select path, 'duplicateHeaderNormalized', 'Flags', 'col_flag_2', null from k
    union all select path, 'blankHeaderGenerated', 'Flags', 'col_column', null from k
    union all select path, 'mixedTypeColumn', 'Flags', 'col_flag', null from k where odd > 0 and odd < n"""
)
def workbook_import_warnings(spark, sf_dir):
    rows = parsed_workbooks(_books(spark, sf_dir))
    sheets = stored(choose_header_rows(rows))
    columns = stored(sheet_columns(sheets))
    body = body_rows(rows, sheets)
    found = workbook_warnings(sheets, columns, body, sheet_types(body, columns))
    return found.select("path", "code", "sheet", "column_id", "cell_count")


@query(
    f"""with b as ({BOOKS}), t as (
    select path, 'Flags' as sheet, 'col_key' as column_id, 'number' as logical_type from b group by path
    union all select path, 'Flags', 'col_flag', case when count_if(c_custkey % 2 = 1) = count(*) then 'string'
      when count_if(c_custkey % 2 = 1) = 0 then 'boolean' else 'mixed' end from b group by path
    union all select path, 'Flags', 'col_flag_2', 'unknown' from b group by path
    union all select path, 'Flags', 'col_column', 'string' from b group by path
    union all select path, 'Flags', 'col_at', 'datetime' from b group by path
    union all select path, 'People', unnest(['col_key', 'col_customer_name', 'col_balance', 'col_double', 'col_none', 'col_day']),
      unnest(['number', 'string', 'number', 'number', 'unknown', 'date']) from b group by path)
    select * from t"""
)
def workbook_column_types(spark, sf_dir):
    rows = parsed_workbooks(_books(spark, sf_dir))
    sheets = stored(choose_header_rows(rows))
    return sheet_types(body_rows(rows, sheets), sheet_columns(sheets)).select("path", "sheet", "column_id", "logical_type")


@query(
    f"""with b as ({BOOKS}), f as (select *, row_number() over w as n, count(*) over (partition by path) as total,
        coalesce(sum((c_custkey % 7 = 0)::int) over (partition by path order by c_custkey, c_name, c_acctbal, c_mktsegment rows between unbounded preceding and 1 preceding), 0) as blanks
      from b window w as (partition by path order by c_custkey, c_name, c_acctbal, c_mktsegment)),
    flags as (select path, (n + blanks)::int as row_number, c_custkey::double as key, case when c_custkey % 2 = 1 then c_mktsegment end as flag_text,
        case when c_custkey % 2 = 0 then c_custkey % 3 = 0 end as flag_value, 'x' as mark, strftime(date '2024-01-01' + (c_custkey % 365)::int, '%Y-%m-%dT06:00:00') as at_
      from f union all
      select path, (n + blanks + 1)::int, null, null, null, null, null from f where c_custkey % 7 = 0 and n < total)
    select 'Flags' as sheet, * from flags
    union all select 'People', path, n::int, c_custkey, c_name, null, case when c_acctbal = 0 then '0' else regexp_replace(c_acctbal::varchar, '\\.0$', '') end, strftime(date '2024-01-01' + (c_custkey % 365)::int, '%Y-%m-%d') from f"""
)
def workbook_all_sheets(spark, sf_dir):
    """All sheets of the workbooks from one parse, blank rows inside a sheet included. A
    balance is its number's text, in which zero has no sign."""
    found = workbook_tables(_books(spark, sf_dir), {"People": 1})
    book = F.col("__path").alias("path")
    none = F.lit(None).cast("string")
    flag = F.col("col_flag")
    flags = found["Flags"].df.select(
        F.lit("Flags").alias("sheet"), book, F.col("__number").alias("row_number"), F.col("col_key").alias("key"), flag["s"].alias("flag_text"),
        flag["b"].alias("flag_value"), F.col("col_column").alias("mark"), F.col("col_at").alias("at_"),
    )
    people = found["People"].df.select(
        F.lit("People"), book, "__number", "col_key", "col_customer_name", none.cast("boolean"), number_text(F.col("col_balance")), "col_day"
    )
    return flags.union(people)
