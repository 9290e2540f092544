"""Registration of queries and the helpers they share."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewash import Table, prepare_session
from tablewash.functions.cells import WHITESPACE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# Whitespace for the SQL side: as characters for trim, and as an RE2 class.
SQL_SPACES = "".join(WHITESPACE)
SQL_SPACE_CLASS = r"[\t\n\x0b\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def query(sql: str | None = None, name: str | None = None):
    """Register a query, with the SQL that gives the same result if there is one."""

    def add(build: Callable[[SparkSession, str], DataFrame]):
        key = name or build.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(prepare_session(spark), sf_dir)

        QUERIES[key] = run
        if sql is not None:
            SQL[key] = sql
        return build

    return add


def scan(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table(spark: SparkSession, sf_dir: str, name: str, key: str | list[str]) -> Table:
    return Table.of(scan(spark, sf_dir, name), key)


def named(table: Table) -> DataFrame:
    """The visible columns under their display names."""
    return table.df.select(*[F.col(c.id).alias(c.name) for c in table.columns])


def messy_orders(spark: SparkSession, sf_dir: str) -> Table:
    """Orders whose priority is sometimes null, empty, blank or padded, and
    whose price is sometimes null."""
    key, priority = F.col("o_orderkey"), F.col("o_orderpriority")
    messy = (
        F.when(key % 7 == 0, F.lit(None).cast("string"))
        .when(key % 11 == 0, F.lit(""))
        .when(key % 13 == 0, F.lit(" \t "))
        .when(key % 3 == 0, F.concat(F.lit("  "), priority, F.lit("\n")))
        .otherwise(priority)
    )
    df = scan(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        messy.alias("priority"),
        F.when(key % 5 != 0, F.col("o_totalprice")).alias("price"),
    )
    return Table.of(df, "o_orderkey")


MESSY_ORDERS = """
  select o_orderkey, o_custkey, o_orderstatus,
    case when o_orderkey % 7 = 0 then null
         when o_orderkey % 11 = 0 then ''
         when o_orderkey % 13 = 0 then ' ' || chr(9) || ' '
         when o_orderkey % 3 = 0 then '  ' || o_orderpriority || chr(10)
         else o_orderpriority end as priority,
    case when o_orderkey % 5 <> 0 then o_totalprice end as price
  from orders"""


def sql_trim(x: str) -> str:
    return f"trim({x}, '{SQL_SPACES}')"


def messy_customers(spark: SparkSession, sf_dir: str) -> Table:
    """Customers with two mail columns, a status and a balance, all of them untidy."""
    key, name = F.col("c_custkey"), F.col("c_name")
    mail = F.concat(F.replace(name, F.lit("#"), F.lit(".")), F.lit("@Mail.Test"))
    df = scan(spark, sf_dir, "customer").select(
        "c_custkey",
        F.when(key % 4 == 1, F.lit(None).cast("string"))
        .when(key % 4 == 2, F.lit(""))
        .when(key % 9 == 0, F.lit("Customer.shared@Mail.Test"))
        .otherwise(F.concat(F.lit(" "), mail, F.lit("  ")))
        .alias("email"),
        F.when(key % 8 == 1, F.concat(F.lit("alt."), mail)).when(key % 8 == 2, F.lit("   ")).alias("email_2"),
        F.when(key % 6 == 0, F.lit(None).cast("string"))
        .when(key % 6 == 1, F.lit("  "))
        .when(key % 6 == 2, F.lit(" Active"))
        .when(key % 6 == 3, F.lit("INACTIVE "))
        .otherwise(F.lower("c_mktsegment"))
        .alias("status"),
        F.when(key % 10 == 3, F.lit("n/a")).when(key % 10 != 7, F.col("c_acctbal").cast("string")).alias("balance"),
        (key % 5 == 0).alias("vip"),
        name.alias("full_name"),
        F.col("c_nationkey").alias("nation"),
    )
    return Table.of(df, "c_custkey")


MESSY_CUSTOMERS = """
  select c_custkey,
    case when c_custkey % 4 = 1 then null when c_custkey % 4 = 2 then ''
         when c_custkey % 9 = 0 then 'Customer.shared@Mail.Test'
         else ' ' || replace(c_name, '#', '.') || '@Mail.Test  ' end as email,
    case when c_custkey % 8 = 1 then 'alt.' || replace(c_name, '#', '.') || '@Mail.Test'
         when c_custkey % 8 = 2 then '   ' end as email_2,
    case c_custkey % 6 when 0 then null when 1 then '  ' when 2 then ' Active' when 3 then 'INACTIVE '
         else lower(c_mktsegment) end as status,
    case when c_custkey % 10 = 3 then 'n/a' when c_custkey % 10 <> 7 then c_acctbal::varchar end as balance,
    c_custkey % 5 = 0 as vip, c_name as full_name, c_nationkey as nation
  from customer"""
