"""Arithmetic, number text and casts."""

from pyspark.sql import functions as F

from registry.common import query, scan, sql_trim, table
from tablewash import Table
from tablewash import functions as fx
from tablewash.operators import derive_column
from tablewash.plans import apply_steps

LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _lines(spark, sf_dir):
    """Line items with a discount that is sometimes null and a signed quantity."""
    key = F.col("l_orderkey")
    df = scan(spark, sf_dir, "lineitem").select(
        *LINE,
        F.when(key % 3 == 0, -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("qty"),
        F.when(key % 5 != 0, F.col("l_discount")).alias("disc"),
        F.col("l_extendedprice").alias("price"),
    )
    return Table.of(df, LINE)


LINES = """select l_orderkey, l_linenumber, l_partkey, l_suppkey,
  case when l_orderkey % 3 = 0 then -l_quantity else l_quantity end as qty,
  case when l_orderkey % 5 <> 0 then l_discount end as disc, l_extendedprice as price from lineitem"""


@query(
    f"""with m as ({LINES})
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, qty + price as total, price - disc as less, qty * disc as times,
      case when disc <> 0 then price / disc end as per, qty % 7 as rest,
      case when disc <> 0 then price % disc end as rest_of_zero from m"""
)
def math_null_safe(spark, sf_dir):
    return apply_steps(
        _lines(spark, sf_dir),
        [
            derive_column("total", "total", lambda r: fx.add(r["qty"], r["price"])),
            derive_column("less", "less", lambda r: fx.subtract(r["price"], r["disc"])),
            derive_column("times", "times", lambda r: fx.multiply(r["qty"], r["disc"])),
            derive_column("per", "per", lambda r: fx.divide(r["price"], r["disc"])),
            derive_column("rest", "rest", lambda r: fx.modulo(r["qty"], 7)),
            derive_column("rest_of_zero", "rest_of_zero", lambda r: fx.modulo(r["price"], r["disc"])),
        ],
    ).df.select(*LINE, "total", "less", "times", "per", "rest", "rest_of_zero")


@query(
    f"""with m as ({LINES}), h as (select *, qty / 2 as half from m)
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, floor(half + 0.5)::double as rounded, floor(half)::double as low,
      ceil(half)::double as high, abs(half)::double as size, floor(disc)::double as none from h"""
)
def rounding(spark, sf_dir):
    return apply_steps(
        _lines(spark, sf_dir),
        [
            derive_column("half", "half", lambda r: fx.divide(r["qty"], 2)),
            derive_column("rounded", "rounded", lambda r: fx.round(r["half"])),
            derive_column("low", "low", lambda r: fx.floor(r["half"])),
            derive_column("high", "high", lambda r: fx.ceil(r["half"])),
            derive_column("size", "size", lambda r: fx.abs(r["half"])),
            derive_column("none", "none", lambda r: fx.floor(r["disc"])),
        ],
    ).df.select(*LINE, "rounded", "low", "high", "size", "none")


@query(
    f"""with m as ({LINES})
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, regexp_replace(price::varchar, '\\.0$', '') as price_text,
      regexp_replace(qty::varchar, '\\.0$', '') as qty_text, regexp_replace(disc::varchar, '\\.0$', '') as disc_text,
      l_orderkey::varchar || ':' || regexp_replace(qty::varchar, '\\.0$', '') as joined from m"""
)
def number_text(spark, sf_dir):
    return apply_steps(
        _lines(spark, sf_dir),
        [
            derive_column("price_text", "price_text", lambda r: fx.to_string(r["price"])),
            derive_column("qty_text", "qty_text", lambda r: fx.to_string(r["qty"])),
            derive_column("disc_text", "disc_text", lambda r: fx.to_string(r["disc"])),
            derive_column("joined", "joined", lambda r: fx.concat(r["l_orderkey"], ":", r["qty"])),
        ],
    ).df.select(*LINE, "price_text", "qty_text", "disc_text", "joined")


def _written_numbers(spark, sf_dir):
    """Part prices written in ways that can and cannot be read as numbers."""
    key, price = F.col("p_partkey"), F.col("p_retailprice").cast("string")
    wrote = (
        F.when(key % 10 == 0, F.concat(F.lit("  "), price, F.lit("\u00a0")))
        .when(key % 10 == 1, F.concat(price, F.lit("d")))
        .when(key % 10 == 2, F.concat(F.lit("+"), price))
        .when(key % 10 == 3, F.concat(key.cast("string"), F.lit("e2")))
        .when(key % 10 == 4, F.concat(F.lit("0x"), F.lower(F.hex(key))))
        .when(key % 10 == 5, F.lit("Infinity"))
        .when(key % 10 == 6, F.lit("1e999"))
        .when(key % 10 == 7, F.concat(F.lit("."), key.cast("string")))
        .when(key % 10 == 8, F.lit(""))
        .otherwise(price)
    )
    df = scan(spark, sf_dir, "part").select("p_partkey", wrote.alias("wrote"), (F.col("p_size") > 25).alias("big"))
    return Table.of(df, "p_partkey")


@query(
    f"""with m as (select p_partkey, p_size > 25 as big, case p_partkey % 10
      when 0 then '  ' || p_retailprice::varchar || chr(160) when 1 then p_retailprice::varchar || 'd'
      when 2 then '+' || p_retailprice::varchar when 3 then p_partkey::varchar || 'e2'
      when 4 then '0x' || lower(printf('%x', p_partkey)) when 5 then 'Infinity' when 6 then '1e999'
      when 7 then '.' || p_partkey::varchar when 8 then '' else p_retailprice::varchar end as wrote from part),
    t as (select *, {sql_trim("wrote")} as w from m)
    select p_partkey, case when p_partkey % 10 = 4 then p_partkey::double
      when regexp_matches(w, '^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$') and w <> '1e999' then try_cast(ltrim(w, '+') as double) end as number,
      big::int::double as big_number from t"""
)
def cast_to_number(spark, sf_dir):
    return apply_steps(
        _written_numbers(spark, sf_dir),
        [
            derive_column("number", "number", lambda r: fx.to_number(r["wrote"])),
            derive_column("big_number", "big_number", lambda r: fx.to_number(r["big"])),
        ],
    ).df.select("p_partkey", "number", "big_number")


@query(
    """with m as (select event_id, case event_id % 9 when 0 then ' TRUE ' when 1 then 'No' when 2 then '1' when 3 then '0'
      when 4 then 'y' when 5 then '' when 6 then null when 7 then 'yes' else event_type end as flag,
      case when event_id % 4 < 3 then (event_id % 4)::double end as n from events)
    select event_id, case when lower(trim(flag)) in ('true', '1', 'yes') then true
        when lower(trim(flag)) in ('false', '0', 'no') then false end as flag_boolean,
      case n when 1 then true when 0 then false end as n_boolean,
      case when lower(trim(flag)) in ('true', '1', 'yes') then 'true'
        when lower(trim(flag)) in ('false', '0', 'no') then 'false' end as flag_text from m"""
)
def cast_to_boolean(spark, sf_dir):
    key = F.col("event_id")
    words = {0: " TRUE ", 1: "No", 2: "1", 3: "0", 4: "y", 5: "", 6: None, 7: "yes"}
    flag = F.col("event_type")
    for rest, word in words.items():
        flag = F.when(key % 9 == rest, F.lit(word).cast("string")).otherwise(flag)
    df = scan(spark, sf_dir, "events").select(
        "event_id", flag.alias("flag"), F.when(key % 4 < 3, (key % 4).cast("double")).alias("n")
    )
    return apply_steps(
        Table.of(df, "event_id"),
        [
            derive_column("flag_boolean", "flag_boolean", lambda r: fx.to_boolean(r["flag"])),
            derive_column("n_boolean", "n_boolean", lambda r: fx.to_boolean(r["n"])),
            derive_column("flag_text", "flag_text", lambda r: fx.to_string(r["flag_boolean"])),
        ],
    ).df.select("event_id", "flag_boolean", "n_boolean", "flag_text")


@query(r"""select event_id, try_cast(regexp_extract(props, '\d+') as double) as k,
      try_cast(regexp_extract(props, '\d+') as double) + value as k_plus_value from events""")
def cast_event_props(spark, sf_dir):
    return apply_steps(
        table(spark, sf_dir, "events", "event_id"),
        [
            derive_column("k", "k", lambda r: fx.to_number(fx.extract_regex(r["props"], r"\d+"))),
            derive_column("k_plus_value", "k_plus_value", lambda r: fx.add(r["k"], r["value"])),
        ],
    ).df.select("event_id", "k", "k_plus_value")
