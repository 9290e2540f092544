"""Filters, deduplication, order and previews."""

from pyspark.sql import functions as F

from registry.common import MESSY_ORDERS, messy_orders, query, scan, sql_trim, table
from tablewash import Table
from tablewash import functions as fx
from tablewash.operators import Patch, deduplicate_rows, derive_column, drop_columns, filter_rows, scoped_rule, sort_rows
from tablewash.plans import apply_steps
from tablewash.reports import dense_positions


@query(
    """select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority from orders
    where o_totalprice > 100000 and o_orderstatus = 'F' and starts_with(o_orderpriority, '1')""",
)
def filter_keep(spark, sf_dir):
    step = filter_rows(
        "keep",
        lambda r: fx.and_(
            fx.greater_than(r["o_totalprice"], 100000),
            fx.equals(r["o_orderstatus"], "F"),
            fx.starts_with(r["o_orderpriority"], "1"),
        ),
    )
    return drop_columns(["o_orderdate"])(step(table(spark, sf_dir, "orders", "o_orderkey"))).to_df()


@query(
    f"""with m as ({MESSY_ORDERS}) select * from m
    where not coalesce(price > 200000 or starts_with(priority, '1'), false)"""
)
def filter_drop_null_safe(spark, sf_dir):
    step = filter_rows(
        "drop", lambda r: fx.or_(fx.greater_than(r["price"], 200000), fx.starts_with(r["priority"], "1"))
    )
    return step(messy_orders(spark, sf_dir)).to_df()


@query(f"with m as ({MESSY_ORDERS}) select * from m where priority is null or {sql_trim('priority')} = '' or price is null")
def filter_empty_cells(spark, sf_dir):
    step = filter_rows("keep", lambda r: fx.or_(fx.is_empty(r["priority"]), fx.is_empty(r["price"])))
    return step(messy_orders(spark, sf_dir)).to_df()


@query("select doc_id, lang, source from (select *, row_number() over (partition by text order by doc_id) as n from documents) where n = 1")
def dedupe_keep_first(spark, sf_dir):
    return deduplicate_rows(["text"])(table(spark, sf_dir, "documents", "doc_id")).df.select("doc_id", "lang", "source")


@query(
    """select event_id, user_id, event_type, value from (
      select *, row_number() over (partition by user_id, event_type order by value desc nulls last, event_id) as n from events)
    where n = 1"""
)
def dedupe_after_sort(spark, sf_dir):
    return apply_steps(
        table(spark, sf_dir, "events", "event_id"),
        [sort_rows([("value", "desc")]), deduplicate_rows(["user_id", "event_type"])],
    ).df.select("event_id", "user_id", "event_type", "value")


@query(
    f"""with m as ({MESSY_ORDERS})
    select o_orderkey, o_custkey, priority from (
      select *, row_number() over (partition by o_orderstatus, priority order by o_orderkey) as n from m) where n = 1"""
)
def dedupe_null_and_empty_keys(spark, sf_dir):
    return deduplicate_rows(["o_orderstatus", "priority"])(messy_orders(spark, sf_dir)).df.select(
        "o_orderkey", "o_custkey", "priority"
    )


@query(
    f"""with m as ({MESSY_ORDERS})
    select o_orderkey, priority, price from m order by price desc nulls last, priority asc nulls last, o_orderkey limit 50"""
)
def sort_preview(spark, sf_dir):
    ordered = sort_rows([("price", "desc"), ("priority", "asc")])(messy_orders(spark, sf_dir))
    return ordered.preview().select("o_orderkey", "priority", "price")


@query(
    f"""with m as ({MESSY_ORDERS})
    select o_orderkey, row_number() over (order by o_orderstatus desc nulls last, priority asc nulls last, o_orderkey) - 1
      as position from m"""
)
def stable_sort_positions(spark, sf_dir):
    """Two sorts in a row: the second one's ties keep the order of the first,
    although the first key is rewritten in between."""
    ordered = apply_steps(
        messy_orders(spark, sf_dir),
        [
            sort_rows([("priority", "asc")]),
            scoped_rule(["priority"], default=Patch("gone")),
            sort_rows([("o_orderstatus", "desc")]),
        ],
    )
    return dense_positions(ordered)


@query(
    """select p_partkey, row_number() over (order by p_size % 2 = 0 asc, p_brand desc, p_partkey) - 1 as position from part"""
)
def sort_booleans_and_text(spark, sf_dir):
    parts = apply_steps(
        table(spark, sf_dir, "part", "p_partkey"),
        [
            derive_column("even", "even", lambda r: fx.equals(fx.modulo(r["p_size"], 2), 0)),
            sort_rows([("even", "asc"), ("p_brand", "desc")]),
        ],
    )
    return dense_positions(parts)


@query(
    """select o_orderkey, o_orderdate::varchar as day, row_number() over (order by o_orderdate desc, o_orderkey) - 1 as position
    from orders"""
)
def sort_dates(spark, sf_dir):
    df = scan(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    positions = dense_positions(sort_rows([("o_orderdate", "desc")])(Table.of(df, "o_orderkey")))
    days = df.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("day"))
    return positions.join(days, "o_orderkey").select("o_orderkey", "day", "position")
