"""Reports: types, missing values, rule metrics, change summaries, positions."""

from pyspark.sql import functions as F

from registry.common import MESSY_CUSTOMERS, MESSY_ORDERS, messy_customers, messy_orders, query, scan, sql_trim, table
from tablewash import Table
from tablewash import functions as fx
from tablewash.functions.cells import MIXED
from tablewash.operators import (
    Case,
    Patch,
    combine_columns,
    deduplicate_rows,
    derive_column,
    drop_columns,
    filter_rows,
    scoped_rule,
    sort_rows,
)
from tablewash.plans import apply_steps, count_steps
from tablewash.reports import change_summary, compare_rows, dense_positions, execute, infer_types, profile, run_summary
from tablewash.session import scratch_path
from tablewash.sinks import write_csv, write_parquet

ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"


def _typed_events(spark, sf_dir):
    """Events as text, number, date text, datetime text, mixed and empty columns."""
    key = F.col("event_id")
    mixed = F.struct(
        F.when(key % 2 == 0, F.lit("s")).otherwise(F.lit("n")).alias("k"),
        F.when(key % 2 == 0, F.col("event_type")).alias("s"),
        F.when(key % 2 == 1, F.col("value")).alias("n"),
        F.lit(None).cast("boolean").alias("b"),
    ).cast(MIXED)
    df = scan(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        "event_type",
        F.when(key % 3 != 0, F.col("value")).alias("value"),
        F.when(key % 5 != 0, F.date_format("ts", "yyyy-MM-dd")).alias("day"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("moment"),
        F.when(key % 100 == 0, F.lit("soon")).otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("mostly_day"),
        (key % 2 == 0).alias("even"),
        F.lit(None).cast("string").alias("nothing"),
        mixed.alias("mixed"),
        F.when(key % 4 == 0, F.lit("")).when(key % 4 == 1, F.lit("  ")).alias("gaps"),
    )
    return Table.of(df, "event_id")


def _iso_type(column: str) -> str:
    return f"""case when count({column}) = 0 then 'unknown'
        when count_if(regexp_matches({column}, '{ISO_DATE}') and try_cast({column} as date) is not null) = count({column}) then 'date'
        when count_if(regexp_matches({column}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}T') and try_cast({column} as timestamptz) is not null) = count({column})
          then 'datetime' else 'string' end"""


TYPED_EVENTS = """select event_id, ts, event_type, case when event_id % 3 <> 0 then value end as value,
    case when event_id % 5 <> 0 then strftime(ts, '%Y-%m-%d') end as day, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as moment,
    case when event_id % 100 = 0 then 'soon' else strftime(ts, '%Y-%m-%d') end as mostly_day, event_id % 2 = 0 as even,
    null::varchar as nothing, case when event_id % 2 = 0 then event_type end as mixed_s, case when event_id % 2 = 1 then value end as mixed_n,
    case when event_id % 4 = 0 then '' when event_id % 4 = 1 then '  ' end as gaps from events"""
TEXT_COLUMNS = ["event_type", "day", "moment", "mostly_day", "nothing", "gaps"]


@query(
    f"with m as ({TYPED_EVENTS}) "
    + " union all ".join(f"select '{c}' as column_id, {_iso_type(c)} as logical_type from m" for c in TEXT_COLUMNS)
    + """ union all select 'event_id', 'number' union all select 'ts', 'datetime' union all select 'even', 'boolean'
      union all select 'value', case when count(value) = 0 then 'unknown' when count_if(isfinite(value)) = count(value) then 'number' else 'mixed' end from m
      union all select 'mixed', case when count(mixed_s) > 0 and count(mixed_n) > 0 then 'mixed' else 'other' end from m"""
)
def infer_column_types(spark, sf_dir):
    return infer_types(_typed_events(spark, sf_dir))


@query(
    f"with m as ({TYPED_EVENTS}) "
    + " union all ".join(
        f"select '{c}' as column_id, count_if({c} is null) > 0 as nullable, count_if({c} is null or {c} = '') as missing_count from m"
        for c in TEXT_COLUMNS
    )
    + "".join(
        f" union all select '{c}', count_if({c} is null) > 0, count_if({c} is null) from m"
        for c in ("event_id", "ts", "value", "even")
    )
    + " union all select 'mixed', count_if(mixed_s is null and mixed_n is null) > 0, count_if(mixed_s is null and mixed_n is null or mixed_s = '') from m"
)
def profile_missing(spark, sf_dir):
    return profile(_typed_events(spark, sf_dir))


FILL_STATUS = scoped_rule(
    ["status", "email"],
    cases=[
        Case(lambda r, v: fx.is_empty(v), Patch("unknown", "#fff2cc")),
        Case(lambda r, v: fx.contains(v, "INACTIVE"), Patch(fill="#f4cccc")),
    ],
    default=Patch(lambda r, v: fx.lower(fx.trim(v))),
    where=lambda r: fx.less_than(r["nation"], 20),
)

RULE_COUNTS = f"""with m as ({MESSY_CUSTOMERS} where c_nationkey < 20),
    u as (select status as v from m union all select email from m),
    r as (select v, case when v is null or {sql_trim("v")} = '' then 'unknown' when contains(v, 'INACTIVE') then v else lower({sql_trim("v")}) end as w,
      v is null or {sql_trim("v")} = '' or contains(v, 'INACTIVE') as filled from u)
    select count(*) as matched_cell_count, count_if(v is distinct from w) as value_changed_cell_count,
      count_if(filled) as format_changed_cell_count, count_if(filled or v is distinct from w) as changed_cell_count from r"""


@query(RULE_COUNTS)
def rule_metrics(spark, sf_dir):
    return FILL_STATUS.metrics(messy_customers(spark, sf_dir))


STEP_METRICS = f"""with a as ({RULE_COUNTS}), m as ({MESSY_CUSTOMERS})
    select 'fill' as step_id, 'scopedRule' as step_type, a.* from a
    union all select 'drop', 'filterRows', 0, 0, 0, 0
    union all select 'mark', 'scopedRule', count(*), 0, count(*), count(*) from m
      where balance = 'n/a' and not (email is null or email = '') or balance = 'n/a' and nation < 20"""


@query(STEP_METRICS)
def step_metrics(spark, sf_dir):
    """Counts of every step of a run."""
    return _metrics(spark, _metered(spark, sf_dir))


def _metered(spark, sf_dir):
    return count_steps(
        messy_customers(spark, sf_dir),
        [
            FILL_STATUS.named("fill"),
            filter_rows("drop", lambda r: fx.is_empty(r["email"])).named("drop"),
            scoped_rule(["balance"], cases=[Case(lambda r, v: fx.equals(v, "n/a"), Patch(fill="#ffcccc"))]).named("mark"),
        ],
    )


def _metrics(spark, run):
    rows = [tuple(s.values()) for s in run.summaries()]
    names = "matched_cell_count bigint, value_changed_cell_count bigint, format_changed_cell_count bigint, changed_cell_count bigint"
    return spark.createDataFrame(rows, f"step_id string, step_type string, {names}")


@query(STEP_METRICS)
def step_metrics_sorted_csv(spark, sf_dir):
    """The same counts where the result is sorted and written as CSV before they are read."""
    run = _metered(spark, sf_dir)
    write_csv(sort_rows([("full_name", "desc")])(run.table), scratch_path(spark, "csv"))
    return _metrics(spark, run)


@query(STEP_METRICS)
def step_metrics_ordered_parquet(spark, sf_dir):
    run = _metered(spark, sf_dir)
    write_parquet(sort_rows([("balance", "asc")])(run.table), scratch_path(spark, "parquet"), ordered=True)
    return _metrics(spark, run)


def _flat(summary):
    return summary.withColumn("created_column_ids", F.concat_ws(",", "created_column_ids"))


FILTERED_SUMMARY = f"""with m as ({MESSY_ORDERS}),
    w as (select *, priority is null or {sql_trim("priority")} = '' as gone,
      (priority is distinct from {sql_trim("priority")})::int as c1 from m),
    f as (select *, min(case when gone then o_orderkey end) over () as first_gone from w)
    select count_if(gone or true) as changed_row_count, sum(case when gone then 0 else c1 + 2 end)::bigint as changed_cell_count,
      count_if(gone) as removed_row_count, count_if(gone or o_orderkey > first_gone) > 0 as row_order_changed,
      'code' as created_column_ids from f"""
# Trimmed, filtered, one column added and one dropped; no sort.
FILTERED_STEPS = [
    scoped_rule(["priority"], default=Patch(lambda r, v: fx.trim(v))),
    filter_rows("drop", lambda r: fx.is_empty(r["priority"])),
    combine_columns(["o_orderstatus", "o_custkey"], "-", "code", "Code"),
    drop_columns(["price"]),
]


@query(FILTERED_SUMMARY)
def change_summary_filtered(spark, sf_dir):
    before = messy_orders(spark, sf_dir)
    return _flat(change_summary(before, apply_steps(before, FILTERED_STEPS)))


@query(FILTERED_SUMMARY)
def run_summary_without_join(spark, sf_dir):
    return _flat(run_summary(messy_orders(spark, sf_dir), FILTERED_STEPS))


@query(
    f"""with m as ({MESSY_CUSTOMERS}),
    r as (select c_custkey, nation > 20 and vip as gone, (nation <= 15 and (status is null or status = ''))::int as c1,
      coalesce(contains(balance, '-'), false)::int as c2 from m),
    f as (select *, min(case when gone then c_custkey end) over () as first_gone from r)
    select count_if(gone or c1 + c2 > 0 or coalesce(c_custkey > first_gone, false)) as changed_row_count,
      sum(case when gone then 0 else c1 + c2 end)::bigint as changed_cell_count, count_if(gone) as removed_row_count,
      count_if(gone) > 0 as row_order_changed, '' as created_column_ids from f"""
)
def run_summary_values_and_fills(spark, sf_dir):
    steps = [
        scoped_rule(
            ["status"],
            default=Patch(lambda r, v: fx.coalesce(v, "unknown")),
            where=lambda r: fx.not_(fx.greater_than(r["nation"], 15)),
        ),
        scoped_rule(["balance"], cases=[Case(lambda r, v: fx.contains(v, "-"), Patch(fill="#ffcccc"))]),
        filter_rows("keep", lambda r: fx.not_(fx.and_(r["vip"], fx.greater_than(r["nation"], 20)))),
    ]
    return _flat(run_summary(messy_customers(spark, sf_dir), steps))


@query(
    f"""with m as ({MESSY_ORDERS}),
    k as (select *, row_number() over (partition by o_custkey order by price desc nulls last, o_orderkey) as n,
      row_number() over (order by o_orderkey) as old_position from m),
    s as (select *, row_number() over (order by price desc nulls last, o_orderkey) as new_position from k where n = 1),
    j as (select k.o_orderkey, k.old_position, s.new_position, k.price from k left join s using (o_orderkey))
    select count_if(new_position is null or old_position <> new_position or price is null) as changed_row_count,
      count_if(new_position is not null and price is null) as changed_cell_count,
      count_if(new_position is null) as removed_row_count,
      count_if(new_position is null or old_position <> new_position) > 0 as row_order_changed, '' as created_column_ids from j"""
)
def change_summary_sorted(spark, sf_dir):
    before = messy_orders(spark, sf_dir)
    after = apply_steps(
        before,
        [
            sort_rows([("price", "desc")]),
            deduplicate_rows(["o_custkey"]),
            scoped_rule(["price"], default=Patch(lambda r, v: fx.coalesce(v, 0))),
        ],
    )
    return _flat(change_summary(before, after))


@query(
    f"""with m as ({MESSY_CUSTOMERS})
    select c_custkey as __id0, vip and nation < 5 as removed,
      case when vip and nation < 5 then 0 else
        (status is distinct from upper(status) or coalesce(contains(status, 'a'), false))::bigint + (balance is not distinct from 'n/a')::bigint end as changed_cells
    from m"""
)
def compare_cells(spark, sf_dir):
    before = messy_customers(spark, sf_dir)
    after = apply_steps(
        before,
        [
            scoped_rule(
                ["status"],
                cases=[
                    Case(lambda r, v: fx.contains(v, "a"), Patch(fill="#ffffff")),
                    Case(lambda r, v: fx.not_(fx.is_empty(v)), Patch(lambda r, v: fx.upper(v))),
                ],
            ),
            scoped_rule(["balance"], cases=[Case(lambda r, v: fx.equals(v, "n/a"), Patch(None))]),
            filter_rows("drop", lambda r: fx.and_(r["vip"], fx.less_than(r["nation"], 5))),
        ],
    )
    return compare_rows(before, after)


@query("select event_id, row_number() over (order by value desc nulls last, event_id) - 1 as position from events")
def dense_row_positions(spark, sf_dir):
    return dense_positions(sort_rows([("value", "desc")])(table(spark, sf_dir, "events", "event_id")))


@query(
    """select event_id, case when event_id % 2 = 0 then event_type else regexp_replace(value::varchar, '\\.0$', '') end as as_text,
      case when event_id % 2 = 1 then value end as as_number,
      case when event_id % 2 = 1 then case value when 1 then true when 0 then false end end as as_boolean, false as empty,
      row_number() over (partition by case when event_id % 2 = 0 then event_type end, case when event_id % 2 = 1 then value end
        order by event_id) = 1 as first_of_kind from events"""
)
def mixed_column(spark, sf_dir):
    """Casts, emptiness and deduplication on a column of mixed kinds."""
    events = _typed_events(spark, sf_dir)
    steps = [
        derive_column("as_text", "as_text", lambda r: fx.to_string(r["mixed"])),
        derive_column("as_number", "as_number", lambda r: fx.to_number(r["mixed"])),
        derive_column("as_boolean", "as_boolean", lambda r: fx.to_boolean(r["mixed"])),
        derive_column("empty", "empty", lambda r: fx.is_empty(r["mixed"])),
    ]
    firsts = deduplicate_rows(["mixed"])(events).df.select("event_id", F.lit(True).alias("first"))
    values = apply_steps(events, steps).df.join(firsts, "event_id", "left")
    first = F.coalesce("first", F.lit(False)).alias("first_of_kind")
    return values.select("event_id", "as_text", "as_number", "as_boolean", "empty", first)


def _result(spark, result):
    """A run's result as one row, with the counts of its rules added up."""
    total = {m: sum(s[m] for s in result.steps) for m in ("matched_cell_count", "value_changed_cell_count", "format_changed_cell_count")}
    row = (
        result.changed_row_count, result.changed_cell_count, result.removed_row_count, result.row_order_changed, ",".join(result.created_column_ids),
        result.sort_applied, *total.values(), result.table.df.count(),
    )
    names = "changed_row_count bigint, changed_cell_count bigint, removed_row_count bigint, row_order_changed boolean, created_column_ids string"
    return spark.createDataFrame([row], f"{names}, sort_applied boolean, {', '.join(f'{m} bigint' for m in total)}, row_count bigint")


@query(
    f"""with m as ({MESSY_ORDERS}),
    k as (select *, row_number() over (partition by o_custkey order by price desc nulls last, o_orderkey) as n,
      row_number() over (order by o_orderkey) as old_position from m),
    s as (select *, row_number() over (order by price desc nulls last, o_orderkey) as new_position from k where n = 1),
    j as (select k.o_orderkey, k.old_position, s.new_position, k.price from k left join s using (o_orderkey))
    select count_if(new_position is null or old_position <> new_position or price is null) as changed_row_count,
      count_if(new_position is not null and price is null) as changed_cell_count,
      count_if(new_position is null) as removed_row_count,
      count_if(new_position is null or old_position <> new_position) > 0 as row_order_changed, '' as created_column_ids,
      true as sort_applied, count(new_position) as matched_cell_count,
      count_if(new_position is not null and price is null) as value_changed_cell_count, 0 as format_changed_cell_count,
      count(new_position) as row_count from j"""
)
def run_result_sorted(spark, sf_dir):
    """One run: its table, what changed, and what its steps did."""
    steps = [
        sort_rows([("price", "desc")]),
        deduplicate_rows(["o_custkey"]),
        scoped_rule(["price"], default=Patch(lambda r, v: fx.coalesce(v, 0))),
    ]
    return _result(spark, execute(messy_orders(spark, sf_dir), steps))


@query(
    f"""select s.*, false as sort_applied, matched as matched_cell_count, changed as value_changed_cell_count, 0 as format_changed_cell_count, left_ as row_count
    from ({FILTERED_SUMMARY}) s, (select count(*) as matched, count_if(priority is distinct from {sql_trim("priority")}) as changed,
      count_if(not coalesce({sql_trim("priority")} = '', true)) as left_ from ({MESSY_ORDERS}))"""
)
def run_result_filtered(spark, sf_dir):
    return _result(spark, execute(messy_orders(spark, sf_dir), FILTERED_STEPS))
