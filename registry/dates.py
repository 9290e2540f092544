"""Date functions."""

from pyspark.sql import functions as F

from registry.common import query, scan, table
from tablewash import Table
from tablewash import functions as fx
from tablewash.operators import derive_column
from tablewash.plans import apply_steps

PARTS = ["year", "month", "day", "dayOfWeek", "hour", "minute", "second"]


@query(
    """select event_id, year(ts)::double as "year", month(ts)::double as "month", day(ts)::double as "day",
      dayofweek(ts)::double as "dayOfWeek", hour(ts)::double as "hour", minute(ts)::double as "minute",
      second(ts)::double as "second" from events"""
)
def date_parts(spark, sf_dir):
    steps = [derive_column(p, p, lambda r, p=p: fx.date_part(r["ts"], p)) for p in PARTS]
    return apply_steps(table(spark, sf_dir, "events", "event_id"), steps).df.select("event_id", *PARTS)


UNITS = {"years": 31536000000, "months": 2592000000, "days": 86400000, "hours": 3600000, "minutes": 60000, "seconds": 1000}
DIFFS = ", ".join(
    f"(epoch_ms(l_shipdate) - epoch_ms(timestamp '1998-06-15 12:30:00')) / {millis}.0::double as {unit}"
    for unit, millis in UNITS.items()
)


@query(f"select l_orderkey, l_linenumber, l_partkey, l_suppkey, {DIFFS} from lineitem")
def date_diff_fixed(spark, sf_dir):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    steps = [
        derive_column(u, u, lambda r, u=u: fx.date_diff(r["l_shipdate"], "1998-06-15T12:30:00Z", u)) for u in UNITS
    ]
    return apply_steps(table(spark, sf_dir, "lineitem", keys), steps).df.select(*keys, *UNITS)


def _month_add(months: str) -> str:
    """Months added to d with the day of the month running over."""
    total = f"(year(d) * 12 + month(d) - 1 + {months})"
    day = f"make_date(({total} // 12)::int, ({total} % 12 + 1)::int, 1) + (day(d) - 1)::int"
    return f"strftime({day}, '%Y-%m-%dT00:00:00.000Z')"


@query(
    f"""with m as (select o_orderkey, o_orderdate::date as d from orders)
    select o_orderkey, {_month_add("1")} as next_month, {_month_add("-13")} as months_back, {_month_add("12")} as next_year,
      strftime(d + 30, '%Y-%m-%dT00:00:00.000Z') as days_30,
      strftime(d::timestamp + interval 90 minute, '%Y-%m-%dT%H:%M:%S.000Z') as minutes_90,
      strftime(d::timestamp - interval 1 second, '%Y-%m-%dT%H:%M:%S.000Z') as second_back from m"""
)
def date_add_overflow(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    orders = Table.of(scan(spark, sf_dir, "orders").select("o_orderkey", day.alias("d")), "o_orderkey")
    wanted = {
        "next_month": (1, "months"),
        "months_back": (-13, "months"),
        "next_year": (1, "years"),
        "days_30": (30, "days"),
        "minutes_90": (90, "minutes"),
        "second_back": (-1, "seconds"),
    }
    steps = [derive_column(n, n, lambda r, a=a, u=u: fx.date_add(r["d"], a, u)) for n, (a, u) in wanted.items()]
    return apply_steps(orders, steps).df.select("o_orderkey", *wanted)


def _far(day: str) -> str:
    """ISO text of a day at midnight, in years of any length."""
    year = f"year({day})"
    return (
        f"case when {year} between 0 and 9999 then lpad({year}::varchar, 4, '0') "
        f"else case when {year} < 0 then '-' else '+' end || lpad(abs({year})::varchar, 6, '0') end "
        f"|| '-' || lpad(month({day})::varchar, 2, '0') || '-' || lpad(day({day})::varchar, 2, '0') || 'T00:00:00.000Z'"
    )


@query(
    f"""with a as (select o_orderkey, o_orderdate::date as d, (o_orderkey % 5 - 2)::int as k from orders),
    x as (select o_orderkey, k, d + k * 40000000 as days, make_date(year(d) + k * 100000, month(d), 1) + (day(d) - 1)::int as years,
      make_date(year(d) + (month(d) - 1 + k * 1000001) // 12, (month(d) - 1 + k * 1000001) % 12 + 1, 1) + (day(d) - 1)::int as months from a where k >= 0
      union all select o_orderkey, k, d + k * 40000000, make_date(year(d) + k * 100000, month(d), 1) + (day(d) - 1)::int,
      make_date(year(d) + (month(d) - 1 + k * 1000001 + 12000000) // 12 - 1000000, (month(d) - 1 + k * 1000001 + 12000000) % 12 + 1, 1) + (day(d) - 1)::int
      from a where k < 0)
    select o_orderkey, {_far("days")} as days, {_far("years")} as years, {_far("months")} as months,
      null::varchar as too_far from x"""
)
def date_add_extremes(spark, sf_dir):
    """Amounts that lead up to 219,000 years away, and one past the last moment."""
    k = F.pmod("o_orderkey", F.lit(5)) - 2
    days = scan(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderdate").cast("date").alias("d"), k.cast("double").alias("k"), F.lit(2e11).alias("far")
    )
    wanted = {"days": 40_000_000, "years": 100_000, "months": 1_000_001}
    steps = [derive_column(u, u, lambda r, u=u, n=n: fx.date_add(r["d"], fx.multiply(r["k"], n), u)) for u, n in wanted.items()]
    steps.append(derive_column("too_far", "too_far", lambda r: fx.date_add(r["d"], r["far"], "days")))
    return apply_steps(Table.of(days, "o_orderkey"), steps).df.select("o_orderkey", *wanted, "too_far")


@query(
    """with m as (select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as d from orders),
    t as (select o_orderkey, case o_orderkey % 6 when 0 then d when 1 then ' ' || d || 'T08:30 ' when 2 then d || 'T08:30:15.250Z'
      when 3 then d || 'T08:30:00+02:00' when 4 then replace(d, '-', '/') else d || ' 10:00' end as written, d from m)
    select o_orderkey, written, case when o_orderkey % 6 < 4 then year(d::date)::double end as "year",
      case o_orderkey % 6 when 0 then 0.0 when 1 then 8.0 when 2 then 8.0 when 3 then 6.0 end::double as "hour",
      case o_orderkey % 6 when 0 then 0.0 when 1 then 510.0 when 2 then 510.25416666666666 when 3 then 390.0 end::double as minutes
    from t"""
)
def date_text_parsing(spark, sf_dir):
    key, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    written = (
        F.when(key % 6 == 0, day)
        .when(key % 6 == 1, F.concat(F.lit(" "), day, F.lit("T08:30 ")))
        .when(key % 6 == 2, F.concat(day, F.lit("T08:30:15.250Z")))
        .when(key % 6 == 3, F.concat(day, F.lit("T08:30:00+02:00")))
        .when(key % 6 == 4, F.replace(day, F.lit("-"), F.lit("/")))
        .otherwise(F.concat(day, F.lit(" 10:00")))
    )
    df = scan(spark, sf_dir, "orders").select("o_orderkey", written.alias("written"), day.alias("d"))
    return apply_steps(
        Table.of(df, "o_orderkey", types={"d": "date"}),
        [
            derive_column("year", "year", lambda r: fx.date_part(r["written"], "year")),
            derive_column("hour", "hour", lambda r: fx.date_part(r["written"], "hour")),
            derive_column("minutes", "minutes", lambda r: fx.date_diff(r["written"], r["d"], "minutes")),
        ],
    ).df.select("o_orderkey", "written", "year", "hour", "minutes")


@query("select o_orderkey, true as same_moment, true as recent, 24.0::double as width from orders")
def now_is_stable(spark, sf_dir):
    return apply_steps(
        table(spark, sf_dir, "orders", "o_orderkey"),
        [
            derive_column("a", "a", lambda r: r.now()),
            derive_column("b", "b", lambda r: r.now()),
            derive_column("same_moment", "same_moment", lambda r: fx.equals(r["a"], r["b"])),
            derive_column("recent", "recent", lambda r: fx.greater_than(r["a"], r["o_orderdate"])),
            derive_column("width", "width", lambda r: fx.length(fx.to_string(r["a"]))),
        ],
    ).df.select("o_orderkey", "same_moment", "recent", "width")
