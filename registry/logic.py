"""Two-valued predicates, equality, ordering and truth."""

from registry.common import MESSY_CUSTOMERS, MESSY_ORDERS, messy_customers, messy_orders, query, sql_trim
from tablewash import functions as fx
from tablewash.operators import derive_column
from tablewash.plans import apply_steps


def _derive(table, wanted, key):
    steps = [derive_column(n, n, build) for n, build in wanted.items()]
    return apply_steps(table, steps).df.select(key, *wanted)


@query(
    f"""with m as ({MESSY_ORDERS})
    select o_orderkey, priority is null or {sql_trim("priority")} = '' as empty, price is null as empty_price,
      priority is not distinct from '' as is_blank_text, priority is null as is_null,
      price is distinct from 1000 as not_thousand, coalesce(priority <> '', false) as true_text,
      coalesce(price <> 0, false) as true_number from m"""
)
def truthiness_and_equality(spark, sf_dir):
    wanted = {
        "empty": lambda r: fx.is_empty(r["priority"]),
        "empty_price": lambda r: fx.is_empty(r["price"]),
        "is_blank_text": lambda r: fx.equals(r["priority"], ""),
        "is_null": lambda r: fx.equals(r["priority"], None),
        "not_thousand": lambda r: fx.not_equals(r["price"], 1000),
        "true_text": lambda r: fx.truthy(r["priority"]),
        "true_number": lambda r: fx.truthy(r["price"]),
    }
    return _derive(messy_orders(spark, sf_dir), wanted, "o_orderkey")


@query(
    f"""with m as ({MESSY_ORDERS}), c as (select *, case when o_orderkey % 4 <> 0 then o_custkey * 100.0 end::double as cap from m)
    select o_orderkey, coalesce(price > cap, false) as gt, price is null or coalesce(price < cap, false) as lt,
      coalesce(price > cap, false) or price is not distinct from cap as gte,
      price is null or coalesce(price < cap, false) or price is not distinct from cap as lte,
      coalesce(price >= 100000 and price < 200000, false) as mid,
      coalesce(price > 100000, false) and coalesce(price < 200000, false) as open_mid from c"""
)
def ordering_with_nulls(spark, sf_dir):
    from pyspark.sql import functions as F

    from tablewash import Table

    orders = messy_orders(spark, sf_dir)
    cap = F.when(F.col("o_orderkey") % 4 != 0, F.col("o_custkey") * 100.0).cast("double")
    table = Table.of(orders.df.withColumn("cap", cap), "o_orderkey")
    wanted = {
        "gt": lambda r: fx.greater_than(r["price"], r["cap"]),
        "lt": lambda r: fx.less_than(r["price"], r["cap"]),
        "gte": lambda r: fx.at_least(r["price"], r["cap"]),
        "lte": lambda r: fx.at_most(r["price"], r["cap"]),
        "mid": lambda r: fx.between(r["price"], 100000, 200000, include_high=False),
        "open_mid": lambda r: fx.between(r["price"], 100000, 200000, False, False),
    }
    return _derive(table, wanted, "o_orderkey")


@query(
    f"""with m as ({MESSY_CUSTOMERS}), b as (select c_custkey,
      case lower({sql_trim("status")}) when 'active' then true when 'inactive' then false end as active, vip, email from m),
    t as (select *, case when c_custkey is not null and active is not null then active end as a from b)
    select c_custkey, coalesce(a, false) and vip as both, coalesce(a, false) or vip as some, not coalesce(a, false) as negated,
      coalesce(a, false) and vip and (email is null or {sql_trim("email")} = '') as three from t"""
)
def and_or_not(spark, sf_dir):
    active = lambda r: r.match(
        fx.lower(fx.trim(r["status"])),
        [(lambda s: fx.equals(s, "active"), True), (lambda s: fx.equals(s, "inactive"), False)],
    )
    wanted = {
        "both": lambda r: fx.and_(active(r), r["vip"]),
        "some": lambda r: fx.or_(active(r), r["vip"]),
        "negated": lambda r: fx.not_(active(r)),
        "three": lambda r: fx.and_(active(r), r["vip"], fx.is_empty(r["email"])),
    }
    return _derive(messy_customers(spark, sf_dir), wanted, "c_custkey")
