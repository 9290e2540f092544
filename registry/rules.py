"""Scoped rules: values, fills, row conditions, match."""

from registry.common import (
    MESSY_CUSTOMERS,
    MESSY_ORDERS,
    messy_customers,
    messy_orders,
    query,
    sql_trim,
    table,
)
from tablewash import functions as fx
from tablewash.operators import Case, Patch, derive_column, scoped_rule
from tablewash.plans import apply_steps
from tablewash.sinks import cell_formats


@query(
    f"""with m as ({MESSY_ORDERS})
    select o_orderkey, o_custkey, o_orderstatus,
      case when priority is null or {sql_trim("priority")} = '' then 'unknown' else {sql_trim("priority")} end as priority,
      price from m"""
)
def fill_missing(spark, sf_dir):
    rule = scoped_rule(["priority"], default=Patch(lambda r, v: fx.coalesce(fx.trim(v), "unknown")))
    return rule(messy_orders(spark, sf_dir)).to_df()


@query(
    f"""with m as ({MESSY_ORDERS}),
    a as (select *, priority as v0, priority is null or {sql_trim("priority")} = '' as h1 from m),
    b as (select *, case when h1 then o_orderstatus || '-?' else v0 end as v1 from a),
    c as (select *, coalesce(starts_with(v1, 'F'), false) as h2 from b),
    d as (select *, case when h2 then v1 || '!' else v1 end as v2 from c),
    e as (select *, coalesce(contains(v2, '-?'), false) as h3 from d),
    f as (select *, case when h3 then replace(v2, '-?', '-none') else v2 end as v3 from e)
    select o_orderkey, case when h1 or h2 or h3 then v3 else lower({sql_trim("v3")}) end as priority,
      case when h3 then '#ccffcc' when h1 then '#ffeb9c' end as fill
    from f"""
)
def rule_cases_cumulative(spark, sf_dir):
    rule = scoped_rule(
        ["priority"],
        cases=[
            Case(lambda r, v: fx.is_empty(v), Patch(lambda r, v: fx.concat(r["o_orderstatus"], "-?"), "#FFEB9C")),
            Case(lambda r, v: fx.starts_with(v, "F"), Patch(lambda r, v: fx.concat(v, "!"))),
            Case(lambda r, v: fx.contains(v, "-?"), Patch(lambda r, v: fx.replace(v, "-?", "-none"), "#ccffcc")),
        ],
        default=Patch(lambda r, v: fx.lower(fx.trim(v))),
    )
    out = rule(messy_orders(spark, sf_dir))
    return out.df.select("o_orderkey", "priority", out.fill("priority").alias("fill"))


@query(
    f"""with m as ({MESSY_CUSTOMERS})
    select c_custkey, vip,
      case when vip and (status is null or status = '') then 'unknown' else status end as status,
      case when vip and (email is null or email = '') then 'unknown' else email end as email,
      full_name
    from m"""
)
def rule_row_condition(spark, sf_dir):
    rule = scoped_rule(
        ["status", "email"],
        default=Patch(lambda r, v: fx.coalesce(v, "unknown")),
        where=lambda r: fx.equals(r["vip"], True),
    )
    return rule(messy_customers(spark, sf_dir)).df.select("c_custkey", "vip", "status", "email", "full_name")


@query(
    """select p_partkey, p_type || '/' || p_brand as p_brand, p_type || '/' || p_brand as p_type,
      p_size from part"""
)
def rule_reads_row_before_step(spark, sf_dir):
    rule = scoped_rule(["p_brand", "p_type"], default=Patch(lambda r, v: fx.concat(r["p_type"], "/", r["p_brand"])))
    return rule(table(spark, sf_dir, "part", "p_partkey")).df.select("p_partkey", "p_brand", "p_type", "p_size")


@query(
    """select p_partkey, p_name,
      case when p_size > 45 then p_size * 8.0 when p_size > 40 then p_size * 4.0 when p_size > 30 then p_size * 2.0
           else p_size * 1.0 end::double as p_size
    from part"""
)
def rule_numeric_cases(spark, sf_dir):
    double = Patch(lambda r, v: fx.multiply(v, 2))
    cases = [Case(lambda r, v, limit=limit: fx.greater_than(r["p_size"], limit), double) for limit in (30, 40, 45)]
    return scoped_rule(["p_size"], cases=cases)(table(spark, sf_dir, "part", "p_partkey")).df.select(
        "p_partkey", "p_name", "p_size"
    )


@query(
    """with f as (
      select c_custkey, 'c_acctbal' as column_id, '#ff0000' as fill_color from customer where c_acctbal < 0
      union all select c_custkey, 'c_acctbal', '#fff2cc' from customer where c_acctbal > 9000
      union all select c_custkey, 'c_mktsegment', case when c_mktsegment = 'MACHINERY' then '#000080' else '#fff2cc' end
        from customer where c_acctbal > 9000 or c_mktsegment = 'MACHINERY')
    select c_custkey, column_id, fill_color,
      case when fill_color in ('#fff2cc') then '#1c1a17' else '#fffdf9' end as font_color from f"""
)
def highlight_cells(spark, sf_dir):
    out = apply_steps(
        table(spark, sf_dir, "customer", "c_custkey"),
        [
            scoped_rule(
                ["c_acctbal", "c_mktsegment"],
                default=Patch(fill="#FFF2CC"),
                where=lambda r: fx.greater_than(r["c_acctbal"], 9000),
            ),
            scoped_rule(["c_acctbal"], cases=[Case(lambda r, v: fx.less_than(v, 0), Patch(fill="#ff0000"))]),
            scoped_rule(["c_mktsegment"], cases=[Case(lambda r, v: fx.equals(v, "MACHINERY"), Patch(fill="#000080"))]),
        ],
    )
    return cell_formats(out)


@query(
    """with f as (select p_partkey, '#' || lower(printf('%06x', (p_partkey * 999331) % 16777216)) as fill from part),
    h as (select *, '0123456789abcdef' as d from f),
    c as (select p_partkey, fill,
      ((strpos(d, fill[2]) - 1) * 16 + strpos(d, fill[3]) - 1)::double as r,
      ((strpos(d, fill[4]) - 1) * 16 + strpos(d, fill[5]) - 1)::double as g,
      ((strpos(d, fill[6]) - 1) * 16 + strpos(d, fill[7]) - 1)::double as b from h)
    select p_partkey, fill,
      case when 0.2126::double * r + 0.7152::double * g + 0.0722::double * b >= 160 then '#1c1a17' else '#fffdf9' end as font
    from c"""
)
def readable_font_colors(spark, sf_dir):
    from pyspark.sql import functions as F

    from registry.common import scan
    from tablewash.functions.colors import readable_text_color

    number = (F.col("p_partkey") * 999331) % 16777216
    fill = F.concat(F.lit("#"), F.lower(F.lpad(F.hex(number), 6, "0")))
    df = scan(spark, sf_dir, "part").select("p_partkey", fill.alias("fill"))
    return df.withColumn("font", readable_text_color(F.col("fill")))


@query(
    f"""with m as ({MESSY_CUSTOMERS}),
    n as (select c_custkey, try_cast({sql_trim("balance")} as double) as bal, lower({sql_trim("status")}) as st from m)
    select c_custkey,
      case when bal is null or bal < 0 then 3.0 when bal >= 0 and bal <= 2000 then 2.0 else 1.0 end::double as score,
      case when st = 'active' then 'current' when st in ('household', 'building') then 'review'
           when st = 'inactive' then st end as label
    from n"""
)
def priority_match(spark, sf_dir):
    out = apply_steps(
        messy_customers(spark, sf_dir),
        [
            derive_column(
                "score",
                "score",
                lambda r: r.match(
                    fx.to_number(r["balance"]),
                    [(lambda b: fx.less_than(b, 0), 3), (lambda b: fx.between(b, 0, 2000), 2)],
                    otherwise=1,
                ),
            ),
            derive_column(
                "label",
                "label",
                lambda r: r.match(
                    fx.lower(fx.trim(r["status"])),
                    [
                        (lambda s: fx.equals(s, "active"), "current"),
                        (lambda s: fx.or_(fx.equals(s, "household"), fx.equals(s, "building")), "review"),
                        (lambda s: fx.equals(s, "inactive"), lambda s: s),
                    ],
                ),
            ),
        ],
    )
    return out.df.select("c_custkey", "score", "label")
