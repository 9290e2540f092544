"""Whole step lists, as code and as documents, and sequences of them."""

from registry.common import MESSY_CUSTOMERS, MESSY_ORDERS, messy_customers, messy_orders, query, sql_trim
from tablewash import functions as fx
from tablewash.operators import (
    Case,
    Patch,
    comment,
    deduplicate_rows,
    derive_column,
    drop_columns,
    filter_rows,
    scoped_rule,
    sort_rows,
)
from tablewash.plans import Package, Workflow, apply_steps, package_from_document, run_sequence
from tablewash.reports import dense_positions

# One debtor per nation and standing: VIPs, and whoever owes or has an unreadable balance.
CLEANUP_STEPS = [
    scoped_rule(["balance"], cases=[Case(lambda r, v: fx.equals(v, "n/a"), Patch(None))]),
    derive_column("owed", "Owed", lambda r: fx.subtract(0, fx.to_number(r["balance"]))),
    scoped_rule(
        ["status"],
        default=Patch(lambda r, v: fx.upper(fx.coalesce(fx.trim(v), r["email_2"], "unset"))),
        where=lambda r: fx.not_(r["vip"]),
    ),
    filter_rows("keep", lambda r: fx.or_(r["vip"], fx.less_than(r["owed"], 0))),
    comment("the largest debt of each nation and standing speaks for it"),
    sort_rows([("owed", "desc")]),
    deduplicate_rows(["nation", "status"]),
]
KEPT = f"""with m as ({MESSY_CUSTOMERS}),
    o as (select *, 0 - try_cast(case when balance <> 'n/a' then {sql_trim("balance")} end as double) as owed,
      case when vip then status else upper(coalesce(nullif({sql_trim("status")}, ''), nullif(email_2, ''), 'unset')) end as s from m),
    d as (select *, row_number() over (partition by nation, s order by owed desc nulls last, c_custkey) as n
      from o where vip or coalesce(owed < 0, true))"""


@query(f"{KEPT} select c_custkey, s as status, owed, nation from d where n = 1")
def customer_cleanup(spark, sf_dir):
    out = apply_steps(messy_customers(spark, sf_dir), CLEANUP_STEPS)
    return out.df.select("c_custkey", "status", "owed", "nation")


@query(f"{KEPT} select c_custkey, row_number() over (order by owed desc nulls last, c_custkey) - 1 as position from d where n = 1")
def customer_cleanup_order(spark, sf_dir):
    return dense_positions(apply_steps(messy_customers(spark, sf_dir), CLEANUP_STEPS))


def lit(value):
    return {"kind": "literal", "value": value}


def col(column_id):
    return {"kind": "column", "columnId": column_id}


def call(name, *args):
    return {"kind": "call", "name": name, "args": list(args)}


def when(test, then):
    return {"kind": "when", "when": test, "then": then}


VALUE, CASE = {"kind": "value"}, {"kind": "caseValue"}
def rule(step_id, column_id, **parts):
    return {"id": step_id, "type": "scopedRule", "columnIds": [column_id], **parts}


def derive(step_id, column_id, expression):
    new = {"columnId": column_id, "displayName": column_id}
    return {"id": step_id, "type": "deriveColumn", "newColumn": new, "expression": expression}


# Which desk an order goes to, how urgent it is there, and what is odd about it.
ORDER_DESK = {
    "version": 2,
    "workflowId": "order_desk",
    "name": "Order desk",
    "steps": [
        rule("tidy", "priority", defaultPatch={"value": call("coalesce", call("collapseWhitespace", call("trim", VALUE)), lit("9-NONE"))}),
        derive("rank", "rank", call("toNumber", call("first", col("priority")))),
        derive("desk", "desk", {
            "kind": "match",
            "subject": col("price"),
            "cases": [
                when(call("greaterThan", CASE, lit(250000)), call("concat", lit("large-"), col("o_orderstatus"))),
                when(call("and", call("lessThan", CASE, lit(50000)), call("not", call("isEmpty", CASE))), lit("counter")),
                when(call("isEmpty", CASE), lit("pricing")),
                {"kind": "otherwise", "then": lit("floor")},
            ],
        }),
        rule("urgent", "rank", rowCondition=call("startsWith", col("desk"), lit("large")), cases=[
            {"when": call("lessThan", VALUE, lit(3)), "then": {"value": lit(0), "format": {"fillColor": "#D95F02"}}},
            {"when": call("equals", VALUE, lit(0)), "then": {"format": {"fillColor": "#1b9e77"}}},
            {"when": call("greaterThan", VALUE, lit(8)), "then": {"format": {"fillColor": "#7570B3"}}},
        ]),
        rule("unpriced", "price", rowCondition=call("equals", col("desk"), lit("pricing")), defaultPatch={"value": lit(-1), "format": {"fillColor": "#cccccc"}}),
        {"id": "closed", "type": "filterRows", "mode": "drop", "condition": call("and", call("equals", col("o_orderstatus"), lit("F")), call("equals", col("desk"), lit("counter")))},
        {"id": "slim", "type": "dropColumns", "columnIds": ["o_custkey"]},
    ],
}


@query(
    f"""with m as ({MESSY_ORDERS}),
    t as (select *, coalesce(nullif(regexp_replace({sql_trim("priority")}, '\\s+', ' ', 'g'), ''), '9-NONE') as p from m),
    d as (select *, try_cast(p[1] as double) as r, case when price > 250000 then 'large-' || o_orderstatus when price < 50000 then 'counter'
      when price is null then 'pricing' else 'floor' end as desk from t)
    select o_orderkey, o_orderstatus, p as priority, desk, case when desk = 'pricing' then -1.0 else price end as price,
      case when desk like 'large%' and r < 3 then 0.0 else r end as rank,
      case when desk like 'large%' and r < 3 then '#1b9e77' when desk like 'large%' and r > 8 then '#7570b3' end as rank_fill,
      case when desk = 'pricing' then '#cccccc' end as price_fill
    from d where not (o_orderstatus = 'F' and desk = 'counter')"""
)
def order_desk_document(spark, sf_dir):
    out = run_sequence(messy_orders(spark, sf_dir), package_from_document(ORDER_DESK))
    return out.df.select(
        "o_orderkey", "o_orderstatus", "priority", "desk", "price", "rank", out.fill("rank").alias("rank_fill"), out.fill("price").alias("price_fill")
    )


PACKAGE = Package(
    (
        Workflow("label", "Label", (derive_column("label", "label", lambda r: fx.concat(r["status"], "/", r["nation"])),)),
        Workflow(
            "fill",
            "Fill",
            (
                scoped_rule(["status"], default=Patch(lambda r, v: fx.coalesce(fx.trim(v), "unknown"))),
                scoped_rule(["status"], cases=[Case(lambda r, v: fx.equals(v, "INACTIVE"), Patch("inactive"))]),
            ),
        ),
        Workflow("slim", "Slim", (drop_columns(["email", "email_2"]), filter_rows("keep", lambda r: r["vip"]))),
    ),
    ("fill", "missing", "label", "slim"),
)
FILLED = f"""with m as ({MESSY_CUSTOMERS}),
    f as (select *, case when status is null or {sql_trim("status")} = '' then 'unknown'
      when {sql_trim("status")} = 'INACTIVE' then 'inactive' else {sql_trim("status")} end as st from m)"""


@query(f"{FILLED} select c_custkey, st as status, balance, vip, full_name, nation, st || '/' || nation::varchar as label from f where vip")
def run_workflow_sequence(spark, sf_dir):
    return run_sequence(messy_customers(spark, sf_dir), PACKAGE).to_df()


@query(f"{FILLED} select c_custkey, email, st as status, st || '/' || nation::varchar as label from f")
def run_up_to_workflow(spark, sf_dir):
    out = run_sequence(messy_customers(spark, sf_dir), PACKAGE, up_to="label")
    return out.df.select("c_custkey", "email", "status", "label")
