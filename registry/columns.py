"""Derived, split, combined, renamed and dropped columns."""

from pyspark.sql import functions as F

from registry.common import MESSY_CUSTOMERS, messy_customers, named, query, table
from tablewash import functions as fx
from tablewash.operators import combine_columns, derive_column, drop_columns, rename_column, split_column
from tablewash.plans import apply_steps


@query(
    """select s_suppkey, s_name, s_nationkey, s_acctbal, s_acctbal as balance_copy, null::varchar as blank,
      'new' as constant, 1.5::double as factor, true as flag from supplier"""
)
def derive_copies_and_constants(spark, sf_dir):
    return apply_steps(
        table(spark, sf_dir, "supplier", "s_suppkey"),
        [
            derive_column("balance_copy", "Balance copy", lambda r: r["s_acctbal"]),
            derive_column("blank", "Blank", None),
            derive_column("constant", "Constant", "new"),
            derive_column("factor", "Factor", 1.5),
            derive_column("flag", "Flag", True),
        ],
    ).to_df()


@query(
    """select p_partkey, string_split(p_name, ' ')[1] as w1, string_split(p_name, ' ')[2] as w2,
      nullif(array_to_string(string_split(p_name, ' ')[3:], ' '), '') as w3 from part"""
)
def split_missing_parts(spark, sf_dir):
    step = split_column("p_name", " ", [("w1", "w1"), ("w2", "w2"), ("w3", "w3")])
    return step(table(spark, sf_dir, "part", "p_partkey")).df.select("p_partkey", "w1", "w2", "w3")


@query(
    r"""with p as (select doc_id, text, string_split(text, '. ') as parts from documents)
    select doc_id, parts[1] as sentence, case when len(parts) > 1 then parts[2] end as second,
      case when len(parts) > 2 then array_to_string(parts[3:], '. ') end as remainder from p"""
)
def split_remainder(spark, sf_dir):
    step = split_column("text", ". ", [("sentence", "a"), ("second", "b"), ("remainder", "c")])
    return step(table(spark, sf_dir, "documents", "doc_id")).df.select("doc_id", "sentence", "second", "remainder")


@query("""select c_custkey, split_part(c_name, '#', 1) as kind, split_part(c_name, '#', 2) as number from customer""")
def split_customer_names(spark, sf_dir):
    step = split_column("c_name", "#", [("kind", "Kind"), ("number", "Number")])
    return step(table(spark, sf_dir, "customer", "c_custkey")).df.select("c_custkey", "kind", "number")


@query(
    f"""with m as ({MESSY_CUSTOMERS})
    select c_custkey, concat_ws(', ', nullif(email, ''), nullif(email_2, ''), nullif(status, ''), nation::varchar, vip::varchar)
      as contact, concat_ws('|', nullif(email_2, ''), nullif(balance, '')) as spare from m"""
)
def combine_skip_empty(spark, sf_dir):
    return apply_steps(
        messy_customers(spark, sf_dir),
        [
            combine_columns(["email", "email_2", "status", "nation", "vip"], ", ", "contact", "Contact"),
            combine_columns(["email_2", "balance"], "|", "spare", "Spare"),
        ],
    ).df.select("c_custkey", "contact", "spare")


@query('select c_custkey, c_name as "Customer name", c_acctbal as "Account balance" from customer')
def drop_rename_columns(spark, sf_dir):
    return named(
        apply_steps(
            table(spark, sf_dir, "customer", "c_custkey"),
            [
                rename_column("c_name", "  Customer \n name "),
                drop_columns(["c_nationkey", "c_mktsegment"]),
                rename_column("c_acctbal", "Account balance"),
            ],
        )
    )


@query(
    """select c_custkey, left(c_name, 1) || right(c_name, 1) as initials,
      coalesce(upper(left(c_mktsegment, 1)), '') || c_nationkey::varchar as code from customer"""
)
def derive_initials(spark, sf_dir):
    return apply_steps(
        table(spark, sf_dir, "customer", "c_custkey"),
        [
            derive_column("initials", "initials", lambda r: fx.concat(fx.first(r["c_name"]), fx.last(r["c_name"]))),
            derive_column("code", "code", lambda r: fx.concat(fx.upper(fx.first(r["c_mktsegment"])), r["c_nationkey"])),
        ],
    ).df.select("c_custkey", "initials", "code")


@query(
    """with w as (select p_partkey, string_split(p_name, ' ') as ws, p_name from part)
    select p_partkey, len(ws)::double as words, ws[1] as first_word, ws[len(ws)] as last_word,
      ws[3] as third_word, p_name[2] as second_char,
      case when len(string_split(p_name, '')) >= 100 then 'x' end as far_char from w"""
)
def list_functions(spark, sf_dir):
    words = lambda r: fx.split(r["p_name"], " ")
    return apply_steps(
        table(spark, sf_dir, "part", "p_partkey"),
        [
            derive_column("words", "words", lambda r: fx.length(words(r))),
            derive_column("first_word", "first_word", lambda r: fx.first(words(r))),
            derive_column("last_word", "last_word", lambda r: fx.last(words(r))),
            derive_column("third_word", "third_word", lambda r: fx.at_index(words(r), 2)),
            derive_column("second_char", "second_char", lambda r: fx.at_index(r["p_name"], 1)),
            derive_column("far_char", "far_char", lambda r: fx.at_index(r["p_name"], 99)),
        ],
    ).df.select("p_partkey", *[F.col(c) for c in ("words", "first_word", "last_word", "third_word", "second_char", "far_char")])
