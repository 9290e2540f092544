"""Step lists as JSON documents, and sequences of them."""

import json

import pytest

from support import cells, fills
from samples import ASKING, CASE, LATEST, LOANS, VALUE, call, col, derive, lit, match, otherwise, rule, when, workflow
from tablewash import StepError, Table
from tablewash.plans import apply_steps, find_issues, package_from_document, run_sequence, workflow_from_document
from tablewash.plans.documents import CALLS


@pytest.fixture
def loans(load_csv):
    return load_csv(LOANS).table


def run(table, document):
    return apply_steps(table, workflow_from_document(document).steps)


def test_loans_import(loans):
    types = {c.id: c.type for c in loans.columns}
    assert types == {
        "col_loan": "number", "col_instrument_kind": "string", "col_borrower": "string", "col_borrower_2": "string",
        "col_deposit": "mixed", "col_column": "string", "col_back": "boolean", "col_due": "string", "col_column_2": "string",
    }
    assert cells(loans, "col_instrument_kind") == ["viola", "cello\n3/4", None, "drum", 'lute "old"', "viola"]


def test_asking(loans):
    out = run(loans, ASKING)
    assert cells(out, "col_loan") == [7, 8, -9, 10, 11]
    assert cells(out, "reach") == ["post:Ada Moe", "mail:bo@band.test", "mail:kit@band.test", "post:Cy", "mail:ada@band.test"]
    assert fills(out, "col_loan") == ["#c0ffc0", None, "#ffe0e0", "#c0ffc0", None]


def test_latest(loans):
    out = run(loans, LATEST)
    assert cells(out, "col_loan") == [11, 10, 9, 8, None]
    assert cells(out, "col_instrument_kind") == ["viola", "lute", "drum", "cello", None]
    assert "col_column" not in out.ids


def test_every_call_can_be_planned(spark):
    """Each function name of the documents runs on a value of a fitting type."""
    t = Table.of(spark.createDataFrame([(1, "2026-01-02", 2.0, True)], "id int, t string, n double, b boolean"), "id")
    special = {
        "datePart": [lit("day")], "dateDiff": [col("t"), lit("days")], "dateAdd": [lit(1), lit("days")],
        "substring": [lit(0), lit(2)], "replace": [lit("a"), lit("b")], "replaceRegex": [lit("a"), lit("b")], "atIndex": [lit(0)],
    }
    steps = []
    for i, (name, (_, fewest, _most)) in enumerate(CALLS.items()):
        kind = "n" if fewest and name in ("round", "floor", "ceil", "abs", "add", "subtract", "multiply", "divide", "modulo", "greaterThan", "lessThan") else "t"
        kind = "b" if name in ("and", "or", "not") else kind
        args = [col(kind)] + special.get(name, [col(kind) if "Regex" not in name else lit("2")] * (fewest - 1))
        expression = call(name, *args)
        if name == "split":
            expression = call("length", expression)
        steps.append(derive(f"s{i}", f"x{i}", expression))
    steps.append(derive("now", "x_now", call("now")))
    row = run(t, workflow("all", *steps)).to_df().first()
    assert len(CALLS) + 1 == 42 and len(row) == 4 + 42
    assert row["x_now"].endswith("Z")


def test_match_documents(load_csv):
    t = load_csv("tide,port,gauge\r\nspring,Brest,4.5\r\nneap,Brest,1\r\nslack,,-2\r\nSPRING ,Rouen,\r\n").table
    tide = call("lower", call("trim", col("col_tide")))
    out = run(
        t,
        workflow(
            "m",
            derive("a", "call_at", match(
                tide,
                when(call("and", call("equals", CASE, lit("spring")), call("equals", col("col_port"), lit("Rouen"))), lit("inland")),
                when(call("or", call("equals", CASE, lit("spring")), call("equals", CASE, lit("slack"))), CASE),
            )),
            derive("b", "depth", match(
                col("col_gauge"),
                when(call("lessThan", CASE, lit(0)), lit("below")),
                when(call("greaterThan", CASE, lit(4)), call("concat", lit("over "), call("toString", CASE))),
                otherwise(lit("usual")),
            )),
        ),
    )
    assert cells(out, "call_at") == ["spring", None, "slack", "inland"]
    assert cells(out, "depth") == ["over 4.5", "usual", "below", "below"]


@pytest.mark.parametrize(
    "step, code",
    [
        (derive("s", "x", VALUE), "invalidExpression"),
        (derive("s", "x", CASE), "invalidExpression"),
        (derive("s", "x", call("nope", lit(1))), "invalidExpression"),
        (derive("s", "x", call("trim")), "invalidExpression"),
        (derive("s", "x", call("now", lit(1))), "invalidExpression"),
        (derive("s", "x", match(col("col_a"), otherwise(lit("x")), when(call("equals", CASE, lit("a")), lit("y")))), "invalidExpression"),
        (derive("s", "x", match(col("col_a"), when(lit("no"), lit("A")))), "incompatibleType"),
        (derive("s", "x", match(col("col_a"), when(call("equals", CASE, lit("a")), lit(3)), otherwise(lit("b")))), "incompatibleType"),
        (rule("s", ["col_a"], {"value": match(VALUE, when(call("isEmpty", CASE), lit("b")))}), "invalidExpression"),
        (rule("s", ["col_a"], where=call("isEmpty", VALUE), default={"value": lit("x")}), "invalidExpression"),
        (derive("s", "x", call("extractRegex", col("col_a"), lit("[abc"))), "invalidRegex"),
        (derive("s", "x", {"kind": "other"}), "invalidExpression"),
    ],
)
def test_document_errors(load_csv, step, code):
    t = load_csv("a\r\nx\r\n").table
    found = find_issues(t, workflow_from_document(workflow("w", step)).steps)
    assert [(e.code, e.step_id) for e in found] == [(code, "s")]


def test_malformed_documents():
    for bad in (
        workflow("w", {"id": "a", "type": "joinTables"}),
        workflow("w", {"id": "a", "type": "dropColumns"}),
        {"workflowId": "w"},
        workflow("w", {"id": "a", "type": "comment"}, {"id": "a", "type": "comment"}),
    ):
        with pytest.raises(StepError):
            workflow_from_document(bad)


def test_sequences(load_csv, tmp_path):
    t = load_csv("a\r\n x \r\n").table
    trim = workflow("trim", rule("s", ["col_a"], {"value": call("trim", VALUE)}))
    mark = workflow("mark", derive("s", "b", call("concat", col("col_a"), lit("!"))))
    extra = workflow("extra", derive("s", "c", lit(1)))
    path = tmp_path / "package.json"
    path.write_text(json.dumps({"version": 1, "workflows": [extra, mark, trim], "runOrderWorkflowIds": ["trim", "gone", "mark"]}))
    package = package_from_document(path)
    assert [s.step_id for s in package.steps()] == ["trim__s", "mark__s"]
    assert run_sequence(t, package).to_df().first()[:] == ("x", "x!")
    assert run_sequence(t, package, up_to="trim").ids == ["col_a"]
    assert run_sequence(t, package, up_to="mark").to_df().first()["b"] == "x!"
    assert run_sequence(t, package, up_to="extra").ids == ["col_a", "c"]
    with pytest.raises(StepError):
        run_sequence(t, package, up_to="gone")
    assert package_from_document(json.dumps(trim)).run_order == ("trim",)
