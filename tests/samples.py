"""A ledger of instrument loans with its flaws, and step documents, for the tests."""

# Names with a bracket, a repeat and a gap; padded cells, a quoted line break, a blank
# line, values that are no numbers or dates, and a row that is too wide.
LOANS = '''Loan,Instrument [kind],Borrower,borrower,Deposit,,Back?,Due
7,viola,Ada  Moe,,80,x,TRUE,2024-03-01
8,"cello
3/4",  Bo ,bo@band.test,"1,200",,FALSE,2024-02-30

9,drum,,kit@band.test,-15.5,,,2024-03-09
10,"lute ""old""",Cy,,,,true,
11,viola,Ada Moe,ada@band.test,80,x,FALSE,2024-03-01,late
'''


def lit(value):
    return {"kind": "literal", "value": value}


def col(column_id):
    return {"kind": "column", "columnId": column_id}


def call(name, *args):
    return {"kind": "call", "name": name, "args": list(args)}


def match(subject, *cases):
    return {"kind": "match", "subject": subject, "cases": list(cases)}


def when(test, then):
    return {"kind": "when", "when": test, "then": then}


def otherwise(then):
    return {"kind": "otherwise", "then": then}


VALUE = {"kind": "value"}
CASE = {"kind": "caseValue"}


def rule(step_id, columns, default=None, cases=None, where=None):
    step = {"id": step_id, "type": "scopedRule", "columnIds": columns}
    if default is not None:
        step["defaultPatch"] = default
    if cases is not None:
        step["cases"] = cases
    if where is not None:
        step["rowCondition"] = where
    return step


def derive(step_id, column_id, expression):
    return {"id": step_id, "type": "deriveColumn", "newColumn": {"columnId": column_id, "displayName": column_id}, "expression": expression}


def workflow(workflow_id, *steps):
    return {"version": 2, "workflowId": workflow_id, "name": workflow_id, "steps": list(steps)}


# Who to ask for an instrument, and how.
ASKING = workflow(
    "asking",
    {"id": "why", "type": "comment", "text": "a call list for the store"},
    rule("names", ["col_borrower"], {"value": call("collapseWhitespace", call("trim", VALUE))}),
    derive("reach", "reach", match(
        col("col_borrower_2"),
        when(call("isEmpty", CASE), call("concat", lit("post:"), col("col_borrower"))),
        when(call("endsWith", CASE, lit("band.test")), call("concat", lit("mail:"), CASE)),
        otherwise(lit("?")),
    )),
    rule("returned", ["col_loan"], cases=[
        {"when": call("equals", col("col_back"), lit(True)), "then": {"format": {"fillColor": "#C0FFC0"}}},
        {"when": call("isEmpty", col("col_back")), "then": {"value": call("multiply", VALUE, lit(-1)), "format": {"fillColor": "#ffe0e0"}}},
    ]),
    {"id": "known", "type": "filterRows", "mode": "drop", "condition": call("and", call("isEmpty", col("col_borrower")), call("isEmpty", col("col_borrower_2")))},
)

# The latest loan of each instrument and borrower.
LATEST = workflow(
    "latest",
    rule("kind", ["col_instrument_kind"], {"value": call("replaceRegex", VALUE, lit("\\s.*$"), lit(""))}),
    rule("names", ["col_borrower"], {"value": call("lower", call("collapseWhitespace", call("trim", VALUE)))}),
    {"id": "newest", "type": "sortRows", "sorts": [{"columnId": "col_loan", "direction": "desc"}]},
    {"id": "one", "type": "deduplicateRows", "columnIds": ["col_instrument_kind", "col_borrower"]},
    {"id": "slim", "type": "dropColumns", "columnIds": ["col_column", "col_column_2"]},
)
