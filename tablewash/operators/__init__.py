from tablewash.operators.columns import (
    combine_columns,
    comment,
    derive_column,
    drop_columns,
    rename_column,
    split_column,
)
from tablewash.operators.rows import deduplicate_rows, filter_rows, sort_rows
from tablewash.operators.rules import Case, Patch, ScopedRule, scoped_rule
from tablewash.operators.steps import Step
