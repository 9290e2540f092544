from tablewash.reports.changes import change_summary, compare_rows, run_summary
from tablewash.reports.execution import RunResult, execute
from tablewash.reports.positions import dense_positions
from tablewash.reports.profile import infer_types, profile
