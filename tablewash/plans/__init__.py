from tablewash.plans.documents import package_from_document, workflow_from_document
from tablewash.plans.runs import (
    CountedRun,
    Package,
    Workflow,
    apply_steps,
    find_issues,
    count_steps,
    run_sequence,
)
