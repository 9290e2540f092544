"""Table cleanup steps for Spark DataFrames."""

from tablewash.errors import StepError
from tablewash.session import prepare_session
from tablewash.table import Row, Table
