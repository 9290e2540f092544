"""A DataFrame with column names, row order, row identity and cell fills.

Row order is data: a list of columns with directions. Nothing is sorted until
a sink or a preview asks for it. The order and identity columns may be visible
ones; they are copied to hidden columns only when a step is about to overwrite
or drop them, so an unused order costs nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone
from typing import Any, Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewash.errors import StepError
from tablewash.functions import cells
from tablewash.functions.cells import Cell

HIDDEN = "__"
FILL = "__fill__"
# Hidden columns that the sources add: where a row comes from.
OWN = ("__row_id", "__file", "__block", "__row", "__path", "__number")


@dataclass(frozen=True)
class ColumnInfo:
    id: str
    name: str
    type: str
    spark: T.DataType = field(compare=False)


@dataclass(frozen=True)
class OrderKey:
    """One sort key. ``label`` names it for good; ``column`` is where it is now."""

    label: str
    column: str
    ascending: bool = True

    def expression(self) -> Column:
        col = F.col(self.column)
        return col.asc_nulls_last() if self.ascending else col.desc_nulls_last()


def _display_key(name: str) -> str:
    return collapse(name).lower()


def collapse(name: str) -> str:
    """Trimmed, with each run of whitespace as one space."""
    return " ".join(re.split(f"[{re.escape(cells.WHITESPACE)}]+", name.strip(cells.WHITESPACE)))


@dataclass(frozen=True)
class Table:
    df: DataFrame
    columns: tuple[ColumnInfo, ...]
    order: tuple[OrderKey, ...]
    row_id: tuple[str, ...]
    fills: frozenset[str] = frozenset()
    run_at: str | None = None
    # Whether the partitions already hold the rows in order, as after a scan
    # that numbered them. Sinks then need no sort.
    in_order: bool = False
    # Further hidden columns that every step hands on.
    carried: tuple[str, ...] = ()

    # --- construction ------------------------------------------------------

    @staticmethod
    def of(
        df: DataFrame,
        row_id: str | Sequence[str] | None = None,
        names: dict[str, str] | None = None,
        types: dict[str, str] | None = None,
    ) -> "Table":
        """Wrap a DataFrame whose columns become the table's columns.

        ``row_id`` names the columns that identify a row and give the initial
        order. Without it a generated id is used, which follows the order of
        the input partitions. ``types`` overrides logical types, for example
        ``{"signup": "date"}`` for ISO dates kept as text.
        """
        names, types = names or {}, types or {}
        ids = (row_id,) if isinstance(row_id, str) else tuple(row_id or ())
        columns = []
        for f in df.schema.fields:
            if "." in f.name or "`" in f.name:
                raise StepError("invalidColumnId", f"rename column {f.name!r}: dots and backticks name nested fields")
            if f.name.startswith(HIDDEN):
                if f.name not in OWN and f.name not in ids and not f.name.startswith(FILL):
                    raise StepError("invalidColumnId", f"rename column {f.name!r}: names from {HIDDEN!r} on are the package's own")
                continue
            kind = types.get(f.name) or f.metadata.get("logicalType") or cells.logical_type(f.dataType)
            name = names.get(f.name) or f.metadata.get("displayName") or f.name
            columns.append(ColumnInfo(f.name, name, kind, f.dataType))
        nulls = [c.id for c in columns if isinstance(c.spark, T.NullType)]
        if nulls:
            df = df.withColumns({n: F.col(n).cast("string") for n in nulls})
            columns = [replace(c, spark=T.StringType()) if c.id in nulls else c for c in columns]
        numbered = row_id is None
        if row_id is None:
            df = df.withColumn("__row_id", F.monotonically_increasing_id())
            row_id = ("__row_id",)
        ids = (row_id,) if isinstance(row_id, str) else tuple(row_id)
        fills = frozenset(c.id for c in columns if FILL + c.id in df.columns)
        order = tuple(OrderKey(i, i) for i in ids)
        return Table(df, tuple(columns), order, ids, fills, in_order=numbered)

    @staticmethod
    def read_parquet(spark: SparkSession, path: str, row_id: str | Sequence[str] | None = None) -> "Table":
        """Parquet files as a table. Without ``row_id`` rows are identified by
        file and position in the file: unlike a generated id these are known to
        the scan, so filters and column pruning still reach it."""
        df = spark.read.parquet(path)
        if row_id is not None:
            return Table.of(df, row_id)
        df = df.select(
            "*",
            F.col("_metadata.file_path").alias("__file"),
            F.col("_metadata.row_index").alias("__row"),
        )
        return Table.of(df, ("__file", "__row"))

    # --- lookup ------------------------------------------------------------

    @property
    def ids(self) -> list[str]:
        return [c.id for c in self.columns]

    def column(self, column_id: str) -> ColumnInfo:
        for c in self.columns:
            if c.id == column_id:
                return c
        raise StepError("missingColumn", f"column {column_id!r} does not exist")

    def hidden_names(self) -> list[str]:
        used = [k.column for k in self.order] + list(self.row_id) + [FILL + c for c in sorted(self.fills)]
        used += self.carried
        return [n for n in dict.fromkeys(used) if n not in self.ids]

    def fill(self, column_id: str) -> Column:
        return F.col(FILL + column_id) if column_id in self.fills else F.lit(None).cast("string")

    def order_columns(self) -> list[Column]:
        return [k.expression() for k in self.order]

    # --- checks shared by the steps ------------------------------------------

    def check_targets(self, column_ids: Sequence[str], at_least: int = 1) -> list[ColumnInfo]:
        found = [self.column(c) for c in column_ids]
        if len(set(column_ids)) != len(column_ids):
            raise StepError("duplicateColumnReference", f"a column is named twice in {list(column_ids)}")
        if len(column_ids) < at_least:
            raise StepError("emptyTarget", f"at least {at_least} column(s) must be named")
        return found

    def check_name(self, name: str, ignoring: str | None = None) -> str:
        clean = collapse(name)
        if not clean:
            raise StepError("invalidDisplayName", "a display name must not be blank")
        for c in self.columns:
            if c.id != ignoring and _display_key(c.name) == _display_key(clean):
                raise StepError("nameConflict", f"display name {clean!r} is taken by column {c.id!r}")
        return clean

    def check_new(self, column_id: str, name: str) -> str:
        if column_id in self.ids:
            raise StepError("duplicateColumnId", f"column {column_id!r} already exists")
        if not re.fullmatch(r"[A-Za-z][A-Za-z0-9_-]*", column_id):
            raise StepError("invalidColumnId", f"{column_id!r} is not made of letters, digits, '_' and '-'")
        return self.check_name(name)

    # --- building the next table ----------------------------------------------

    def protect(self, column_ids: Sequence[str]) -> "Table":
        """Copy order and identity columns that are about to change."""
        at_risk = [n for n in dict.fromkeys([k.column for k in self.order] + list(self.row_id)) if n in column_ids]
        if not at_risk:
            return self
        taken = set(self.df.columns)
        moved = {}
        for n in at_risk:
            serial = next(i for i in range(len(taken) + 1) if f"__key{i}_{n}" not in taken)
            moved[n] = f"__key{serial}_{n}"
            taken.add(moved[n])
        return replace(
            self,
            df=self.df.select("*", *[F.col(n).alias(m) for n, m in moved.items()]),
            order=tuple(replace(k, column=moved.get(k.column, k.column)) for k in self.order),
            row_id=tuple(moved.get(n, n) for n in self.row_id),
        )

    def with_new(self, added: dict[str, tuple[str, Cell]], df: DataFrame | None = None) -> "Table":
        """Append columns, given as id -> (display name, cell)."""
        source = self.df if df is None else df
        keep = self.ids + self.hidden_names()
        selected = source.select(*keep, *[value.col.alias(i) for i, (_, value) in added.items()])
        infos = tuple(ColumnInfo(i, name, value.type, value.spark) for i, (name, value) in added.items())
        return replace(self, df=selected, columns=self.columns + infos)

    def transform(self, step: Callable[["Table"], "Table"]) -> "Table":
        return step(self)

    # --- output --------------------------------------------------------------

    def to_df(self) -> DataFrame:
        """The visible columns, unordered, with names and types as metadata."""
        return self.df.select(
            *[
                F.col(c.id).alias(c.id, metadata={"displayName": c.name, "logicalType": c.type})
                for c in self.columns
            ]
        )

    def sorted_df(self) -> DataFrame:
        """The DataFrame with its hidden columns, in row order."""
        return self.df if self.in_order else self.df.orderBy(*self.order_columns())

    def preview(self, rows: int = 50) -> DataFrame:
        """The first rows in row order: a top-k, not a full sort."""
        return self.df.orderBy(*self.order_columns()).limit(rows).select(*self.ids)


class Row:
    """What a row expression sees: cells by column id, and the run time."""

    def __init__(self, table: Table, first: int = 0):
        self._table = table
        self._first = first
        self._bound: dict[str, Column] = {}
        self._run_at = table.run_at or run_time()

    def next(self) -> "Row":
        """The same row for a later projection, whose bound names do not clash."""
        return Row(self._table, self._first + len(self._bound))

    def __getitem__(self, column_id: str) -> Cell:
        info = self._table.column(column_id)
        if info.type == "opaque":
            raise StepError("incompatibleType", f"column {column_id!r} holds {info.spark.simpleString()}")
        return Cell(F.col(column_id), info.type, info.spark)

    def now(self) -> Cell:
        """The moment the run started, the same in every row and step."""
        return Cell(F.lit(self._run_at), "datetime", cells.STRING, literal=self._run_at)

    def bind(self, value: Cell) -> Cell:
        """Compute a value once per row, in a projection of its own."""
        name = f"__bound{self._first + len(self._bound)}"
        self._bound[name] = value.col
        return value.bound_to(name)

    def match(self, subject: Any, cases: Sequence[tuple[Any, Any]], otherwise: Any = None) -> Cell:
        """The result of the first case whose test holds, else ``otherwise``.

        Tests and results may be functions of the subject's value.
        """
        if not cases:
            raise StepError("invalidExpression", "match needs at least one case")
        value = cells.scalar("match", subject)
        if not value.is_literal and len(cases) > 1:
            value = self.bind(value)

        def at(part: Any) -> Cell:
            return cells.scalar("match", part(value) if callable(part) else part)

        tests = [cells.truthy(cells.boolean_arg("match", at(test))) for test, _ in cases]
        results, kind, spark_type = cells.unify([at(r) for _, r in cases] + [at(otherwise)], "match")
        case = F
        for test, result in zip(tests, results):
            case = case.when(test.col, result)
        return Cell(case.otherwise(results[-1]), kind, spark_type)

    def stage(self, df: DataFrame) -> DataFrame:
        """Add the bound values to the DataFrame the expression will run on."""
        for name, col in self._bound.items():
            df = df.withColumn(name, col)
        return df


def run_time() -> str:
    now = datetime.now(timezone.utc)
    return f"{now:%Y-%m-%dT%H:%M:%S}.{now.microsecond // 1000:03d}Z"
