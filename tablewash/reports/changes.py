"""What a run changed: a before/after comparison of two tables."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce
from typing import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewash.functions import cells
from tablewash.functions.cells import Cell
from tablewash.operators.rows import FilterRows
from tablewash.operators.steps import Step
from tablewash.plans.runs import GONE, apply_steps
from tablewash.reports.positions import dense_positions
from tablewash.session import scratch_path
from tablewash.table import FILL, Table, run_time

SUMMARY = (
    "changed_row_count bigint, changed_cell_count bigint, removed_row_count bigint, "
    "row_order_changed boolean, created_column_ids array<string>"
)


def _comparable(table: Table, column_id: str) -> Cell:
    info = table.column(column_id)
    return Cell(F.col(column_id), info.type, info.spark)


def _comparable_values(old: Cell, new: Cell) -> tuple[Column, Column]:
    """Two cells in a form whose equality is that of their values."""
    if old.type == new.type or "unknown" in (old.type, new.type):
        (left, right), _, _ = cells.unify([old, new], "change summary")
        return left, right
    # Different types never hold the same value; only two nulls agree.
    return F.when(old.col.isNotNull(), F.lit("before")), F.when(new.col.isNotNull(), F.lit("after"))


def _same_order_spec(before: Table, after: Table) -> bool:
    """Both are ordered by the untouched row id, ascending."""
    labels = [(k.label, k.ascending) for k in before.order]
    return labels == [(k.label, k.ascending) for k in after.order] and len(labels) == len(before.row_id)


def _side(table: Table, prefix: str, ids: list[str], values: list[Column]) -> DataFrame:
    keys = [F.col(n).alias(f"__id{i}") for i, n in enumerate(table.row_id)]
    cols = [v.alias(f"{prefix}{i}") for i, v in enumerate(values)]
    fills = [F.col(FILL + c).alias(f"{prefix}fill_{c}") for c in ids if c in table.fills]
    return table.df.select(*keys, *cols, *fills)


def compare_rows(before: Table, after: Table) -> DataFrame:
    """Rows ``(__id*, removed, changed_cells)``, one per row of ``before``.

    Both sides are hashed on the row id, which must be unique, so no key is hot; a
    repeated id fails the job. Columns that
    exist on one side only count as one changed cell in each surviving row.
    """
    shared = [c for c in before.ids if c in after.ids]
    one_sided = len(before.columns) + len(after.columns) - 2 * len(shared)
    left_values, right_values = [], []
    for c in shared:
        left, right = _comparable_values(_comparable(before, c), _comparable(after, c))
        left_values.append(left)
        right_values.append(right)
    left = _side(before, "b", shared, left_values)
    right = _side(after, "a", shared, right_values).withColumn("__present", F.lit(True))
    keys = [f"__id{i}" for i in range(len(before.row_id))]
    joined = left.join(right, keys, "left")
    counts: list[Column] = [F.lit(one_sided)]
    for i, c in enumerate(shared):
        same = F.col(f"b{i}").eqNullSafe(F.col(f"a{i}"))
        if c in before.fills or c in after.fills:
            old = F.col(f"bfill_{c}") if c in before.fills else F.lit(None).cast("string")
            new = F.col(f"afill_{c}") if c in after.fills else F.lit(None).cast("string")
            same = same & old.eqNullSafe(new)
        counts.append((~same).cast("int"))
    # The join has brought equal ids together, so counting them moves nothing again.
    alike = F.count("*").over(Window.partitionBy(*keys))
    repeated = F.raise_error(F.lit("duplicateRowId: the row id is not unique, so rows can't be compared")).cast("boolean")
    joined = joined.withColumn("removed", F.when(alike > 1, repeated).otherwise(F.col("__present").isNull()))
    removed = F.col("removed")
    return joined.select(
        *keys,
        "removed",
        F.when(removed, F.lit(0)).otherwise(sum(counts[1:], counts[0])).cast("bigint").alias("changed_cells"),
    )


def change_summary(before: Table, after: Table) -> DataFrame:
    """One row: changed_row_count, changed_cell_count, removed_row_count,
    row_order_changed and created_column_ids.

    A row counts as changed if it was removed, moved, or has a changed cell or
    fill. The comparison is written once to the scratch folder as three narrow
    columns; what follows reads only those. If no sort ran, a row has moved
    exactly when an earlier row was removed, which needs one minimum instead of
    positions.
    """
    spark = before.df.sparkSession
    keys = [f"__id{i}" for i in range(len(before.row_id))]
    path = scratch_path(spark, "changes")
    compare_rows(before, after).write.parquet(path)
    rows = spark.read.parquet(path)
    place = F.struct(*keys)
    if _same_order_spec(before, after):
        first_removed = rows.filter("removed").agg(F.min(place).alias("f")).first()["f"]
        if first_removed is None:
            moved = F.lit(False)
        else:
            moved = place > F.struct(*[F.lit(v).cast(rows.schema[k].dataType).alias(k) for k, v in zip(keys, first_removed)])
    else:
        old, new = (
            dense_positions(t).select(*[F.col(n).alias(k) for k, n in zip(keys, t.row_id)], F.col("position").alias(name))
            for t, name in ((before, "__old"), (after, "__new"))
        )
        rows = rows.join(old, keys).join(new, keys, "left")
        moved = F.coalesce(F.col("__old") != F.col("__new"), F.lit(True))
    gone = F.col("removed")
    created = [c for c in after.ids if c not in before.ids]
    return rows.agg(
        F.count_if(gone | moved | (F.col("changed_cells") > 0)).alias("changed_row_count"),
        F.coalesce(F.sum("changed_cells"), F.lit(0).cast("bigint")).alias("changed_cell_count"),
        F.count_if(gone).alias("removed_row_count"),
        (F.count_if(gone | moved) > 0).alias("row_order_changed"),
    ).withColumn("created_column_ids", F.lit(created) if created else F.array().cast(T.ArrayType(T.StringType())))


def run_summary(before: Table, steps: Iterable[Step]) -> DataFrame:
    """The change summary of a run, without a join where none is needed.

    If the run neither sorts nor deduplicates, each row carries its original
    cells along and removed rows are only marked, so that counting is a scan
    without a shuffle, and a second one if rows were removed. Other runs compare
    the two tables.
    """
    steps = list(steps)
    if any(s.kind in ("sortRows", "deduplicateRows") for s in steps) or not _same_order_spec(before, before):
        return change_summary(before, apply_steps(before, steps))
    carrier, was, was_fill, place = carrying_originals(before)
    after = reduce(lambda t, s: s.marked(t, GONE) if isinstance(s, FilterRows) else s(t), steps, carrier)
    rows = after.df.select(
        F.col(GONE).alias("removed"),
        changed_cells(before, after, was, was_fill).alias("changed_cells"),
        (F.struct(*place) if len(place) > 1 else F.col(place[0])).alias("at"),
    )
    removed, changed = F.col("removed"), F.col("removed") | (F.col("changed_cells") > 0)
    found = rows.agg(
        F.count_if(changed).alias("rows"),
        F.coalesce(F.sum("changed_cells"), F.lit(0).cast("bigint")).alias("cells"),
        F.count_if(removed).alias("removed"),
        F.min(F.when(removed, F.col("at"))).alias("first"),
    ).first()
    changed_rows = found["rows"]
    if found["removed"]:
        first = found["first"] if len(place) > 1 else (found["first"],)
        limit = [F.lit(v).cast(after.df.schema[n].dataType).alias(n) for n, v in zip(place, first)]
        moved = F.col("at") > (F.struct(*limit) if len(place) > 1 else limit[0])
        changed_rows = rows.agg(F.count_if(changed | moved)).first()[0]
    created = [c for c in after.ids if c not in before.ids]
    summary = (changed_rows, found["cells"], found["removed"], found["removed"] > 0, created)
    return before.df.sparkSession.createDataFrame([summary], SUMMARY)


def carrying_originals(before: Table) -> tuple[Table, dict[str, str], dict[str, str], list[str]]:
    """The table with its cells, fills and row ids copied to carried columns, and with
    the carried flag GONE; the names of the copies."""
    was = {c: f"__was{i}" for i, c in enumerate(before.ids)}
    was_fill = {c: f"__wasfill{i}" for i, c in enumerate(before.ids) if c in before.fills}
    place = [f"__place{i}" for i in range(len(before.row_id))]
    originals = [F.col(c).alias(n) for c, n in was.items()] + [F.col(FILL + c).alias(n) for c, n in was_fill.items()]
    originals += [F.col(c).alias(n) for c, n in zip(before.row_id, place)]
    carrier = replace(
        before,
        df=before.df.select("*", *originals, F.lit(False).alias(GONE)),
        carried=before.carried + tuple(was.values()) + tuple(was_fill.values()) + tuple(place) + (GONE,),
        run_at=before.run_at or run_time(),
    )
    return carrier, was, was_fill, place


def changed_cells(before: Table, after: Table, was: dict[str, str], was_fill: dict[str, str]) -> Column:
    """How many cells of a row that carries its originals differ from them; 0 in removed rows."""
    shared = [c for c in before.ids if c in after.ids]
    changes = F.lit(len(before.columns) + len(after.columns) - 2 * len(shared))
    for c in shared:
        old, new = _comparable_values(replace(_comparable(before, c), col=F.col(was[c])), _comparable(after, c))
        same = old.eqNullSafe(new)
        if c in before.fills or c in after.fills:
            fill = F.col(was_fill[c]) if c in was_fill else F.lit(None).cast("string")
            same = same & fill.eqNullSafe(after.fill(c))
        changes = changes + (~same).cast("int")
    return F.when(F.col(GONE), F.lit(0)).otherwise(changes).cast("bigint")
