"""Hard negatives by exact integer scores, from Kronecker-packed products.

Vectors become integers, ``floor(256 * x)``, and a row's score is its inner product
with an anchor. Scores of a whole block of rows come from one wide integer per
component:

1. *Pack.* The block's least component is subtracted from all, so none is negative, and
   the i-th components of all its rows are laid side by side as fields of one wide
   integer. Fields are as wide as the largest possible sum, so none runs into the next.
2. *Multiply.* Each component of an anchor, made non-negative likewise, is multiplied
   once with the wide integer of its place, and the products are added up.
3. *Unpack.* The fields of the sum are read back, and what the two shifts added is taken off.

The anchors meet all rows in blocks. They are dealt into parts of bounded size, of which
each is broadcast while the tasks read the rows, and a task keeps only the best few rows
of each search. A second reading finds the negatives within each positive's limits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewash.session import stored

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
# A negative scores from 80 to 100 hundredths of its positive.
LEAST_SHARE, MOST_SHARE = 80, 100
# Bytes of the anchors that are broadcast at a time.
PART_BYTES = 16 << 20


class OverflowOfScores(ArithmeticError):
    """Scores that might not fit in 64 bits."""


@dataclass(frozen=True)
class Vectors:
    """Some rows: ids (with a mask of null ones), labels, and components, a row each."""

    ids: np.ndarray
    no_id: np.ndarray
    labels: np.ndarray
    components: np.ndarray

    def __len__(self) -> int:
        return len(self.ids)


def vectors_of(table: pa.RecordBatch | pa.Table, width: int) -> Vectors:
    """The columns vec_id, label and components; shorter vectors end in zeros."""
    ids, labels, lists = (
        c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (table.column(k) for k in ("vec_id", "label", "components"))
    )
    lengths = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        components = flat.reshape(len(lengths), width)
    else:
        components = np.zeros((len(lengths), width), dtype=np.int64)
        components[np.arange(width) < lengths[:, None]] = flat
    return Vectors(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), labels.to_numpy(), components)


class Packed:
    """A block's components, the i-th ones of all rows in one wide integer."""

    def __init__(self, components: np.ndarray, most_of_anchors: int):
        self.rows, width = components.shape
        self.low = int(components.min()) if components.size else 0
        shifted = components - self.low
        largest = int(shifted.max()) if components.size else 0
        self.field = np.dtype("<u4" if width * most_of_anchors * largest < 1 << 32 else "<u8")
        self.wide = [int.from_bytes(np.ascontiguousarray(column).tobytes(), "little") for column in shifted.T.astype(self.field)]
        self.sums = components.sum(axis=1)

    def scores(self, anchor: list[int], low_of_anchors: int) -> np.ndarray:
        """Inner products of all rows with an anchor, whose components are given less ``low_of_anchors``."""
        total = 0
        for component, column in zip(anchor, self.wide):
            if component:
                total += component * column
        fields = np.frombuffer(total.to_bytes(self.rows * self.field.itemsize, "little"), dtype=self.field)
        return fields.astype(np.int64) + self.low * sum(anchor) + low_of_anchors * self.sums


@dataclass(frozen=True)
class Search:
    """The best rows for an anchor with its label, or another, and a score within limits."""

    anchor: int
    same_label: bool
    least: int
    most: int


class Best:
    """The ``keep`` first rows of a search so far, by score and then by id, null ids last."""

    def __init__(self, keep: int):
        self.keep = keep
        self.rows = [np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool), np.zeros(0, dtype=bool)]

    def least(self, floor: int) -> int:
        """The score from which a row may still enter."""
        return max(floor, int(self.rows[0][-1])) if len(self.rows[0]) == self.keep else floor

    def offer(self, score: np.ndarray, ids: np.ndarray, no_id: np.ndarray, self_like: np.ndarray) -> None:
        rows = [np.concatenate(pair) for pair in zip(self.rows, (score, ids, no_id, self_like))]
        order = np.lexsort((~rows[3], rows[1], rows[2], -rows[0]))[: self.keep]
        self.rows = [r[order] for r in rows]


def found_in(batches: Iterator[pa.RecordBatch], anchors: Vectors, searches: list[Search], keep: int) -> Iterator[pa.RecordBatch]:
    """The best rows of each search among these batches, as rows
    ``(search, score, vec_id, self_like)``; the last says whether the row equals its anchor."""
    width = anchors.components.shape[1]
    low = int(anchors.components.min()) if anchors.components.size else 0
    shifted = (anchors.components - low).tolist()
    most = max((max(a, default=0) for a in shifted), default=0)
    best = [Best(keep) for _ in searches]
    for batch in batches:
        rows = vectors_of(batch, width)
        if not len(rows):
            continue
        packed, last, scores = Packed(rows.components, most), None, None
        for number, search in enumerate(searches):
            k = search.anchor
            if k != last:
                scores, last = packed.scores(shifted[k], low), k
                same = rows.labels == anchors.labels[k]
            wanted = (same if search.same_label else ~same) & (scores >= best[number].least(search.least)) & (scores <= search.most)
            at = np.flatnonzero(wanted)
            if len(at):
                twin = (rows.ids[at] == anchors.ids[k]) & ~rows.no_id[at]
                if twin.any():
                    twin &= same[at] & (rows.components[at] == anchors.components[k]).all(axis=1)
                best[number].offer(scores[at], rows.ids[at], rows.no_id[at], twin)
    sizes = [len(b.rows[0]) for b in best]
    columns = [np.concatenate([b.rows[c] for b in best]) if best else np.zeros(0, dtype=np.int64) for c in range(4)]
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.repeat(np.arange(len(best)), sizes), pa.int64()),
            pa.array(columns[0], pa.int64()),
            pa.array(columns[1], pa.int64(), mask=columns[2].astype(bool)),
            pa.array(columns[3].astype(bool)),
        ],
        names=["search", "score", "vec_id", "self_like"],
    )


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """``(vec_id, label, components)`` of the rows that take part."""

    def unusable(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    whole = F.transform(F.col(vector_col), lambda x: F.floor(F.lit(SCALE) * x.cast("double")).cast("long"))
    usable = label.isNotNull() & F.col(vector_col).isNotNull() & ~F.exists(vector_col, lambda x: unusable(x.cast("double")))
    return vectors.filter(usable).select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), whole.alias("components"))


def _searched(rows: DataFrame, anchors: Vectors, searches: list[Search], keep: int, label: str) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast((anchors, searches))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from found_in(batches, *shared.value, keep)

    found = stored(rows.mapInArrow(run, "search long, score long, vec_id long, self_like boolean"), label)
    shared.unpersist()
    return found


def _rank(*partition: str) -> Column:
    order = [F.col("score").desc(), F.col("vec_id").asc_nulls_last(), F.col("self_like").desc()]
    return Window.partitionBy(*partition).orderBy(*order)


def hard_negatives(
    vectors: DataFrame,
    label: Column | None = None,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    is_anchor: Column | None = None,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` for each
    anchor, each of its first ``positives`` other rows of its label, and the first
    ``negatives`` rows of another label that score from 80 to 100 hundredths of the positive.

    ``label`` is the column ``label`` by default; ``is_anchor`` chooses the anchors among
    the rows by ``vec_id`` and takes the ids that 100 divides by default. Higher scores come
    first, and of equal ones the smaller id; null ids come last and are never anchors by default.
    Rows with a null label, a null vector or a null or non-finite component take no part. Shorter
    vectors count as ending in zeros. Repeated rows are rows: each is a candidate, each repeated
    anchor has results of its own, and one copy of an anchor is the anchor itself. A positive
    without such rows gives none, and so does an empty table. Other columns are ignored. If a
    score might not fit in 64 bits, OverflowOfScores is raised before any score is made.
    """
    rows = stored(integer_vectors(vectors, id_col, vector_col, F.col("label") if label is None else label), "vectors")
    chosen = F.col("vec_id") % 100 == 0 if is_anchor is None else is_anchor
    anchors = stored(rows.filter(chosen).withColumn("number", F.monotonically_increasing_id()), "anchors")

    def largest(df: DataFrame):
        most = F.greatest(F.abs(F.array_max("components")), F.abs(F.array_min("components")))
        return df.agg(F.count("*").alias("n"), F.max(F.size("components")).alias("width"), F.max(most).alias("most")).first()

    all_, some = largest(rows), largest(anchors)
    width = all_["width"] or 0
    if 4 * width * (all_["most"] or 0) * (some["most"] or 0) >= 1 << 63:
        raise OverflowOfScores(f"components up to {all_['most']} in {width} places")
    parts = max(1, -(-some["n"] * 8 * max(width, 1) // part_bytes))
    made = [
        _mined(rows, anchors.filter(F.pmod("number", F.lit(parts)) == part), width, positives, negatives) for part in range(parts)
    ]
    result = made[0]
    for more in made[1:]:
        result = result.union(more)
    return result


def _mined(rows: DataFrame, part: DataFrame, width: int, positives: int, negatives: int) -> DataFrame:
    """The results of a part of the anchors, which is small enough to broadcast."""
    spark = rows.sparkSession
    table = part.select("vec_id", "label", "components").toArrow()
    anchors = vectors_of(table, width)
    endless = 1 << 62
    # One row more than is wanted, as the anchor itself may be among the best.
    best = _searched(rows, anchors, [Search(k, True, -endless, endless) for k in range(len(anchors))], positives + 1, "alike")
    order = _rank("search")
    selves = F.sum(F.col("self_like").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    alike = (
        best.withColumns({"place": F.row_number().over(order), "selves": selves})
        .filter(F.col("place") <= positives + 1)
        .filter(~(F.col("self_like") & (F.col("selves") == 1)))
        .filter(F.col("place") - F.least("selves", F.lit(1)) <= positives)
        .select("search", "score", "vec_id")
    )
    # At most ``positives`` rows for each anchor of the part.
    alike = stored(alike, "positives")
    wanted = sorted({(r["search"], r["score"]) for r in alike.select("search", "score").distinct().toArrow().to_pylist()})
    searches = [Search(k, False, -(-LEAST_SHARE * score // MOST_SHARE), score) for k, score in wanted]
    found = _searched(rows, anchors, searches, negatives, "unlike")
    names = spark.createDataFrame(
        pa.table(
            {
                "found_by": pa.array(range(len(searches)), pa.int64()),
                "search": pa.array([k for k, _ in wanted], pa.int64()),
                "positive_score": pa.array([s for _, s in wanted], pa.int64()),
                "anchor_id": pa.array([None if anchors.no_id[k] else int(anchors.ids[k]) for k, _ in wanted], pa.int64()),
            }
        )
    )
    ranked = found.withColumn("rank", F.row_number().over(_rank("search"))).filter(F.col("rank") <= negatives)
    named = ranked.select(F.col("search").alias("found_by"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    each = alike.select("search", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return (
        named.join(names, "found_by")
        .join(each, ["search", "positive_score"])
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
