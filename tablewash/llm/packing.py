"""Conflict-constrained best-fit packing of documents into training sequences.

A document is cut into pieces of at most ``capacity`` tokens. Full pieces are sequences
by themselves; the rest is packed: longest first, each piece into the open bin with
the least room that can take it. Bins are kept in order of their residual room, and
each carries bitmaps of the duplicate clusters and the sources in it. A bin is
compatible with a piece if it holds none of the piece's cluster and fewer
than ``per_source`` pieces of its source. The search starts at the successor of the
piece's length and goes on until the tightest compatible bin is found; without
any, the piece opens a bin.

Documents are dealt out to groups of bounded size by the hash of their ids, and each
group is packed on its own. Copies and sources are spread over all groups, and a
group ends with few bins that are not full.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewash.llm.quality_rules import SPACES, words
from tablewash.session import stored

CAPACITY = 2048
PER_SOURCE = 4
# Pieces that are packed together, on average.
GROUP_ROWS = 8_000


def token_length(text: Column) -> Column:
    """Words, and one end of the document."""
    return (F.size(words(F.coalesce(text, F.lit("")))) + 1).cast("long")


def copy_cluster(text: Column) -> Column:
    """Equal for texts that differ only in white space and ASCII capitals."""
    return F.xxhash64(F.lower(F.array_join(words(F.coalesce(text, F.lit(""))), " ")))


class Bins:
    """Open bins by residual. ``clusters`` and ``sources`` of a bin are bitmaps over the
    numbers of the group's clusters and sources; a source has a bitmap for
    each piece of it that a bin may hold."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.order: list[tuple[int, int]] = []
        self.clusters: list[int] = []
        self.sources: list[list[int]] = []
        # Where the search for the last piece ended, and for which kind of piece.
        self.kind: tuple[int, int, int] | None = None
        self.reached: tuple[int, int] = (0, -1)

    def place(self, length: int, cluster: int, source: int) -> tuple[int, int]:
        """The bin of a piece and its offset in it."""
        at = bisect_left(self.order, (length, -1))
        kind = (length, cluster, source)
        if kind == self.kind:
            # Bins passed over for an equal piece have not become compatible.
            at = max(at, bisect_left(self.order, self.reached))
        own, from_ = 1 << cluster, 1 << source
        while at < len(self.order):
            number = self.order[at][1]
            if not self.clusters[number] & own and not self.sources[number][-1] & from_:
                break
            at += 1
        self.kind = kind
        self.reached = self.order[at] if at < len(self.order) else (self.capacity + 1, 0)
        if at < len(self.order):
            room, number = self.order.pop(at)
        else:
            room, number = self.capacity, len(self.clusters)
            self.clusters.append(0)
            self.sources.append([0] * self.per_source)
        self.clusters[number] |= own
        for plane in range(self.per_source):
            if not self.sources[number][plane] & from_:
                self.sources[number][plane] |= from_
                break
        if room > length:
            insort(self.order, (room - length, number))
        return number, self.capacity - room


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    cluster: Column | None = None,
    length: Column | None = None,
    capacity: int = CAPACITY,
    per_source: int = PER_SOURCE,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """``(doc_id, piece, first_token, n_tokens, group, bin, bin_offset)``, a row per piece.

    Tokens are words and one end per document, so every row of ``docs`` has a piece,
    also with a null or empty text. ``cluster`` tells which documents are copies, by
    default equal words whatever their ASCII case; ``length`` tells their tokens, where
    they are known already and no text is needed. ``group`` and ``bin`` name a sequence,
    ``bin_offset`` counts its tokens from 0 without gaps. A null source is one of its
    own; a null id is dealt out by its text. Repeated rows are copies like any
    others and never share a bin, nor does a document's rest with its equal. Ties go by
    cluster, source and id. Other columns are ignored, and an empty table gives no rows.
    """
    clusters = copy_cluster(F.col(text_col)) if cluster is None else F.xxhash64(cluster)
    rows = stored(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (token_length(F.col(text_col)) if length is None else length).alias("length"),
            clusters.alias("cluster"),
            F.xxhash64(F.coalesce(F.col(source_col), F.lit(""))).alias("source"),
        ),
        "lengths",
    )
    groups = max(1, -(-rows.count() // group_rows))
    # Rows that repeat an id differ by their number among those, so they spread too.
    dealt = rows.withColumn(
        "group",
        F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "cluster", F.monotonically_increasing_id()), F.lit(groups)),
    )
    kind = docs.schema[id_col].dataType.simpleString()

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("cluster", "ascending"), ("source", "ascending"), ("doc_id", "ascending")])
        length = group["length"].to_numpy()
        whole, rest = length // capacity, length % capacity
        cluster = np.unique(group["cluster"].to_numpy(), return_inverse=True)[1].tolist()
        source = np.unique(group["source"].to_numpy(), return_inverse=True)[1].tolist()
        bins = Bins(capacity, per_source)
        row, piece, number, offset, size = [], [], [], [], []
        # Rests by falling length; the rows are in order of whole lengths.
        order = np.argsort(-rest, kind="stable")
        for i in order[rest[order] > 0].tolist():
            b, at = bins.place(int(rest[i]), cluster[i], source[i])
            for values, value in zip((row, piece, number, offset, size), (i, int(whole[i]), b, at, int(rest[i]))):
                values.append(value)
        full = np.repeat(np.arange(len(length)), whole)
        nth = np.arange(len(full)) - np.repeat(np.cumsum(whole) - whole, whole)
        row = np.concatenate([np.array(row, dtype=np.int64), full])
        piece = np.concatenate([np.array(piece, dtype=np.int64), nth])
        return pa.table(
            {
                "doc_id": group["doc_id"].take(pa.array(row)),
                "piece": piece,
                "first_token": piece * capacity,
                "n_tokens": np.concatenate([np.array(size, dtype=np.int64), np.full(len(full), capacity)]),
                "group": pa.array(np.full(len(row), group["group"][0].as_py() if group.num_rows else 0)),
                "bin": np.concatenate([np.array(number, dtype=np.int64), len(bins.clusters) + np.arange(len(full))]),
                "bin_offset": np.concatenate([np.array(offset, dtype=np.int64), np.zeros(len(full), dtype=np.int64)]),
            }
        )

    return dealt.groupBy("group").applyInArrow(
        pack,
        f"doc_id {kind}, piece long, first_token long, n_tokens long, group long, bin long, bin_offset long",
    )
