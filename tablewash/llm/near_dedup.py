"""Near duplicates: MinHash signatures joined by a multi-index Hamming search.

A text's set holds its distinct five-word shingles. Texts are linked if the
Jaccard similarity of their full sets reaches the threshold, and linked texts
form groups. The stages:

1. One pass hashes the shingles: the size of the set, a digest of the set and a
   signature of ``slots`` MinHash values of 16 bits. Texts with one digest have
   the same set, and only the smallest id of such a class goes on.
2. The signature is split into chunks. If two signatures differ in at most
   ``radius`` slots, then by the pigeonhole principle some chunk differs in at
   most ``radius // chunks`` slots. Every way to leave that many slots of a chunk
   out gives one key, so each such pair shares a key.
3. In each key's bucket, members are checked against the smallest one. That
   groups the members of most buckets. Buckets left with several groups compare
   all signatures within the radius between groups, large buckets in pairs of
   blocks; pairs within a group can add nothing.
4. Each candidate pair is confirmed on the full sets of its texts. Large buckets
   confirm pairs in place and hand on links only.

A pair of similarity s differs in a slot with probability 1 - s. The radius is
set so far above the mean at the threshold that a linked pair exceeds it with a
probability of about one in 30,000, and closer pairs far less often.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewash.llm.components import connected_components
from tablewash.llm.words import is_space_free, mixed, slices, utf8, words_of
from tablewash.session import stored

SHINGLE = 5
_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    """``share`` is the similarity in hundredths. ``deviations`` is the margin of
    the radius over its mean at that similarity, in standard deviations. Buckets of
    up to ``pairs_up_to`` members are paired by a join. Larger ones that share members
    form a family, which is compared as a whole up to ``family`` members and bucket
    by bucket beyond, in blocks of ``block``; every way finds the same links. Ids are broadcast up to
    ``broadcast_rows`` of them (16 bytes each) and joined by a shuffle beyond."""

    share: int = 75
    slots: int = 128
    chunks: int = 26
    deviations: float = 4.0
    pairs_up_to: int = 32
    family: int = 16_384
    block: int = 1024
    broadcast_rows: int = 1_000_000

    @property
    def radius(self) -> int:
        miss = 1 - self.share / 100
        return int(self.slots * miss + self.deviations * (self.slots * miss * (1 - miss)) ** 0.5)

    @property
    def errors(self) -> int:
        """Slots that may differ in the best chunk."""
        return self.radius // self.chunks

    def edges(self) -> list[int]:
        return [i * self.slots // self.chunks for i in range(self.chunks + 1)]

    def selections(self) -> list[tuple[int, ...]]:
        """The slots of each key: a chunk without the slots that may differ."""
        found = []
        for low, high in zip(self.edges(), self.edges()[1:]):
            found += combinations(range(low, high), max(high - low - self.errors, 0))
        return found


def shingle_sets(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For slices of the rows in order: hashes of the distinct shingles of all
    rows, sorted within each row, and the number of each row's shingles."""
    data, offsets = utf8(column)
    for low, high in slices(offsets):
        at = offsets[low : high + 1]
        words = words_of(data[at[0] : at[-1]], at - at[0], is_space_free())
        hashes, count = words.hashes(), np.diff(words.first)
        full = np.zeros(0, dtype=np.uint64)
        if len(hashes) >= SHINGLE:
            n = len(hashes) - SHINGLE + 1
            full = np.zeros(n, dtype=np.uint64)
            for k in range(SHINGLE):
                full = full * _ODD + hashes[k : k + n]
            same = words.row[:n] == words.row[SHINGLE - 1 :]
            full, row = mixed(full[same]), words.row[:n][same]
        else:
            row = np.zeros(0, dtype=np.int64)
        short = np.flatnonzero((count > 0) & (count < SHINGLE))
        if len(short):
            whole = np.zeros(len(short), dtype=np.uint64)
            for k in range(SHINGLE - 1):
                has = count[short] > k
                whole[has] = whole[has] * _ODD + hashes[words.first[short[has]] + k]
            whole = mixed(whole + count[short].astype(np.uint64))
            full, row = np.concatenate([full, whole]), np.concatenate([row, short])
            order = np.argsort(row, kind="stable")
            full, row = full[order], row[order]
        edges = np.searchsorted(row, np.arange(high - low + 1))
        for a, b in zip(edges, edges[1:]):
            if b - a > 1:
                full[a:b].sort()
        new = np.ones(len(full), dtype=bool)
        new[1:] = (full[1:] != full[:-1]) | (row[1:] != row[:-1])
        yield full[new], np.bincount(row[new], minlength=high - low)


def _signatures(sets: np.ndarray, size: np.ndarray, slots: int) -> np.ndarray:
    """16 bits of the smallest value under each of ``slots`` hash functions, per set."""
    filled = np.flatnonzero(size)
    result = np.zeros((len(size), slots), dtype=np.uint16)
    if not len(filled):
        return result
    factor = mixed(np.arange(1, slots + 1, dtype=np.uint64)) | np.uint64(1)
    # Pieces that stay in cache; a set longer than a piece is one of its own.
    ends = np.cumsum(size[filled])
    for low, high in slices(np.concatenate([[0], ends]), 1 << 15):
        base = ends[low] - size[filled[low]]
        piece = sets[base : ends[high - 1]]
        starts = ends[low:high] - size[filled[low:high]] - base
        product = np.empty_like(piece)
        for k in range(slots):
            np.multiply(piece, factor[k], out=product)
            least = np.minimum.reduceat(product, starts)
            result[filled[low:high], k] = mixed(least) & np.uint64(0xFFFF)
    return result


def _add(sets: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The sum over each row's numbers; 0 for rows without any."""
    total = np.zeros(len(size), dtype=np.uint64)
    filled = np.flatnonzero(size)
    if len(filled):
        total[filled] = np.add.reduceat(sets, (np.cumsum(size) - size)[filled])
    return total


def signatures(docs: DataFrame, settings: Settings, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, tag, n, h1, h2, signature)``: a hash of the text, the set's size, its
    digest in 128 bits and the slots."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags, done = batch.column(0), batch.column(1), 0
            for sets, size in shingle_sets(batch.column(2)):
                slots = _signatures(sets, size, settings.slots)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(done, len(size)),
                        tags.slice(done, len(size)),
                        pa.array(size.astype(np.int64)),
                        pa.array(_add(sets, size).view(np.int64)),
                        pa.array(_add(mixed(sets ^ _ODD), size).view(np.int64)),
                        pa.array([row.tobytes() for row in slots], pa.binary()),
                    ],
                    names=["doc_id", "tag", "n", "h1", "h2", "signature"],
                )
                done += len(size)

    return _texts(docs, id_col, text_col).mapInArrow(
        sign, "doc_id long, tag long, n long, h1 long, h2 long, signature binary"
    )


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"), text.alias("text"))


def _slots(column: pa.Array, slots: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, slots)


def _keys(classes: DataFrame, settings: Settings) -> DataFrame:
    """``(key, choice, id)``: each class under every selection of slots, and its number."""
    selections = [np.array(s) for s in settings.selections()]

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            slots = _slots(batch.column(1), settings.slots).astype(np.uint64) + np.uint64(1)
            keys = np.empty((len(ids), len(selections)), dtype=np.uint64)
            for j, chosen in enumerate(selections):
                key = np.full(len(ids), j + 1, dtype=np.uint64)
                for k in chosen:
                    key = mixed(key * _ODD + slots[:, k])
                keys[:, j] = key
            for low in range(0, len(ids), 1000):
                part = keys[low : low + 1000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(part.ravel().view(np.int64)),
                        pa.array(np.tile(np.arange(len(selections), dtype=np.int32), len(part))),
                        pa.array(np.repeat(ids[low : low + 1000], len(selections))),
                    ],
                    names=["key", "choice", "id"],
                )

    return classes.select("id", "signature").mapInArrow(explode, "key long, choice int, id long")


def _near(pairs: DataFrame, classes: DataFrame, settings: Settings) -> DataFrame:
    """The pairs whose signatures are within the radius and whose sizes allow the similarity."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                differ = _slots(batch.column(2), settings.slots) != _slots(batch.column(3), settings.slots)
                near = differ.sum(axis=1) <= settings.radius
                yield batch.select([0, 1]).filter(pa.array(near))

    left = classes.select(F.col("id").alias("a"), F.col("signature").alias("sa"), F.col("n").alias("na"))
    right = classes.select(F.col("id").alias("b"), F.col("signature").alias("sb"), F.col("n").alias("nb"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .filter((100 * F.least("na", "nb") >= settings.share * F.greatest("na", "nb")))
        .select("a", "b", "sa", "sb")
        .mapInArrow(keep, "a long, b long")
    )


def _confirmed(pairs: DataFrame, classes: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """The pairs whose full sets reach the similarity. The texts of the classes in
    question are set apart first, so that the joins move only those."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keep = []
            for (left, nl), (right, nr) in zip(_each(batch.column(2)), _each(batch.column(3))):
                common = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(100 * common >= settings.share * (nl + nr - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    involved = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    chosen = _texts_of(involved, classes, texts, settings)
    return (
        pairs.join(chosen.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
        .join(chosen.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
        .select("a", "b", "ta", "tb")
        .mapInArrow(check, "a long, b long")
    )


def _texts_of(ids: DataFrame, classes: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """``(id, text)`` of the given classes, set apart from the other texts."""
    wanted = stored(classes.join(ids, "id").select(F.col("id").alias("doc_id"), "tag"), "wanted")
    if wanted.count() <= settings.broadcast_rows:
        wanted = F.broadcast(wanted)
    chosen = texts.join(wanted, ["doc_id", "tag"], "left_semi").select(F.col("doc_id").alias("id"), "text")
    return stored(chosen.dropDuplicates(["id"]), "texts")


def _each(column: pa.Array) -> Iterator[tuple[np.ndarray, int]]:
    for sets, size in shingle_sets(column):
        end = 0
        for n in size:
            yield sets[end : end + n], n
            end += n


def _units(large: DataFrame, settings: Settings) -> DataFrame:
    """What large buckets are compared by: ``(key, choice, size, id, component)``.

    A near-copy family meets in most of its keys, so its buckets hold each member
    many times. The buckets are joined over common members, and a joint family
    with a bounded number of members is one unit, of choice -1. The buckets of
    larger families stay units of their own.
    """
    families = stored(
        connected_components(large.select(F.col("id").alias("a"), F.col("pivot").alias("b"))), "families"
    ).toDF("id", "family")
    sizes = families.groupBy("family").agg(F.count("*").alias("members"))
    families = families.join(sizes, "family")
    joint = (
        large.select("id", "component")
        .distinct()
        .join(families.filter(F.col("members") <= settings.family), "id")
        .select(F.col("family").alias("key"), F.lit(-1).alias("choice"), F.col("members").alias("size"), "id", "component")
    )
    rest = large.join(families.filter(F.col("members") > settings.family), "id", "left_semi")
    return joint.union(rest.select("key", "choice", "size", "id", "component"))


def _cells(units: DataFrame, settings: Settings) -> DataFrame:
    """Units cut into cells. A cell is a pair of blocks of a unit, or one block with
    itself, so a task holds at most two blocks whatever the unit's size."""
    blocks = F.ceil(F.col("size") / settings.block).cast("int")
    return (
        units.withColumns({"blocks": blocks, "own": F.pmod(F.xxhash64("id"), blocks).cast("int")})
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("cell", F.least("own", "other") * F.col("blocks") + F.greatest("own", "other"))
        .select("key", "choice", "cell", "own", "id", "component")
    )


def _own_pairs(group: pa.Table, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """The places of pairs of a cell, closest first, between groups, within the
    radius, and, in a bucket, for which its key is the first one that both have."""
    component, own = group["component"].to_numpy(), group["own"].to_numpy()
    slots = _slots(group["signature"].combine_chunks(), settings.slots)
    choice, selections = int(group["choice"][0].as_py()), settings.selections()
    edges, chunk, before = np.array(settings.edges()), 0, []
    if choice >= 0:
        chunk = int(np.searchsorted(edges, selections[choice][0], side="right")) - 1
        before = [np.array(s) for s in selections[:choice] if s[0] >= edges[chunk]]
    enough = np.diff(edges)[:chunk] - settings.errors
    first, second = np.flatnonzero(own == own.min()), np.flatnonzero(own == own.max())
    found = []
    for i in first:
        other = second[(component[second] != component[i]) & ((second > i) | (own[second] != own[i]))]
        same = slots[other] == slots[i]
        near = settings.slots - same.sum(axis=1) <= settings.radius
        other, same = other[near], same[near]
        if chunk and len(other):
            fresh = (np.add.reduceat(same[:, : edges[chunk]], edges[:chunk], axis=1, dtype=np.int16) < enough).all(axis=1)
            other, same = other[fresh], same[fresh]
        for chosen in before:
            fresh = ~same[:, chosen].all(axis=1)
            other, same = other[fresh], same[fresh]
        if len(other):
            found.append(np.column_stack([same.sum(axis=1), np.full(len(other), i), other]))
    pairs = np.concatenate(found) if found else np.zeros((0, 3), dtype=np.int64)
    pairs = pairs[np.argsort(-pairs[:, 0], kind="stable")]
    return pairs[:, 1], pairs[:, 2]


def _across(unsettled: DataFrame, classes: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """Links within large buckets, confirmed on full sets where they are found: a cell
    yields links, not pairs, and skips pairs that its links have joined already. Texts
    go only to cells whose signatures leave something to confirm."""

    def needed(group: pa.Table) -> pa.Table:
        places = np.unique(np.concatenate(_own_pairs(group, settings)))
        return group.select(["key", "choice", "cell", "own", "id", "component", "signature"]).take(pa.array(places))

    def confirm(group: pa.Table) -> pa.Table:
        sets = [found for found, _ in _each(group["text"].combine_chunks())]
        leader = dict(zip(range(len(sets)), group["component"].to_pylist()))
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                x = root[x]
            return x

        links = []
        for i, j in zip(*_own_pairs(group, settings)):
            a, b = find(leader[i]), find(leader[j])
            if a != b:
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * common >= settings.share * (len(sets[i]) + len(sets[j]) - common):
                    root[max(a, b)] = min(a, b)
                    links.append((i, j))
        ids = group["id"].to_numpy()
        places = np.array(links, dtype=np.int64).reshape(-1, 2)
        return pa.table({"a": ids[places[:, 0]], "b": ids[places[:, 1]]})

    large = unsettled.filter(F.col("size") > settings.pairs_up_to)
    signed = _cells(_units(large, settings), settings).join(classes.select("id", "signature"), "id")
    columns = "key long, choice int, cell int, own int, id long, component long, signature binary"
    chosen = stored(signed.groupBy("key", "choice", "cell").applyInArrow(needed, columns), "cells")
    return (
        chosen.join(_texts_of(chosen.select("id").distinct(), classes, texts, settings), "id")
        .groupBy("key", "choice", "cell")
        .applyInArrow(confirm, "a long, b long")
    )


def _unsettled(buckets: DataFrame, links: DataFrame) -> DataFrame:
    """The buckets that hold several groups, with each member's group."""
    groups = stored(connected_components(links), "groups").withColumnRenamed("node", "id")
    component = F.coalesce("component", "id").alias("component")
    placed = buckets.join(groups, "id", "left").select("key", "choice", "pivot", "size", "id", component)
    several = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    return stored(placed.join(several.filter("low <> high").select("key"), "key"), "unsettled")


def _links(classes: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """Links between classes that connect all classes the threshold connects."""
    bucket = Window.partitionBy("key")
    buckets = stored(
        _keys(classes, settings)
        .withColumns({"pivot": F.min("id").over(bucket), "size": F.count("*").over(bucket)})
        .filter("size > 1"),
        "buckets",
    )
    tried = stored(
        buckets.filter("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct(), "tried"
    )
    links = stored(_confirmed(stored(_near(tried, classes, settings), "near"), classes, texts, settings), "links")

    unsettled = _unsettled(buckets, links)
    few = unsettled.filter(F.col("size") <= settings.pairs_up_to)
    pairs = (
        few.select("key", F.col("id").alias("a"), F.col("component").alias("ca"))
        .join(few.select("key", F.col("id").alias("b"), F.col("component").alias("cb")), "key")
        .filter("a > b and ca <> cb")
        .select("a", "b")
        .distinct()
        .join(tried, ["a", "b"], "left_anti")
    )
    rest = stored(_near(pairs, classes, settings), "rest")
    return links.union(_confirmed(rest, classes, texts, settings)).union(_across(unsettled, classes, texts, settings))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()
) -> DataFrame:
    """``(doc_id, n_shingles, class_id, component_id, kept)``, one row per document.

    ``class_id`` is the smallest id with the same set, ``component_id`` the smallest
    id reachable over links, and ``kept`` says that the row is that one. Ids are
    integers. A text that is null or has no words has an empty set: it is linked
    with nothing, is its own component and is kept. Rows that repeat an id are
    one document, whose set is that of the text with the largest hash. A row
    without an id takes part in nothing: its class and component are null, and it
    is kept. Other columns of ``docs`` are ignored, whatever their names.
    """
    texts = _texts(docs, id_col, text_col)
    signed = stored(signatures(docs, settings, id_col, text_col), "signatures")
    last = F.max(F.struct("tag", "n", "h1", "h2", "signature")).alias("row")
    each = signed.filter("doc_id is not null").groupBy("doc_id").agg(last).select("doc_id", "row.*")
    each = stored(each, "documents")
    filled = each.filter("n > 0")
    classes = stored(
        filled.groupBy("n", "h1", "h2")
        .agg(F.min("doc_id").alias("id"), F.min_by(F.struct("tag", "signature"), "doc_id").alias("row"))
        .select("n", "h1", "h2", "id", "row.*"),
        "classes",
    )
    named = filled.select("doc_id", "n", "h1", "h2").join(
        classes.select("n", "h1", "h2", F.col("id").alias("class_id")), ["n", "h1", "h2"]
    )
    groups = stored(connected_components(_links(classes, texts, settings)), "components")
    component = F.coalesce("component", "class_id")
    found = named.join(groups.withColumnRenamed("node", "class_id"), "class_id", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        "class_id",
        component.alias("component_id"),
        (F.col("doc_id") == component).alias("kept"),
    )
    alone = each.filter("n = 0").select("doc_id", "n").union(signed.filter("doc_id is null").select("doc_id", "n"))
    return found.union(
        alone.select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.col("doc_id").alias("class_id"),
            F.col("doc_id").alias("component_id"),
            F.lit(True).alias("kept"),
        )
    )


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near duplicates, its columns as
    they were. Of rows that repeat an id, all stay or all go."""
    gone = near_duplicates(docs, id_col, text_col).filter(~F.col("kept")).select(F.col("doc_id").alias(id_col))
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
