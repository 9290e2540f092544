"""Language-model scores of a Brown class model: class transitions and word emissions.

1. *Blocks.* One pass turns texts into blocks of about two million tokens: each block
   keeps its distinct words as hashes with their training counts, and its tokens
   as places in that dictionary. Later passes read blocks, never texts.
2. *Counts.* Words are dealt out to buckets by their hash. What a block says of its words
   in one bucket travels as one row of packed arrays, in the order of the hashes. There
   dictionary entries of all blocks meet by word, get the word's count over
   all training tokens, and go back to their block in the same order. A word takes part
   once a block, however often it occurs.
3. *Start.* The most frequent words are units of their own, all others fall into
   units by their last bytes, and exchange clustering moves units between classes.
   The number of classes follows the number of training words.
4. *Exchange.* In rounds, the counts of neighbouring classes of all training words
   are gathered, and each word moves to the class where the likelihood of the
   training bigrams gains most. A round counts only if the likelihood rises. Words
   unseen in training keep the class of their ending.
5. *Scores.* Each block is scored with its own counts and the class tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewash.llm.words import is_space_free, mixed, slices, utf8, words_of
from tablewash.session import discard, shuffles_dropped, stored

BLOCK_TOKENS = 1 << 21
FREQUENT = 256
ENDINGS = 256
# The fewest classes; beyond, the cube root of the number of training words.
CLASSES = 48
# A round of moves that adds less than this share of what all rounds added is the last.
LEAST_RISE = 0.1
# Pairs of classes that never met count as this share of what chance would give.
CHANCE = 0.02
# Dictionary entries of one bucket, on average; cells whose gains are weighed at a time.
BUCKET_ENTRIES = 150_000
MOVE_CELLS = 100_000
# A word may be a unit of its own if it is so large a share of some block.
FREQUENT_SHARE = 1e-4
PSEUDO_COUNT = 0.1
TRANSITION_PRIOR = 2.0
_END = np.uint64(0x5851F42D4C957F2D)
_BUCKET_SALT = np.uint64(0x2545F4914F6CDD1D)
END_UNIT = FREQUENT + ENDINGS
UNITS = END_UNIT + 1


def in_training(doc_id: Column) -> Column:
    """Whether a document is learned from: the checksum of its id is no multiple of 10."""
    held = F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(10)) == 0
    return ~F.coalesce(held, F.lit(False))


def _packed(values: np.ndarray, kind: str = "<u4") -> bytes:
    """Numbers as compressed planes of their bytes."""
    planes = values.astype(kind).view(np.uint8).reshape(len(values), -1).T if len(values) else values
    return pa.Codec("zstd").compress(planes.tobytes(), asbytes=True)


def _unpacked(data: bytes, n: int, kind: str = "<u4") -> np.ndarray:
    if not n:
        return np.zeros(0, dtype=np.int64)
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.Codec("zstd").decompress(data, size * n, asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).ravel().astype(np.int64)


def _tokens(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of the rows: token hashes with an end after each row, the unit of
    each token's ending, and the number of tokens of each row."""
    data, offsets = utf8(column)
    for low, high in slices(offsets):
        at = offsets[low : high + 1]
        words = words_of(data[at[0] : at[-1]], at - at[0], is_space_free())
        ending = np.zeros(len(words), dtype=np.uint64)
        for k in range(1, 4):
            place = words.end - k
            has = place >= words.start
            ending[has] = ending[has] * np.uint64(257) + words.data[place[has]].astype(np.uint64) + np.uint64(1)
        count = np.diff(words.first) + 1
        spot = np.arange(len(words)) + words.row
        hashes = np.full(len(words) + len(count), _END, dtype=np.uint64)
        units = np.full(len(hashes), END_UNIT, dtype=np.int64)
        hashes[spot] = words.hashes()
        units[spot] = FREQUENT + (mixed(ending) % np.uint64(ENDINGS)).astype(np.int64)
        yield hashes, units, count


_BLOCK = "block long, ids array<long>, train array<boolean>, sizes binary, words long, tokens binary, hashes binary, counts binary, units binary"


def blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per block of documents."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        number = total = 0

        def flush() -> pa.RecordBatch:
            ids, train = (pa.concat_arrays([h[k] for h in held]) for k in (0, 1))
            hashes, units, size = (np.concatenate([h[k] for h in held]) for k in (2, 3, 4))
            learned = np.repeat(train.to_numpy(zero_copy_only=False), size)
            names, first, place = np.unique(hashes, return_index=True, return_inverse=True)
            order = np.argsort(-np.bincount(place, minlength=len(names)), kind="stable")
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            counts = np.bincount(place, weights=learned, minlength=len(names))[order]
            row = [
                (TaskContext.get().partitionId() << 32) + number,
                ids.to_pylist(),
                train.to_pylist(),
                size.astype("<i8").tobytes(),
                len(names),
                _packed(rank[place]),
                names[order].tobytes(),
                counts.astype("<i8").tobytes(),
                units[first[order]].astype("<i2").tobytes(),
            ]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([value], kind)
                    for value, kind in zip(
                        row,
                        [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.int64(), *[pa.binary()] * 4],
                    )
                ],
                names=["block", "ids", "train", "sizes", "words", "tokens", "hashes", "counts", "units"],
            )

        for batch in batches:
            done = 0
            for hashes, units, size in _tokens(batch.column(2)):
                held.append(
                    (batch.column(0).slice(done, len(size)), batch.column(1).slice(done, len(size)), hashes, units, size)
                )
                done += len(size)
                total += len(hashes)
                if total >= BLOCK_TOKENS:
                    yield flush()
                    held, total = [], 0
                    number += 1
        if held:
            yield flush()

    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), in_training(F.col(id_col)).alias("train"), F.col(text_col).alias("text")
    )
    return rows.mapInArrow(build, _BLOCK)


def _dictionary(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    row = {name: batch.column(name)[k].as_py() for name in ("hashes", "counts", "units")}
    return (
        np.frombuffer(row["hashes"], dtype=np.uint64),
        np.frombuffer(row["counts"], dtype="<i8"),
        np.frombuffer(row["units"], dtype="<i2").astype(np.int64),
    )


def _dealt(hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """The buckets that hold words of a dictionary, and the places of these by rising hash."""
    bucket = (mixed(hashes ^ _BUCKET_SALT) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((hashes, bucket))
    held, first = np.unique(bucket[order], return_index=True)
    yield from zip(held.tolist(), np.split(order, first[1:]))


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema) if rows else schema.empty_table()


def _schema(*binaries: str) -> tuple[pa.Schema, str]:
    """The Arrow and Spark forms of rows of ``n`` entries of a block in a bucket."""
    numbers, names = ("block", "bucket", "n"), ", ".join(f"{b} binary" for b in binaries)
    fields = [(name, pa.int64()) for name in numbers] + [(name, pa.binary()) for name in binaries]
    return pa.schema(fields), f"block long, bucket long, n long, {names}"


def _entries(parts: DataFrame, buckets: int) -> DataFrame:
    """``(block, bucket, n, hashes, units, counts)``: the dictionary entries of all blocks."""
    schema, kinds = _schema("hashes", "units", "counts")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                hashes, counts, units = _dictionary(batch, k)
                block = batch.column("block")[k].as_py()
                rows = [
                    (block, b, len(p), _packed(hashes[p], "<u8"), _packed(units[p], "<u2"), _packed(counts[p], "<u4"))
                    for b, p in _dealt(hashes, buckets)
                ]
                yield from _rows(rows, schema).to_batches()

    return parts.select("block", "hashes", "counts", "units").mapInArrow(deal, kinds)


def _joined(rows: pa.Table, name: str, kind: str, sizes: np.ndarray | None = None) -> np.ndarray:
    """A packed column of several rows as one array; ``sizes`` if a row's is not ``n``."""
    n = rows["n"].to_numpy() if sizes is None else sizes
    return np.concatenate([_unpacked(data.as_py(), int(k), kind) for data, k in zip(rows[name], n)])


def _counted(entries: DataFrame, frequent: list[tuple[int, int]]) -> DataFrame:
    """``(block, bucket, n, units, counts, first)``: each entry's unit, its word's count over all training
    tokens, and whether it is the word's entry in the first block that has it."""
    names, number = _sorted_names(frequent)
    schema, kinds = _schema("units", "counts", "first")

    def count(group: pa.Table) -> pa.Table:
        group = group.sort_by("block")
        hashes = _joined(group, "hashes", "<i8")
        _, at, word = np.unique(hashes, return_index=True, return_inverse=True)
        total = np.bincount(word, weights=_joined(group, "counts", "<u4")).astype(np.int64)[word]
        first = np.zeros(len(hashes), dtype=np.int64)
        first[at] = 1
        units = _own_units(hashes.view(np.uint64), _joined(group, "units", "<u2"), names, number)
        ends = np.cumsum(group["n"].to_numpy())[:-1]
        parts = zip(*(np.split(x, ends) for x in (units, total, first)))
        rows = [
            (block, bucket, len(u), _packed(u, "<u2"), _packed(c, "<u8"), _packed(f, "<u1"))
            for block, bucket, (u, c, f) in zip(group["block"].to_pylist(), group["bucket"].to_pylist(), parts)
        ]
        return _rows(rows, schema)

    return entries.groupBy("bucket").applyInArrow(count, kinds)


def _words_by(rows: DataFrame, column: str, most: int) -> np.ndarray:
    """How many training words have each value of a packed column, each word counted at its first entry."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(most, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                rows = pa.Table.from_batches([batch])
                once = (_joined(rows, "first", "<u1") > 0) & (_joined(rows, "counts", "<u8") > 0)
                table += np.bincount(_joined(rows, column, "<u2")[once], minlength=most)
        held = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(table[held])], names=["value", "n"])

    found = rows.select("n", "first", "counts", column).mapInArrow(count, "value long, n long").groupBy("value").agg(F.sum("n").alias("n"))
    table = np.zeros(most)
    for r in found.collect():
        table[r["value"]] = r["n"]
    return table


def _started(counted: DataFrame, label: np.ndarray) -> DataFrame:
    """``(block, bucket, n, labels)``: the class of each entry's unit."""
    schema, kinds = _schema("labels")

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch[c].to_pylist() for c in ("block", "bucket", "n", "units")))
            made = [(block, bucket, n, _packed(label[_unpacked(units, n, "<u2")], "<u2")) for block, bucket, n, units in rows]
            yield from _rows(made, schema).to_batches()

    return counted.select("block", "bucket", "n", "units").mapInArrow(start, kinds)


def _frequent(parts: DataFrame) -> list[tuple[int, int]]:
    """Hash and ending unit of the words that are units of their own, by falling count."""

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                hashes, counts, units = _dictionary(batch, k)
                often = (counts >= max(2, FREQUENT_SHARE * counts.sum())) & (units != END_UNIT)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes[often].view(np.int64)), pa.array(units[often]), pa.array(counts[often])],
                    names=["hash", "unit", "count"],
                )

    found = parts.select("hashes", "counts", "units").mapInArrow(candidates, "hash long, unit long, count long")
    top = found.groupBy("hash", "unit").agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "hash").limit(FREQUENT)
    return [(r["hash"], r["unit"]) for r in top.collect()]


def _own_units(hashes: np.ndarray, units: np.ndarray, names: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Units of dictionary entries once the frequent words (sorted) have their own."""
    if not len(names):
        return units
    at = np.minimum(np.searchsorted(names, hashes), len(names) - 1)
    return np.where(names[at] == hashes, number[at], units)


def _sorted_names(frequent: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    names = np.array([h for h, _ in frequent], dtype=np.int64).view(np.uint64)
    number = np.argsort(names)
    return names[number], number


def _bigrams(parts: DataFrame, frequent: list[tuple[int, int]]) -> np.ndarray:
    """How often each unit follows each other one in training; a document follows an end."""
    names, number = _sorted_names(frequent)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(UNITS * UNITS, dtype=np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                hashes, _, units = _dictionary(batch, k)
                size = np.frombuffer(batch.column("sizes")[k].as_py(), dtype="<i8")
                stream = _own_units(hashes, units, names, number)[_unpacked(batch.column("tokens")[k].as_py(), int(size.sum()))]
                learned = np.repeat(np.array(batch.column("train")[k].as_py(), dtype=bool), size)
                before = np.concatenate([[END_UNIT], stream[:-1]])
                table += np.bincount((before * UNITS + stream)[learned], minlength=len(table))
        cells = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(table[cells])], names=["cell", "n"])

    rows = parts.select("train", "sizes", "tokens", "hashes", "counts", "units").mapInArrow(count, "cell long, n long")
    summed = rows.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(UNITS * UNITS, dtype=np.int64)
    table[summed["cell"].to_numpy()] = summed["n"].to_numpy()
    return table.reshape(UNITS, UNITS)


def exchange_classes(bigrams: np.ndarray, classes: int = CLASSES, passes: int = 30) -> np.ndarray:
    """A class per unit, the last unit (ends) alone in class 0.

    Starts with units dealt out by frequency. Each step takes a unit out of its class
    and puts it where the class bigrams' likelihood is largest, until a pass moves
    nothing.
    """

    def f(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1e-12))

    units = len(bigrams) - 1
    n = bigrams.astype(np.float64)
    order = np.argsort(-(n.sum(0) + n.sum(1))[:units], kind="stable")
    label = np.zeros(units + 1, dtype=np.int64)
    label[order] = 1 + np.arange(units) % (classes - 1)
    one = np.zeros((units + 1, classes))
    one[np.arange(units + 1), label] = 1
    pair = one.T @ n @ one
    for _ in range(passes):
        moved = 0
        for u in order:
            own = n[u, u]
            out = np.bincount(label, weights=n[u], minlength=classes)
            into = np.bincount(label, weights=n[:, u], minlength=classes)
            if not out.sum() + into.sum():
                continue
            a = label[u]
            out[a] -= own
            into[a] -= own
            pair[a] -= out
            pair[:, a] -= into
            pair[a, a] -= own
            # Gain of each class: its row and column with u, less without, marginals apart.
            row = f(pair + out[None, :]) - f(pair)
            column = f(pair + into[:, None]) - f(pair)
            diagonal = np.diag(pair)
            gain = row.sum(1) - np.diag(row) + column.sum(0) - np.diag(column)
            gain += f(diagonal + out + into + own) - f(diagonal)
            left, right = pair.sum(1), pair.sum(0)
            gain -= f(left + out.sum() + own) - f(left) + f(right + into.sum() + own) - f(right)
            gain[0] = -np.inf
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = int(a)
            pair[b] += out
            pair[:, b] += into
            pair[b, b] += own
            moved += b != a
            label[u] = b
        if not moved:
            break
    return label


@dataclass(frozen=True)
class Tables:
    """What scoring needs beside a word's count: for each unit its class, for each class
    the size and number of words, and the log10 transition probabilities."""

    label: np.ndarray
    class_count: np.ndarray
    class_words: np.ndarray
    transition: np.ndarray
    tokens: int
    words: int


def _tables(bigrams: np.ndarray, unit_words: np.ndarray, words: int, classes: int = CLASSES) -> Tables:
    label = exchange_classes(bigrams, classes)
    one = np.zeros((UNITS, classes))
    one[np.arange(UNITS), label] = 1
    return _class_tables(label, one.T @ bigrams @ one, unit_words @ one, words)


def _class_tables(label: np.ndarray, pair: np.ndarray, class_words: np.ndarray, words: int) -> Tables:
    count = pair.sum(0)
    prior = (count + 1) / (count.sum() + len(pair))
    transition = (pair + TRANSITION_PRIOR * prior) / (pair.sum(1, keepdims=True) + TRANSITION_PRIOR)
    return Tables(label, count, class_words, np.log10(transition), int(pair.sum()), words)


def likelihood(pair: np.ndarray) -> float:
    """The part of the training bigrams' log likelihood that depends on the classes."""

    def f(x: np.ndarray) -> float:
        return float((x * np.log(np.maximum(x, 1e-12))).sum())

    return f(pair) - f(pair.sum(0)) - f(pair.sum(1))


def _placed(hashes: np.ndarray, rows: pa.Table, buckets: int, *columns: tuple[str, str]) -> list[np.ndarray]:
    """Packed columns of a block's rows, one value per place of its dictionary."""
    at = {bucket: k for k, bucket in enumerate(rows["bucket"].to_pylist())}
    made = [np.zeros(len(hashes), dtype=np.int64) for _ in columns]
    for bucket, places in _dealt(hashes, buckets):
        for values, (name, kind) in zip(made, columns):
            values[places] = _unpacked(rows[name][at[bucket]].as_py(), len(places), kind)
    return made


def _neighbours(parts: DataFrame, labels: DataFrame, classes: int, buckets: int) -> DataFrame:
    """``(block, bucket, n, hashes, labels, sizes, cells, counts)``: how often the training tokens of each
    dictionary entry follow a token of each class (cells 0 to ``classes``) and precede one
    (cells from ``classes``). ``sizes`` has the number of an entry's cells."""
    schema, kinds = _schema("hashes", "labels", "sizes", "cells", "counts")

    def count(part: pa.Table, entries: pa.Table) -> pa.Table:
        found: list[tuple] = []
        for k in range(part.num_rows):
            size = np.frombuffer(part["sizes"][k].as_py(), dtype="<i8")
            hashes = np.frombuffer(part["hashes"][k].as_py(), dtype=np.uint64)
            (label,) = _placed(hashes, entries, buckets, ("labels", "<u2"))
            stream = _unpacked(part["tokens"][k].as_py(), int(size.sum()))
            learned = np.repeat(np.array(part["train"][k].as_py(), dtype=bool), size)
            kind = label[stream]
            before = np.concatenate([[0], kind[:-1]])
            follows = (stream * (2 * classes) + before)[learned]
            inner = np.flatnonzero(learned & (before > 0))
            precedes = stream[inner - 1] * (2 * classes) + classes + kind[inner]
            keys, n = np.unique(np.concatenate([follows, precedes]), return_counts=True)
            at = np.searchsorted(keys, np.arange(len(hashes) + 1) * (2 * classes))
            cell = keys % (2 * classes)
            for bucket, places in _dealt(hashes, buckets):
                sizes = at[places + 1] - at[places]
                pick = np.repeat(at[places] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                found.append(
                    (
                        part["block"][k].as_py(),
                        bucket,
                        len(places),
                        _packed(hashes[places], "<u8"),
                        _packed(label[places], "<u2"),
                        _packed(sizes, "<u2"),
                        _packed(cell[pick], "<u2"),
                        _packed(n[pick], "<u4"),
                    )
                )
        return _rows(found, schema)

    read = parts.select("block", "train", "sizes", "tokens", "hashes").groupBy("block")
    return read.cogroup(labels.select("block", "bucket", "labels").groupBy("block")).applyInArrow(count, kinds)


def _cells(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all entries of the rows of ``_neighbours`` their labels, and for all their cells: entry, cell and count."""
    sizes = [_unpacked(data.as_py(), n, "<u2") for data, n in zip(rows["sizes"], rows["n"].to_pylist())]
    held = np.array([x.sum() for x in sizes], dtype=np.int64)
    sizes = np.concatenate(sizes)
    entry = np.repeat(np.arange(len(sizes)), sizes)
    return _joined(rows, "labels", "<u2"), entry, _joined(rows, "cells", "<u2", held), _joined(rows, "counts", "<u4", held)


def _pairs(seen: DataFrame, classes: int) -> np.ndarray:
    """How often each class follows each other one in training."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(classes * classes)
        for batch in batches:
            for k in range(batch.num_rows):
                label, entry, cell, n = _cells(pa.Table.from_batches([batch.slice(k, 1)]))
                mine = cell < classes
                table += np.bincount(cell[mine] * classes + label[entry[mine]], weights=n[mine], minlength=len(table))
        held = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(table[held].astype(np.int64))], names=["cell", "n"])

    rows = seen.select("n", "labels", "sizes", "cells", "counts").mapInArrow(count, "cell long, n long")
    summed = rows.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    pair = np.zeros(classes * classes)
    pair[summed["cell"].to_numpy()] = summed["n"].to_numpy()
    return pair.reshape(classes, classes)


def best_classes(word: np.ndarray, cell: np.ndarray, n: np.ndarray, label: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """The class of each word where the likelihood gains most, by what it gains for each
    neighbour; a word's own class is judged without the word. ``cell`` and ``n`` are the classes
    before (from ``classes``: after) each ``word``, words rising, and how often they are."""
    classes = len(pair)
    left, right, total = pair.sum(1), pair.sum(0), max(pair.sum(), 1.0)

    def ratio(n: np.ndarray, expected: np.ndarray) -> np.ndarray:
        expected = np.maximum(expected, 1e-9)
        return np.log(np.maximum(n, 0) / expected + CHANCE)

    weights = ratio(pair, np.outer(left, right) / total)
    weights = np.concatenate([weights, weights.T])
    into = cell < classes
    other, mine = np.where(into, cell, cell - classes), label[word]
    size = np.bincount(word[into], weights=n[into], minlength=len(label)), np.bincount(word[~into], weights=n[~into], minlength=len(label))
    met = np.where(into, pair[other, mine], pair[mine, other]) - n
    alone = np.where(into, left[other] * (right[mine] - size[0][word]), (left[mine] - size[1][word]) * right[other]) / total
    own = np.bincount(word, weights=n * ratio(met, alone), minlength=len(label))
    best = label.copy()
    held, first = np.unique(word, return_index=True)
    first = np.append(first, len(word))
    low = 0
    while low < len(held):
        high = max(low + 1, int(np.searchsorted(first, first[low] + MOVE_CELLS, side="right")) - 1)
        at = slice(first[low], first[high])
        gain = np.add.reduceat(weights[cell[at]] * n[at, None], first[low:high] - first[low])
        some = held[low:high]
        rows = np.arange(len(some))
        gain[rows, label[some]] = own[some]
        gain[:, 0] = -np.inf
        found = gain.argmax(1)
        moves = (label[some] > 0) & (gain[rows, found] > own[some] + 1e-9)
        best[some] = np.where(moves, found, label[some])
        low = high
    return best


def _moved(seen: DataFrame, pair: np.ndarray, share: float, salt: int) -> DataFrame:
    """``(block, bucket, n, labels)`` after a share of the words went to their best classes."""
    classes = len(pair)
    shared = seen.sparkSession.sparkContext.broadcast(pair)
    schema, kinds = _schema("labels")

    def move(group: pa.Table) -> pa.Table:
        names, word = np.unique(_joined(group, "hashes", "<i8"), return_inverse=True)
        labels, entry, cell, n = _cells(group)
        label = np.zeros(len(names), dtype=np.int64)
        label[word] = labels
        # The cells of a word from all its blocks are one.
        keys, place = np.unique(word[entry] * (2 * classes) + cell, return_inverse=True)
        summed = np.bincount(place, weights=n, minlength=len(keys))
        new = best_classes(keys // (2 * classes), keys % (2 * classes), summed, label, shared.value)
        draw = mixed(names.view(np.uint64) + np.uint64(salt)) % np.uint64(1024)
        new = np.where(draw < 1024 * share, new, label)[word]
        parts = np.split(new, np.cumsum(group["n"].to_numpy())[:-1])
        rows = zip(group["block"].to_pylist(), group["bucket"].to_pylist(), parts)
        return _rows([(block, bucket, len(x), _packed(x, "<u2")) for block, bucket, x in rows], schema)

    return seen.groupBy("bucket").applyInArrow(move, kinds)


def _exchanged(parts: DataFrame, labels: DataFrame, classes: int, buckets: int) -> tuple[DataFrame, np.ndarray]:
    """Labels of all dictionary entries, and the pairs of classes, once moves of words
    between classes no longer raise the likelihood much. Of the neighbours one generation is
    kept: after a round that lost, they are counted again from the labels."""
    seen = stored(_neighbours(parts, labels, classes, buckets), "neighbours")
    pair = _pairs(seen, classes)
    gained, share, salt = 0.0, 1.0, 0
    # After a round that lost, fewer words move at a time.
    while pair.sum() and share >= 0.25:
        salt += 1
        if seen is None:
            seen = stored(_neighbours(parts, labels, classes, buckets), "neighbours")
        moved = stored(_moved(seen, pair, share, salt), "labels")
        discard(seen)
        seen = stored(_neighbours(parts, moved, classes, buckets), "neighbours")
        after = _pairs(seen, classes)
        rise = likelihood(after) - likelihood(pair)
        if rise <= 0:
            share /= 2
            discard(moved)
            discard(seen)
            seen = None
            continue
        discard(labels)
        labels, pair = moved, after
        gained += rise
        if rise < LEAST_RISE * gained:
            break
    if seen is not None:
        discard(seen)
    return labels, pair


def class_model_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``, one row
    per row of ``docs``; scores are log10 probabilities of whole texts.

    ``score`` is the class model's: the sum over tokens of the log of the class given
    the class before (the first token follows an end) and of the word given its
    class. Each class keeps a share for words it has not seen. ``base_score`` is that of
    single words. ``perplexity`` is 10 to the minus score per token. A null text is
    empty: one end. A row with a null id is learned from and has a null id in the
    result; repeated rows are learned from and scored each. Other columns are
    ignored, and an empty table gives no rows.
    """
    spark = docs.sparkSession
    with shuffles_dropped(spark):
        parts = stored(blocks(docs, id_col, text_col), "blocks")
        frequent = _frequent(parts)
        bigrams = _bigrams(parts, frequent)
        buckets = max(1, -(-(parts.agg(F.sum("words")).first()[0] or 0) // BUCKET_ENTRIES))
        counted = stored(_counted(_entries(parts, buckets), frequent), "counted")
        unit_words = _words_by(counted, "units", UNITS)
        words = int(unit_words.sum())
        classes = max(CLASSES, round(words ** (1 / 3)))
        start = _tables(bigrams, unit_words, words, classes)
        labels, pair = _exchanged(parts, stored(_started(counted, start.label), "labels"), classes, buckets)
        entries = stored(counted.select("block", "bucket", "n", "counts", "first").join(labels.drop("n"), ["block", "bucket"]), "entries")
        class_words = _words_by(entries, "labels", classes)
    tables = spark.sparkContext.broadcast(_class_tables(start.label, pair, class_words, words))

    def score(part: pa.Table, entries: pa.Table) -> pa.Table:
        t = tables.value
        found: list[pa.Table] = []
        for k in range(part.num_rows):
            hashes = np.frombuffer(part["hashes"][k].as_py(), dtype=np.uint64)
            count, label = _placed(hashes, entries, buckets, ("counts", "<u8"), ("labels", "<u2"))
            base = np.log10((count + PSEUDO_COUNT) / (t.tokens + PSEUDO_COUNT * (t.words + 1)))
            emission = np.log10((count + PSEUDO_COUNT) / (t.class_count[label] + PSEUDO_COUNT * (t.class_words[label] + 1)))
            size = np.frombuffer(part["sizes"][k].as_py(), dtype="<i8")
            stream = _unpacked(part["tokens"][k].as_py(), int(size.sum()))
            classes = label[stream]
            before = np.concatenate([[t.label[END_UNIT]], classes[:-1]])
            at = np.cumsum(size) - size
            train = np.array(part["train"][k].as_py(), dtype=bool)
            found.append(
                pa.table(
                    {
                        "doc_id": pa.array(part["ids"][k].as_py(), pa.int64()),
                        "held_out": ~train,
                        "n_tokens": size.astype(np.int64),
                        "n_known": np.add.reduceat((count > 0)[stream].astype(np.int64), at),
                        "train_tokens": np.full(len(size), t.tokens, dtype=np.int64),
                        "base_score": np.add.reduceat(base[stream], at),
                        "score": np.add.reduceat(emission[stream] + t.transition[before, classes], at),
                    }
                )
            )
        return pa.concat_tables(found)

    read = parts.select("block", "ids", "train", "sizes", "tokens", "hashes").groupBy("block")
    scored = read.cogroup(entries.select("block", "bucket", "counts", "labels").groupBy("block")).applyInArrow(
        score,
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
