"""Benchmark decontamination with suffix arrays over shards of the documents.

Each task cuts its rows into shards of some megabytes, sorts the suffixes of a
shard's word sequence and binary-searches every window of the benchmark items in
it (ten consecutive words, or the whole of a shorter item). That gives the range of
suffixes that begin with it, which are all its places in the shard. The items'
own suffixes are sorted as well, and every place of a row is searched among them:
that gives the longest verbatim match that begins there.

Words are compared by their 64-bit hashes. A word that no item has ends every
match, so suffixes that reach such a word before the shortest window are left
out of a shard's array: no window can begin there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewash.errors import StepError
from tablewash.llm.words import is_letter_or_digit, slices, utf8, words_of

WINDOW = 10
SHARD_BYTES = 4 << 20
# The items, as hashes, are held by every task. A larger benchmark is cut into
# parts of this size, each searched in turn by a stage of the same pass.
PART_BYTES = 64 << 20


@dataclass
class Benchmark:
    """Items as word codes. ``words`` is the sorted vocabulary; a code is a place in
    it plus one. ``start`` and ``stop`` are those of every item suffix, and ``array``
    sorts the suffixes, for whose places ``owner`` has the item."""

    words: np.ndarray
    codes: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    item: np.ndarray
    whole: np.ndarray
    names: list[str]
    shortest: int
    array: Shard
    owner: np.ndarray


def _benchmark(names: list[str], texts: list[str | None], window: int) -> Benchmark:
    data, offsets = utf8(pa.array(texts, pa.large_string()))
    words = words_of(data, offsets, is_letter_or_digit())
    hashes = words.hashes()
    vocabulary, codes = np.unique(hashes, return_inverse=True)
    count = np.diff(words.first)
    start = np.arange(len(hashes))
    stop = words.first[words.row + 1]
    # One stop after each item.
    apart = np.zeros(len(hashes) + len(count) + 1, dtype=np.int64)
    apart[start + words.row] = codes + 1
    return Benchmark(
        words=vocabulary,
        codes=codes + 1,
        start=start,
        stop=stop,
        item=words.row,
        # The length of the window that starts here, 0 if none does.
        whole=np.where(stop - start >= window, window, np.where(start == words.first[words.row], stop - start, 0)),
        names=names,
        shortest=int(min(window, count[count > 0].min())) if len(hashes) else 0,
        array=Shard(apart, 1, int(count.max(initial=1))),
        owner=np.repeat(np.arange(len(count)), count + 1),
    )


def _ranks(codes: np.ndarray, depth: int) -> np.ndarray:
    """The order number of each place's next ``depth`` codes, by doubling."""
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64) + 1
    rank[codes == 0] = 0
    done = 1
    while done < depth:
        step = min(done, depth - done)
        ahead = np.zeros_like(rank)
        ahead[: len(rank) - step] = rank[step:]
        pair = rank * (int(rank.max(initial=0)) + 1) + ahead
        rank = np.unique(pair, return_inverse=True)[1]
        done += step
    return rank


class Shard:
    """A suffix array over the word codes of some rows, 0 between rows and for
    words outside the benchmark."""

    def __init__(self, codes: np.ndarray, shortest: int, depth: int):
        stops = np.flatnonzero(codes == 0)
        place = np.flatnonzero(codes)
        run = stops[np.searchsorted(stops, place)] - place
        place, run = place[run >= shortest], run[run >= shortest]
        # Only stretches that hold a suffix take part in the sort.
        near = np.zeros(len(codes) + 1, dtype=np.int64)
        np.add.at(near, place, 1)
        np.add.at(near, place + run, -1)
        held = np.flatnonzero((np.cumsum(near)[:-1] > 0) | (codes == 0))
        ranks = np.zeros(len(codes), dtype=np.int64)
        ranks[held] = _ranks(codes[held], depth) if len(held) else 0
        self.codes = codes
        self.suffixes = place[np.argsort(ranks[place], kind="stable")]

    def ranges(self, query: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query part, the range of suffixes that begin with it."""
        return self._bound(query, start, length, False), self._bound(query, start, length, True)

    def _bound(self, query: np.ndarray, start: np.ndarray, length: np.ndarray, after: bool) -> np.ndarray:
        low, high = np.zeros(len(start), dtype=np.int64), np.full(len(start), len(self.suffixes), dtype=np.int64)
        while (active := np.flatnonzero(low < high)).size:
            middle = (low[active] + high[active]) // 2
            sign = self._compare(self.suffixes[middle], query, start[active], length[active])
            right = sign < 0 if not after else sign <= 0
            low[active[right]] = middle[right] + 1
            high[active[~right]] = middle[~right]
        return low

    def _compare(self, place: np.ndarray, query: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Minus one, 0 or 1: the suffix is below the part, begins with it, or is above."""
        sign = np.zeros(len(place), dtype=np.int64)
        k, left = 0, np.arange(len(place))
        while (left := left[(sign[left] == 0) & (length[left] > k)]).size:
            mine = self.codes[np.minimum(place[left] + k, len(self.codes) - 1)]
            sign[left] = np.sign(mine - query[start[left] + k])
            k += 1
        return sign

    def longest(self, query: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query suffix, the length of its longest match and a place of it: a
        neighbour of the suffix's own place in the array has it."""
        at = self._bound(query, start, stop - start, False)
        best, where = np.zeros(len(start), dtype=np.int64), np.full(len(start), -1, dtype=np.int64)
        if len(self.suffixes):
            for place in (self.suffixes[np.maximum(at - 1, 0)], self.suffixes[np.minimum(at, len(self.suffixes) - 1)]):
                k, alive = 0, np.arange(len(start))
                length = np.zeros(len(start), dtype=np.int64)
                while (alive := alive[start[alive] + k < stop[alive]]).size:
                    mine = self.codes[np.minimum(place[alive] + k, len(self.codes) - 1)]
                    alive = alive[mine == query[start[alive] + k]]
                    length[alive] += 1
                    k += 1
                better = length > best
                best[better], where[better] = length[better], place[better]
        return best, where


def _longest(codes: np.ndarray, row_of: np.ndarray, bench: Benchmark) -> Iterator[tuple[int, int, int, int]]:
    """Row, item, place and words of the longest match of each row that has any: the
    first such place in the row, and the first item that matches there."""
    place = np.flatnonzero(codes)
    if not len(place):
        return
    stops = np.flatnonzero(codes == 0)
    length, _ = bench.array.longest(codes, place, stops[np.searchsorted(stops, place)])
    row = row_of[place]
    rows, first, at = np.unique(row, return_index=True, return_inverse=True)
    top = np.flatnonzero(length == np.maximum.reduceat(length, first)[at])
    top = top[np.unique(row[top], return_index=True)[1]]
    lo, hi = bench.array.ranges(codes, place[top], length[top])
    ranges, of = np.unique(np.stack([lo, hi], axis=1), axis=0, return_inverse=True)
    owners = np.append(bench.owner[bench.array.suffixes], len(bench.names))
    item = np.minimum.reduceat(owners, ranges.ravel())[::2][of.ravel()]
    yield from zip(rows.tolist(), item.tolist(), place[top].tolist(), length[top].tolist())


def _search(column: pa.Array, bench: Benchmark) -> Iterator[list[tuple]]:
    """Per shard, for each row: words, hit words, matches ``(item, first word, words)``
    of whole windows, and the row's longest match ``(item, first word, words)``."""
    data, offsets = utf8(column)
    for low, high in slices(offsets, SHARD_BYTES):
        at = offsets[low : high + 1]
        words = words_of(data[at[0] : at[-1]], at - at[0], is_letter_or_digit())
        count = np.diff(words.first)
        rows = [(int(n), 0, [], None) for n in count]
        if len(words) and len(bench.words):
            hashes = words.hashes()
            place = np.minimum(np.searchsorted(bench.words, hashes), len(bench.words) - 1)
            # One stop after each row.
            spot = np.arange(len(hashes)) + words.row
            codes = np.zeros(len(hashes) + len(count) + 1, dtype=np.int64)
            codes[spot] = np.where(bench.words[place] == hashes, place + 1, 0)
            shard = Shard(codes, bench.shortest, int((bench.stop - bench.start).max()))
            row_of = np.repeat(np.arange(len(count)), count + 1)
            first = words.first[:-1] + np.arange(len(count))
            if len(shard.suffixes):
                parts = np.flatnonzero(bench.whole)
                lo, hi = shard.ranges(bench.codes, bench.start[parts], bench.whole[parts])
                found = parts[hi > lo]
                spread = (hi - lo)[hi > lo]
                part = np.repeat(found, spread)
                step = np.arange(len(part)) - np.repeat(np.cumsum(spread) - spread, spread)
                begin = shard.suffixes[np.repeat(lo[hi > lo], spread) + step]
                length = bench.whole[part]
                depth = np.zeros(len(codes) + 1, dtype=np.int64)
                np.add.at(depth, begin, 1)
                np.add.at(depth, begin + length, -1)
                hit = np.flatnonzero(np.cumsum(depth)[:-1])
                hits = np.bincount(row_of[hit], minlength=len(count))
                for p, b, n in zip(part, begin, length):
                    r = row_of[b]
                    rows[r][2].append((int(bench.item[p]), int(b - first[r]), int(n)))
                for r in np.flatnonzero(hits):
                    rows[r] = (rows[r][0], int(hits[r]), rows[r][2], None)
            for r, item, place, n in _longest(codes, row_of, bench):
                rows[r] = (*rows[r][:3], (item, place - int(first[r]), n))
        yield rows


def benchmark_overlap(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    part_bytes: int = PART_BYTES,
    with_text: bool = True,
) -> DataFrame:
    """``docs``, less the text if so asked, with ``n_words``, ``n_hit``, ``items``, ``spans`` and ``longest``.

    Words are runs of ASCII letters and digits and of characters beyond ASCII, with
    A-Z in lower case. ``n_hit`` counts words inside any place of a window; ``items``
    are the ids (as text, sorted, distinct) of the items that have such a window;
    ``spans`` are merged ranges ``first`` and ``words`` of hit words; ``longest`` is
    the longest run of words that this row has in common with an item, whether or not
    it holds a window: the first of that length in the row, in the item with the
    smallest id. It is null if no word is in any item. A null text has no words; items without words or with a
    null id are never found, and repeated items count once. An empty benchmark hits
    nothing. Columns of ``docs`` with the result's names are replaced.
    """
    items = (
        benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text"))
        .filter("item is not null and text is not null")
        .distinct()
    )
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // part_bytes))
    result = docs
    for part in range(parts):
        mine = items if parts == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part)
        rows = sorted(mine.collect())
        bench = _benchmark([r["item"] for r in rows], [r["text"] for r in rows], window)
        result = _overlap(result, bench, text_col, part == 0, with_text or part < parts - 1)
    return result


_FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField(
            "spans", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("words", T.LongType())]))
        ),
        T.StructField(
            "longest",
            T.StructType(
                [
                    T.StructField("item", T.StringType()),
                    T.StructField("first", T.LongType()),
                    T.StructField("words", T.LongType()),
                ]
            ),
        ),
    ]
)
_ARROW = {
    "n_words": pa.int64(),
    "n_hit": pa.int64(),
    "items": pa.list_(pa.string()),
    "spans": pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())])),
    "longest": pa.struct([("item", pa.string()), ("first", pa.int64()), ("words", pa.int64())]),
}


def _merged(spans: list[tuple[int, int]]) -> list[dict]:
    merged: list[list[int]] = []
    for first, words in sorted(spans):
        if merged and first <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], first + words)
        else:
            merged.append([first, first + words])
    return [{"first": a, "words": b - a} for a, b in merged]


def _overlap(docs: DataFrame, bench: Benchmark, text_col: str, first: bool, with_text: bool) -> DataFrame:
    if text_col in _FOUND.names:
        raise StepError("invalidColumnId", f"the text column can't be named {text_col}")
    names = [c for c in docs.columns if c.lower() not in _FOUND.names]
    held = names if first else names + list(_FOUND.names)
    kept = [k for k, c in enumerate(names) if with_text or c != text_col]
    shared = docs.sparkSession.sparkContext.broadcast(bench)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = shared.value
        for batch in batches:
            done = 0
            for rows in _search(batch.column(names.index(text_col)), bench):
                part = batch.slice(done, len(rows))
                found: dict[str, list] = {k: [] for k in _ARROW}
                for k, (n, _, matches, top) in enumerate(rows):
                    items = {bench.names[i] for i, _, _ in matches}
                    spans = [(a, m) for _, a, m in matches]
                    longest = top and {"item": bench.names[top[0]], "first": top[1], "words": top[2]}
                    if not first:
                        items |= set(part.column(len(names) + 2)[k].as_py())
                        spans += [(s["first"], s["words"]) for s in part.column(len(names) + 3)[k].as_py()]
                        both = [x for x in (longest, part.column(len(names) + 4)[k].as_py()) if x]
                        longest = min(both, key=lambda x: (-x["words"], x["first"], x["item"]), default=None)
                    merged = _merged(spans)
                    for key, value in zip(_ARROW, (n, sum(s["words"] for s in merged), sorted(items), merged, longest)):
                        found[key].append(value)
                done += len(rows)
                columns = [part.column(k) for k in kept]
                columns += [pa.array(found[k], kind) for k, kind in _ARROW.items()]
                yield pa.RecordBatch.from_arrays(columns, names=[*(names[k] for k in kept), *_ARROW])

    fields = docs.select(*names).schema.fields
    schema = T.StructType([*(fields[k] for k in kept), *_FOUND.fields])
    return docs.select(*held).mapInArrow(search, schema)


def without_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that hold any window of the benchmark, its columns as they were."""
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text"))
    return benchmark_overlap(row, benchmark, with_text=False).filter("n_hit = 0").select("row.*")
