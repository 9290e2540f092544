"""Spelling variants: words one edit apart, found by dynamic programming over sorted lists.

1. *Words.* Each task counts the words of its texts and passes on sums, which are added
   up by word.
2. *Lists.* Two words one edit apart share the first half of the shorter one, or its
   second half. So each word joins the list of its first half, and, spelled
   backwards, that of its second. Words of a list that may be the longer one of such a
   pair join the list of the half that a shorter partner would have.
3. *Scan.* A list is sorted. For a word, the rows of the edit matrix against the list's words
   are computed in a band two cells wide, one row per letter. The next word of the
   list reuses the rows of the prefix that it shares with the one before (their LCP). Where
   all cells of a row exceed one edit, all words with that prefix are skipped at once.
4. *Forms.* A word's form is its commonest near word, if common enough; roots follow forms
   by pointer jumping, in rounds as many as the logarithm of the longest chain.

Lists of more than LIST_WORDS words are dealt into pieces by the words' hashes; each word of
the list is looked up in every piece, so no task holds more than a piece at a time.
"""

from __future__ import annotations

import re
from collections import _count_elements
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewash.session import stored

# Runs are cut from UTF-8: letters of ASCII are lower-cased and all else of it parts runs; of longer
# forms only those of U+00C0 to U+00FF, which begin with the byte C3, are letters.
SEPARATED = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0x80 else 0x20 for c in range(256))
OTHER_FORMS = re.compile(rb"[\xC2\xC4-\xF4][\x80-\xBF]+")
# One run in so many loses a letter, by the checksum of its document and itself.
DAMAGED = 97
LEAST_LENGTH = 5
LEAST_COUNT = 3
# A form is so many times as common as the word.
FORM_TIMES = 2
# Distinct words that a task counts before it passes them on, and bytes of texts.
COUNTED_AT_A_TIME = 200_000
BYTES_AT_A_TIME = 64 << 20
# Rows that a task scans together, in whole lists, and words of a piece of a list.
ROWS_AT_A_TIME = 50_000
LIST_WORDS = 20_000


def runs_of(text: str) -> list[bytes]:
    """The runs of letters of a text, lower-cased, of at least LEAST_LENGTH bytes."""
    data = text.encode()
    if not text.isascii():
        data = OTHER_FORMS.sub(b" ", data)
    return [run for run in data.translate(SEPARATED).split() if len(run) >= LEAST_LENGTH]


def add_words(seen: dict[bytes, int], doc_id: str, text: str) -> None:
    """Count the words of a text in ``seen``. A run loses a letter if DAMAGED divides the checksum of
    ``<doc_id>:`` and the run."""
    runs = runs_of(text)
    _count_elements(seen, runs)
    prefix = crc32(f"{doc_id}:".encode())
    for run in set(runs):
        h = crc32(run, prefix)
        if h % DAMAGED == 0:
            letters = run.decode()
            k, n = h % len(letters), runs.count(run)
            word = (letters[:k] + letters[k + 1 :]).encode()
            seen[run] -= n
            seen[word] = seen.get(word, 0) + n


def counted_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(word, n)`` for the words of at least LEAST_LENGTH code points and LEAST_COUNT occurrences."""

    def rows(seen: dict[bytes, int]) -> pa.RecordBatch:
        words = pa.array(seen.keys(), pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(seen.values(), pa.int64())], names=["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                add_words(seen, doc_id, text)
                size += len(text)
                if len(seen) >= COUNTED_AT_A_TIME or size >= BYTES_AT_A_TIME:
                    yield rows(seen)
                    seen, size = {}, 0
        yield rows(seen)

    texts = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit("")))
    counted = texts.mapInArrow(count, "word string, n long").filter(F.length("word") >= LEAST_LENGTH)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


# A banded row has the edits between a list word's first d letters and the first d - 1 and d of
# the word looked up. List words are as long or one letter longer, so other cells exceed one
# edit. The two cells are 1 and 0 while all letters agree, then 1 and 1, 1 and more, or more and 1.
EXACT, BOTH, BEHIND, LEVEL, DEAD = range(5)


class SortedList:
    """Sorted distinct words that share their first ``shared`` letters."""

    def __init__(self, words: list[str], shared: int):
        self.words, self.shared = words, shared
        n = len(words)
        # Letters that each word shares with the one before; none with what is behind the list.
        self.lcp = lcp = [0] * (n + 1)
        for k in range(1, n):
            a, b = words[k - 1], words[k]
            most, d = min(len(a), len(b)), shared
            while d < most and a[d] == b[d]:
                d += 1
            lcp[k] = d
        # The next place whose word shares fewer letters with the one before it.
        self.fewer = fewer = [n] * (n + 1)
        open_: list[int] = []
        for k in range(1, n + 1):
            while open_ and lcp[open_[-1]] > lcp[k]:
                fewer[open_.pop()] = k
            open_.append(k)

    def near(self, word: str) -> list[int]:
        """The places of words that ``word`` becomes by replacing or inserting one letter, all of
        which share the first ``shared`` letters with it."""
        words, lcp, fewer, n, shared = self.words, self.lcp, self.fewer, len(self.words), self.shared
        size, found = len(word), []
        padded = word + "\0\0"
        rows = [EXACT] * (size + 3)
        k, d = 0, shared
        while k < n:
            other = words[k]
            row, end = rows[d], len(other)
            while d < end:
                c = other[d]
                if row == EXACT:
                    if c != padded[d]:
                        row = BOTH
                elif row == LEVEL:
                    if c != padded[d]:
                        row = DEAD
                elif row == BEHIND:
                    if c != padded[d - 1]:
                        row = DEAD
                elif c == padded[d]:
                    row = BOTH if c == padded[d - 1] else LEVEL
                else:
                    row = BEHIND if c == padded[d - 1] else DEAD
                d += 1
                if row == DEAD or d > size + 1:
                    row = DEAD
                    break
                rows[d] = row
            k += 1
            if row != DEAD:
                # The whole word is in the second cell, or in the first if it is the shorter one.
                if end == size and (row == LEVEL or row == BOTH) or end == size + 1 and row != LEVEL:
                    found.append(k - 1)
            else:
                while lcp[k] >= d:
                    k = fewer[k]
            d = max(lcp[k], shared)
        return found


def scanned_list(kind: int, shared: int, words: list[str], n: list[int], listed: list[bool], asks: list[bool]):
    """Pairs ``(word, near, n of near)``, both ways, from a sorted list and the words looked up in it."""
    chosen = [k for k, is_listed in enumerate(listed) if is_listed]
    sorted_list = SortedList([words[k] for k in chosen], shared)
    for k, asked in enumerate(asks):
        if not asked:
            continue
        word = words[k]
        for place in sorted_list.near(word):
            j = chosen[place]
            other = words[j]
            # Each pair once: from the shorter word, or else from the one that sorts first ...
            if len(other) == len(word) and other < word:
                continue
            a, b = (word, other) if kind == 0 else (word[::-1], other[::-1])
            # ... and among the words' ends only if their beginnings differ.
            if kind == 1 and a[: len(a) // 2] == b[: len(a) // 2]:
                continue
            yield a, b, n[j]
            yield b, a, n[k]


def _members(words: DataFrame) -> DataFrame:
    """``(kind, key, word, n, asks)``: the lists of each word, which ``asks`` in those of its own halves."""
    size, backwards = F.length("word"), F.reverse("word")
    half, rest = F.expr("length(word) div 2"), F.expr("(length(word) + 1) div 2")

    def member(kind: int, word: Column, shared: Column, asks: bool) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.substring(word, F.lit(1), shared).alias("key"), word.alias("word"), F.lit(asks).alias("asks"))

    lists = [
        member(0, F.col("word"), half, True),
        F.when(size % 2 == 0, member(0, F.col("word"), half - 1, False)),
        member(1, backwards, rest, True),
        F.when(size % 2 == 1, member(1, backwards, rest - 1, False)),
    ]
    return words.select("n", F.explode(F.array(*lists)).alias("m")).filter("m is not null").select("m.kind", "m.key", "m.word", "n", "m.asks")


def near_words(words: DataFrame, list_words: int = LIST_WORDS) -> DataFrame:
    """``(word, near, n)`` for all pairs of ``words (word, n)`` one edit apart, both ways; ``n`` is that of ``near``."""
    members = _members(words)
    long = members.groupBy("kind", "key").agg(F.count("*").alias("size")).filter(F.col("size") > list_words)
    pieces = F.ceil(F.coalesce("size", F.lit(1)) / list_words)
    own = F.pmod(F.xxhash64("word"), F.col("pieces")).cast("int")
    dealt = (
        members.join(long, ["kind", "key"], "left")
        .withColumn("pieces", pieces)
        .withColumn("own", own)
        .withColumn("piece", F.explode(F.when(F.col("asks"), F.sequence(F.lit(0), (F.col("pieces") - 1).cast("int"))).otherwise(F.array("own"))))
        .select("kind", "key", "piece", "word", "n", (F.col("piece") == F.col("own")).alias("listed"), "asks")
    )
    placed = dealt.repartition("kind", "key", "piece").sortWithinPartitions("kind", "key", "piece", "word")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_lists(batches):
            pairs = []
            for first, last in rows.bounds:
                kind, key = rows.kinds[first], rows.keys[first]
                part = slice(first, last)
                pairs += scanned_list(kind, len(key), rows.words[part], rows.n[part], rows.listed[part], rows.asks[part])
            if pairs:
                a, b, n = zip(*pairs)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(n, pa.int64())], names=["word", "near", "n"])

    return placed.mapInArrow(scan, "word string, near string, n long")


class Rows:
    """Columns of some whole lists, and where each list begins and ends."""

    def __init__(self, table: pa.Table):
        self.kinds, self.keys, pieces, self.words, self.n, self.listed, self.asks = (c.to_pylist() for c in table.columns)
        edges = [k for k in range(1, len(pieces)) if (self.kinds[k], self.keys[k], pieces[k]) != (self.kinds[k - 1], self.keys[k - 1], pieces[k - 1])]
        self.bounds = list(zip([0, *edges], [*edges, len(pieces)]))


def whole_lists(batches: Iterator[pa.RecordBatch], rows: int = ROWS_AT_A_TIME) -> Iterator[Rows]:
    """Sorted batches regrouped, so that no list is cut; at least ``rows`` rows where there are so many."""

    def same_list(a: pa.RecordBatch, i: int, b: pa.RecordBatch, j: int) -> bool:
        return all(a.column(c)[i].as_py() == b.column(c)[j].as_py() for c in range(3))

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if sum(b.num_rows for b in held) >= rows:
            # The first row of another list than the last one held; all before it is whole.
            cut, last = 0, held[-1]
            if same_list(last, last.num_rows - 1, batch, 0):
                low, high = 0, batch.num_rows
                while high - low > 1:
                    mid = (low + high) // 2
                    low, high = (mid, high) if same_list(last, last.num_rows - 1, batch, mid) else (low, mid)
                cut = high
            held.append(batch.slice(0, cut))
            if cut < batch.num_rows:
                yield Rows(pa.Table.from_batches(held))
                held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield Rows(pa.Table.from_batches(held))


def roots_of(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for ``forms (word, form)`` without cycles: where following the forms ends."""
    chains = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = chains.select(F.col("word").alias("at"), F.col("root").alias("next"))
        jumped = chains.join(further, chains["root"] == further["at"], "left")
        jumped = jumped.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        jumped = stored(jumped, "roots")
        chains = jumped.select("word", "root")
        if jumped.filter("moved").isEmpty():
            return chains


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", list_words: int = LIST_WORDS) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word of ``docs``.

    ``form`` is the near word of largest ``n`` (of equal ones the first in code-point order) if that
    is at least FORM_TIMES the word's, else null; ``root`` is where forms lead, the word itself if it has
    none. Null and empty texts have no words, a null id is the empty text in checksums, and repeated
    rows count again. An empty table gives no rows. Other columns are ignored.
    """
    words = stored(counted_words(docs, id_col, text_col), "words")
    # Forms rise in count, so they have no cycles.
    best = (
        near_words(words, list_words)
        .groupBy("word")
        .agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("minus"), F.col("near"))).alias("best"))
    )
    common = -F.col("best.minus") >= FORM_TIMES * F.col("n")
    formed = stored(
        words.join(best, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(common, F.col("best.near")).alias("form"),
            F.when(common, -F.col("best.minus")).alias("form_n"),
        ),
        "forms",
    )
    roots = roots_of(formed.filter("form is not null").select("word", "form"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
