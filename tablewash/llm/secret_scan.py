"""Secret scans: three plain patterns, and strings in sensitive contexts that are novel to zstandard.

The patterns find assignments to names like ``password``, access keys and long runs of
hexadecimal digits. Beyond them, a *candidate* is a run of characters of keys and
encodings, with a letter and a digit in it, that follows a sensitive word closely. Its
novelty is what it adds to the compressed size of the text around it:

    novelty = size(before + candidate + after) - size(before + after)

Both sizes are measured with a compressor that is primed with a dictionary: identifiers
that often stand near secrets, and the words that occur in most documents of the corpus.
Words, paths and identifiers match the dictionary or the surrounding text and add
few bytes; random strings match neither and add about as many bytes as they have, and
these are reported.

The words are counted over all documents, combined in each task before the shuffle; only the
dictionary, whose size is a parameter, comes to the driver. The scan itself shuffles nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


# The patterns of the contract and the order of their kinds.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "novel")
ASSIGN_CHARS, ACCESS_CHARS = 8, 16

# Words after which a string may be a secret, and names that are none themselves.
SENSITIVE = (
    "password passwd passphrase pwd secret token apikey api_key api-key api key access_key access-key access key accesskey "
    "private_key private-key private key client_key credential bearer authorization auth_key signing_key signature "
    "session_id sessionid cookie webhook license_key encryption_key account_key connection_string"
)
IDENTIFIERS = (
    "access_token refresh_token client_secret client_id secret_access_key AWS_SECRET_ACCESS_KEY Authorization: Bearer "
    "private_key public_key session_token getenv environ config settings example placeholder changeme undefined "
    "0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ xxxxxxxxxxxxxxxx ---------------- ================ "
    "https http localhost /usr/local/lib /etc/ssl/certs /var/lib .example.com application/json utf-8 sha256 base64 "
)
_NAMES = sorted({w.replace(" ", "[ ]") for w in re.findall(r"(?:api|access|private) key|\S+", SENSITIVE)}, key=lambda w: (-len(w), w))
SENSITIVE_WORD = re.compile("|".join(_NAMES), re.ASCII | re.IGNORECASE)
# What any span needs; texts without it are not looked at again.
TRIGGER = "(?i:" + "|".join(_NAMES) + ")|AKIA[A-Z0-9]{12}|[0-9a-f]{32}"
# A run that no letter, digit or mark of a longer run comes before; an equals sign may.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/][A-Za-z0-9+/_=-]{15,}")
SHORTEST = 16
# How far before a candidate its sensitive word may end, and how much text around it is compressed with it.
REACH = 48
AROUND = 256
# A candidate is novel from this many added bytes per hundred characters. One of more than SHORT
# characters is compressed by their frequencies as well: random letters and digits to 65, hexadecimal
# digits to 50.
NOVEL_SHARE, NOVEL_SHARE_LONG = 75, 50
SHORT = 64
LEVEL = 19
WORD = re.compile(r"[A-Za-z_]{4,}")
DICTIONARY_BYTES = 64 << 10
SPLITS = 8
# Distinct words that a task counts before it passes them on.
COUNTED_AT_A_TIME = 200_000

FOUND = "n_assign long, n_access long, n_hex long, n_novel long, spans array<struct<kind:string,start:int,end:int,novelty:int>>"


def common_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(word, n)``: in how many rows of ``docs`` each word of four letters or more occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(set(WORD.findall(text or "")))
                if len(seen) >= COUNTED_AT_A_TIME:
                    yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])
                    seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def dictionary_of(docs: DataFrame, text_col: str = "text", size: int = DICTIONARY_BYTES) -> bytes:
    """The identifiers and the words found in most rows, ``size`` bytes at most, the commonest
    last, where matches cost least. Words found in a single row are never taken."""
    limit = max(1, size // 5)
    counted = common_words(docs, text_col).filter((F.length("word") <= 64) & (F.col("n") > 1))
    # Cut in SPLITS parts first: a top-k alone would send as many words of every task to the driver.
    part = Window.partitionBy(F.pmod(F.xxhash64("word"), F.lit(SPLITS))).orderBy(F.desc("n"), "word")
    few = counted.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= limit)
    most = few.orderBy(F.desc("n"), "word").limit(limit).select("word")
    words, room = [], size - len(IDENTIFIERS)
    for row in most.collect():
        room -= len(row["word"]) + 1
        if room < 0:
            break
        words.append(row["word"])
    return (" ".join(reversed(words)) + " " + IDENTIFIERS).encode()


class Novelty:
    """Bytes that strings add to the compressed text around them."""

    def __init__(self, dictionary: bytes):
        primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=LEVEL)
        options = {"write_checksum": False, "write_content_size": False, "write_dict_id": False}
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=primed, **options)

    def size(self, text: str) -> int:
        return len(self.compressor.compress(text.encode()))

    def added(self, text: str, start: int, end: int) -> int:
        before, after = text[max(0, start - AROUND) : start], text[end : end + AROUND]
        return self.size(before + text[start:end] + after) - self.size(before + after)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the three patterns, by start and then by kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_CHARS]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(KINDS[kind], start, end) for start, kind, end in sorted(found)]


def novel_spans(text: str, known: list[tuple[str, int, int]], novelty: Novelty) -> list[tuple[str, int, int, int]]:
    """Candidates beside the ``known`` spans that follow a sensitive word and don't compress."""
    found, tried = [], set()
    for word in SENSITIVE_WORD.finditer(text):
        at, stop = word.end(), word.end() + REACH
        while near := CANDIDATE.search(text, at, stop + SHORTEST):
            # The window ends soon after the reach, the candidate may not.
            start, end = CANDIDATE.match(text, near.start()).span()
            at = end
            if start in tried or start > stop:
                continue
            tried.add(start)
            string = text[start:end]
            if not (re.search("[0-9]", string) and re.search("[A-Za-z]", string)) or any(a < end and start < b for _, a, b in known):
                continue
            added = novelty.added(text, start, end)
            if 100 * added >= (NOVEL_SHARE if len(string) <= SHORT else NOVEL_SHARE_LONG) * len(string):
                found.append(("novel", start, end, added))
    return found


def spans_of(text: str, novelty: Novelty) -> list[tuple[str, int, int, int]]:
    """All spans ``(kind, start, end, novelty)`` of a text, by start and then by kind."""
    base = base_spans(text)
    found = [(*span, novelty.added(text, span[1], span[2])) for span in base] + novel_spans(text, base, novelty)
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _scanned(docs: DataFrame, text_col: str, keep: list[str], dictionary: bytes | None, redact: bool) -> DataFrame:
    dictionary = dictionary_of(docs, text_col) if dictionary is None else dictionary
    shared = docs.sparkSession.sparkContext.broadcast(dictionary)
    fields = docs.select(*keep).schema.fields

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(shared.value)
        for batch in batches:
            texts = batch.column(len(keep)).fill_null("")
            spans: list[list[tuple[str, int, int, int]]] = [[]] * batch.num_rows
            for k in pc.indices_nonzero(pc.match_substring_regex(texts, TRIGGER)).to_pylist():
                spans[k] = spans_of(texts[k].as_py(), novelty)
            kept = [batch.column(k) for k in range(len(keep))]
            if redact:
                kept[keep.index(text_col)] = pa.array(
                    [redacted(t.as_py(), s) if s else o.as_py() for t, s, o in zip(texts, spans, batch.column(len(keep)))], texts.type
                )
            counts = [pa.array([sum(s[0] == kind for s in row) for row in spans], pa.int64()) for kind in KINDS]
            made = pa.array([[dict(zip(("kind", "start", "end", "novelty"), s)) for s in row] for row in spans], _SPANS)
            yield pa.RecordBatch.from_arrays([*kept, *counts, made], names=[*keep, *_NAMES_MADE])

    made = T.StructType([*fields, *T.StructType.fromDDL(FOUND).fields])
    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(scan, made)


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("novelty", pa.int32())]))
_NAMES_MADE = ["n_assign", "n_access", "n_hex", "n_novel", "spans"]


def redacted(text: str, spans: list[tuple[str, int, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping ones, the first names all."""
    parts, at = [], 0
    for kind, start, end, _ in spans:
        if start >= at:
            parts += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def secret_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dictionary: bytes | None = None, keep: list[str] | None = None
) -> DataFrame:
    """The columns ``keep`` of ``docs`` (its id by default) with ``n_assign``, ``n_access``, ``n_hex``,
    ``n_novel`` and ``spans``, an array of ``(kind, start, end, novelty)`` in code points, ends exclusive.

    One row per row of ``docs``, repeated rows and null ids included. A null or empty text has
    no spans. Spans of one kind never overlap, and novel ones overlap no others. Without a given
    ``dictionary``, words are counted over all of ``docs``; it must then give the same rows
    whenever it is read. An empty table gives no rows. Columns with the result's names are left out.
    """
    keep = [c for c in ([id_col] if keep is None else keep) if c.lower() not in _NAMES_MADE]
    return _scanned(docs, text_col, keep, dictionary, redact=False)


def without_secrets(docs: DataFrame, text_col: str = "text", dictionary: bytes | None = None) -> DataFrame:
    """``docs`` with each secret in its texts replaced by its kind in brackets.

    All rows and columns stay, those with the names of results of ``secret_spans`` included; null
    texts stay null, and texts without secrets as they are.
    """
    columns = docs.columns
    plain = docs.toDF(*[text_col if c == text_col else f"c{k}" for k, c in enumerate(columns)])
    made = _scanned(plain, text_col, plain.columns, dictionary, redact=True)
    return made.select(*[F.col(p).alias(c) for p, c in zip(plain.columns, columns)])
