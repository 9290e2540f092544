"""Token counts by two finite-state transducers compiled from a tokenizer file.

The tokenizer is a BPE over pre-tokens: contractions, runs of letters, single
digits and runs of other characters, each with a word-end mark. Two deterministic
machines count its tokens without running it over the text:

1. The *splitter* reads character classes. Its transitions are annotated with
   where pre-tokens begin. Texts are cut into chunks; each chunk yields its map
   from every state before it to the state after it, the maps compose in a
   parallel prefix scan, and then every chunk is run from its true state. All
   chunks of a slice advance together, one character a step.
2. The *lexicon* reads the symbols of a pre-token. After each symbol its state is the last token
   of the encoding so far, and the transition into it is annotated with the tokens
   that it adds. A prefix is encoded as the prefix before its last token and that token,
   so of the tokens that a prefix ends in, the last one is that which may follow
   the state at its beginning: two tokens may be neighbours if merging the symbols of
   both gives the same two again. The states are compiled from the file's vocabulary and
   merges as they are met.

The file's normalizer and pre-tokenizer must be those that the splitter is made for. Texts
with characters newer than this Python's tables are counted by the tokenizer's library.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablewash.llm.words import mixed, powers

# The contractions that the splitter keeps as one pre-token.
CONTRACTIONS = ("s", "t", "m", "d", "re", "ve", "ll")
CHUNK = 128
SLICE_CHARS = 1 << 20
LEXICON_SIZE = 1 << 21

# Character classes. Letters that matter to contractions are classes of their own.
BREAK, SPACE, LETTER, DIGIT, OTHER, QUOTE = range(6)
_SINGLE = {c: 6 + i for i, c in enumerate("stmdrvle")}
CLASSES = 6 + len(_SINGLE)
UNKNOWN = 255
# States: between pre-tokens, in letters, in others, after an apostrophe that began
# a pre-token, after it and the first of two letters, and after a contraction.
_FREE, _LETTERS, _OTHERS, _QUOTED, _DONE = range(5)
_PENDING = {"r": 5, "v": 6, "l": 7}
STATES = 8
_SECOND = {"r": "e", "v": "e", "l": "l"}
# What a transition emits: a pre-token begins at this character, or at the one before.
HERE, BEFORE = 1, 2


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """The machine's next states and emissions, by state and class."""
    step = np.zeros((STATES, CLASSES), dtype=np.uint8)
    emit = np.zeros((STATES, CLASSES), dtype=np.uint8)
    letters = [LETTER, *_SINGLE.values()]
    for state in range(STATES):
        # A letter left pending by the apostrophe before it began a pre-token after all.
        late = BEFORE if state in _PENDING.values() else 0
        begun = late or state == _LETTERS
        for c in range(CLASSES):
            if c in (BREAK, SPACE):
                step[state, c], emit[state, c] = _FREE, late
            elif c in letters:
                step[state, c], emit[state, c] = _LETTERS, late if begun else HERE
            elif c == DIGIT:
                step[state, c], emit[state, c] = _FREE, HERE | late
            elif state in (_OTHERS, _QUOTED):
                # A run of other characters goes on, apostrophes included.
                step[state, c] = _OTHERS
            else:
                step[state, c], emit[state, c] = (_QUOTED if c == QUOTE else _OTHERS), HERE | late
    for text in CONTRACTIONS:
        if len(text) == 1:
            step[_QUOTED, _SINGLE[text]], emit[_QUOTED, _SINGLE[text]] = _DONE, 0
        else:
            pending = _PENDING[text[0]]
            step[_QUOTED, _SINGLE[text[0]]], emit[_QUOTED, _SINGLE[text[0]]] = pending, 0
            step[pending, _SINGLE[_SECOND[text[0]]]], emit[pending, _SINGLE[_SECOND[text[0]]]] = _DONE, 0
    return step, emit


STEP, EMIT = _splitter()


def _class_table() -> np.ndarray:
    """The class of every character: letters, numbers and white space by their
    Unicode category, everything else is other. A character this Python does not
    know may be one that the library knows."""
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))[0]
        if kind == "L":
            table[code] = LETTER
        elif kind == "N":
            table[code] = DIGIT
        elif kind == "Z":
            table[code] = SPACE
        elif unicodedata.category(chr(code)) == "Cn":
            table[code] = UNKNOWN
    table[[*range(0x09, 0x0E), 0x85]] = SPACE
    table[ord("'")] = QUOTE
    for c, k in _SINGLE.items():
        table[ord(c)] = k
    return table


_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    global _classes
    if _classes is None:
        _classes = _class_table()
    return _classes


def chunk_maps(kinds: np.ndarray) -> np.ndarray:
    """For chunks (rows of classes), the state after each chunk for every state before it."""
    state = np.tile(np.arange(STATES, dtype=np.uint8), (len(kinds), 1))
    flat = STEP.ravel()
    for column in np.ascontiguousarray(kinds.T):
        state = flat[state.astype(np.intp) * CLASSES + column[:, None]]
    return state


def scanned(maps: np.ndarray) -> np.ndarray:
    """The composition of each chunk's map with all maps before it, by doubling."""
    total, reach = maps, 1
    while reach < len(total):
        later = np.take_along_axis(total[reach:], total[:-reach].astype(np.intp), axis=1)
        total = np.concatenate([total[:reach], later])
        reach *= 2
    return total


def starts_of(kinds: np.ndarray) -> np.ndarray:
    """Whether a pre-token begins at each character of a stream of classes."""
    n = len(kinds)
    padded = np.zeros(-(-(n + 1) // CHUNK) * CHUNK, dtype=np.uint8)
    padded[:n] = kinds
    rows = padded.reshape(-1, CHUNK)
    after = scanned(chunk_maps(rows))[:, _FREE]
    state = np.concatenate([np.full(1, _FREE, dtype=np.uint8), after[:-1]])
    emitted = np.empty((CHUNK, len(rows)), dtype=np.uint8)
    step, emit = STEP.ravel(), EMIT.ravel()
    for k, column in enumerate(np.ascontiguousarray(rows.T)):
        at = state.astype(np.intp) * CLASSES + column
        emitted[k] = emit[at]
        state = step[at]
    flat = emitted.T.ravel()
    begins = (flat & HERE) > 0
    begins[:-1] |= (flat[1:] & BEFORE) > 0
    return begins[:n]


_FACTOR = mixed(np.arange(1, 0x110001, dtype=np.uint64))


# What the splitter stands for in a tokenizer's file.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Merges:
    """Token counts from a vocabulary and its merges."""

    def __init__(self, model: dict):
        plain = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "byte_fallback": False, "ignore_merges": False}
        if any(model.get(k, v) != v for k, v in plain.items()) or not model.get("end_of_word_suffix"):
            raise ValueError("a byte pair encoding with a word-end mark and without options is needed")
        self.end = model["end_of_word_suffix"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {pair: k for k, pair in enumerate(pairs)}
        missing = [c + e for c in _BYTE_NAMES for e in ("", self.end) if c + e not in model["vocab"]]
        if missing or len({a + b for a, b in pairs}) < len(pairs):
            raise ValueError("all bytes must be tokens, and each merge must make a token of its own")
        # Only what merging its own symbols gives back is ever a token of an encoding.
        self.tokens = {t for t in model["vocab"] if self._merged(self._symbols(t)) == [t]}
        self.longest = max(len(t) for t in self.tokens)
        self._neighbours: dict[tuple[str, str], bool] = {}

    def _symbols(self, token: str) -> list[str]:
        if token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def _merged(self, symbols: list[str]) -> list[str]:
        """The symbols after all merges, the lowest rank and then the leftmost first."""
        while len(symbols) > 1:
            ranks = [self.rank.get(pair, len(self.rank)) for pair in zip(symbols, symbols[1:])]
            best = min(ranks)
            if best == len(self.rank):
                break
            k = ranks.index(best)
            symbols = [*symbols[:k], symbols[k] + symbols[k + 1], *symbols[k + 2 :]]
        return symbols

    def may_follow(self, a: str, b: str) -> bool:
        found = self._neighbours.get((a, b))
        if found is None:
            if len(self._neighbours) > LEXICON_SIZE:
                self._neighbours.clear()
            found = self._neighbours[a, b] = self._merged(self._symbols(a) + self._symbols(b)) == [a, b]
        return found

    def counts(self, words: list[str]) -> list[int]:
        """The tokens of each word, given as the names of its bytes. Words in order share the states of their prefixes."""
        order = sorted(range(len(words)), key=words.__getitem__)
        result, last, count, before = [0] * len(words), [""], [0], ""
        for place in order:
            word = words[place]
            shared, most = 0, min(len(word), len(before)) - 1
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], count[shared + 1 :]
            for i in range(shared + 1, len(word)):
                j = self._last_token(word, i, "", last)
                last.append(word[j:i])
                count.append(count[j] + 1)
            # The last symbol carries the word-end mark, so its state is no other word's.
            result[place] = count[self._last_token(word, len(word), self.end, last)] + 1 if word else 0
            before = word
        return result

    def _last_token(self, word: str, i: int, mark: str, last: list[str]) -> int:
        """Where the last token of ``word[:i]`` begins; ``last`` has those of shorter prefixes."""
        for j in range(max(0, i - self.longest), i):
            token = word[j:i] + mark
            if token in self.tokens and (j == 0 or self.may_follow(last[j], token)):
                return j
        raise AssertionError(word)


def _byte_names() -> list[str]:
    """The character that names each byte in vocabularies: printable ones themselves, others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


_BYTE_NAMES = _byte_names()
_NAMED = {b: c for b, c in enumerate(_BYTE_NAMES)}


class Lexicon:
    """Token counts of pre-tokens, compiled as they are met. Beyond its size limit it
    starts over, which costs time but changes no count."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.keys = np.zeros(0, dtype=np.uint64)
        self.counts = np.zeros(0, dtype=np.int64)

    def counts_of(self, points: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The tokens of each pre-token ``points[start:stop]``."""
        if not len(start):
            return np.zeros(0, dtype=np.int64)
        length = stop - start
        offset = np.cumsum(length) - length
        place = np.arange(int(length.sum())) - np.repeat(offset, length)
        value = _FACTOR[points[place + np.repeat(start, length)]] * powers(int(length.max()))[place]
        keys, first, inverse = np.unique(
            mixed(np.add.reduceat(value, offset) + length.astype(np.uint64)), return_index=True, return_inverse=True
        )
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), dtype=bool)
        counts = np.zeros(len(keys), dtype=np.int64)
        counts[known] = self.counts[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            texts = ["".join(map(chr, points[start[i] : stop[i]])) for i in first[new]]
            counts[new] = self._compiled(texts)
            if len(self.keys) + len(new) > LEXICON_SIZE:
                self.keys, self.counts = self.keys[:0], self.counts[:0]
            merged = np.concatenate([self.keys, keys[new]])
            order = np.argsort(merged, kind="stable")
            self.keys, self.counts = merged[order], np.concatenate([self.counts, counts[new]])[order]
        return counts[inverse]

    def _compiled(self, texts: list[str]) -> list[int]:
        return self.merges.counts([t.encode().decode("latin-1").translate(_NAMED) for t in texts])


class Counter:
    """Token counts of texts. A file whose normalizer, pre-tokenizer or model is of another kind is refused."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        made = json.loads(self.library.to_str())
        split, bytes_ = (made["pre_tokenizer"] or {}).get("pretokenizers", [{}, {}])
        wanted = {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True}
        by_byte = bytes_.get("type") == "ByteLevel" and not bytes_["add_prefix_space"] and not bytes_["use_regex"]
        if (made["normalizer"] or {}).get("normalizers") != NORMALIZERS or split != wanted or not by_byte:
            raise ValueError(f"the normalizer or pre-tokenizer of {path} is not the one that texts are split by")
        specials = self.library.get_added_tokens_decoder().values()
        if any(t.single_word or t.lstrip or t.rstrip or t.normalized for t in specials):
            raise ValueError("special tokens must be plain strings")
        self.lexicon = Lexicon(Merges(made["model"]))
        self.special = re.compile("|".join(re.escape(t.content) for t in sorted(specials, key=lambda t: -len(t.content)))) if specials else None

    def counts(self, column: pa.Array) -> np.ndarray:
        """The number of tokens of each text."""
        column = pc.fill_null(column.cast(pa.large_string()), "")
        result = np.zeros(len(column), dtype=np.int64)
        apart = np.zeros(len(column), dtype=bool)
        if self.special:
            apart = pc.match_substring_regex(column, self.special.pattern).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(~apart), column, "")
        low = 0
        sizes = np.maximum(pc.utf8_length(plain).to_numpy(), 1)
        while low < len(column):
            high = low + max(1, int(np.searchsorted(np.cumsum(sizes[low:]), SLICE_CHARS, side="right")))
            result[low:high] = self._plain(plain.slice(low, high - low))
            low = high
        for i in np.flatnonzero(apart):
            # A special token counts as one, and what lies around it as texts of their own.
            around = self.special.split(column[int(i)].as_py())
            result[i] = len(around) - 1 + int(self.counts(pa.array(around, pa.large_string())).sum())
        return result

    def _plain(self, texts: pa.Array) -> np.ndarray:
        # The normal form may join characters; a line end keeps texts apart and has no form.
        rows = [_lower(unicodedata.normalize("NFC", t)) for t in texts.to_pylist()]
        size = np.array([len(r) for r in rows], dtype=np.int64)
        points = np.frombuffer("\n".join(rows).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        kinds = classes()[points]
        edge = np.cumsum(size + 1)
        kinds[edge[:-1] - 1] = BREAK
        unknown = np.flatnonzero(kinds == UNKNOWN)
        apart = np.unique(np.searchsorted(edge, unknown, side="right"))
        kinds[unknown] = OTHER
        start = np.flatnonzero(starts_of(kinds))
        solid = (kinds != SPACE) & (kinds != BREAK)
        # A pre-token ends where the next begins or at the white space before that.
        blank = np.append(np.flatnonzero(~solid), len(kinds))
        stop = np.minimum(np.append(start[1:], len(kinds)), blank[np.searchsorted(blank, start)]) if len(start) else start
        row = np.searchsorted(edge, start, side="right")
        counts = self.lexicon.counts_of(points, start, stop)
        result = np.bincount(row, weights=counts, minlength=len(rows)).astype(np.int64)
        for i in apart:
            result[i] = len(self.library.encode(texts[int(i)].as_py(), add_special_tokens=False))
        return result


def _lower(text: str) -> str:
    """Lower case character by character, as the tokenizer's normalizer has it."""
    if text.isascii() or "Σ" not in text:
        return text.lower()
    return "".join(c.lower() for c in text)


_counters: dict[str, Counter] = {}


def token_counts(docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id", limit: int = 2048) -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` for every row of ``docs``.

    ``path`` is the tokenizer's file, at the same place on every executor. Counts are
    those of whole texts, without begin or end tokens; a special token's string
    inside a text is that token. A null text is empty: 0 bytes and 0 tokens. A null
    id stays null, repeated rows are counted each, and other columns are ignored.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _counters:
            _counters[path] = Counter(path)
        for batch in batches:
            tokens = _counters[path].counts(batch.column(2))
            over = pa.array(tokens > limit)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(tokens), over], names=[id_col, "n_bytes", "n_tokens", "over_limit"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes")
    return docs.select(F.col(id_col), size, F.col(text_col).alias("text")).mapInArrow(
        count, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean"
    )
