"""Language identification by string kernels.

The kernel of two texts is that of their blended spectra: the byte strings of one to
three characters that occur in both, divided by the geometric mean of the numbers
that occur in each. Landmark texts span the Nyström approximation: a text is
described by its kernels with the landmarks, and one ridge regression for each
language, against all others, is fitted on these descriptions. The
landmarks times the regressions' coefficients are a weight of each string for each
language, so scoring a batch is one matrix product.

Fitting uses a bounded sample of labelled texts; every text is predicted as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewash.llm.words import utf8
from tablewash.session import stored

# The bounds on the sample: labelled texts and landmarks of each language. More than 64
# languages share ALL_LANDMARKS, each with one at least; no language is left out.
PER_LANGUAGE = 300
# Parts that a language is dealt into before its ids are ranked together.
SPLITS = 16
LANDMARKS = 64
ALL_LANDMARKS = 4096
# Landmarks whose presences are a dense table at a time.
BLOCK = 256
ORDERS = 3
RIDGE = 1e-2
BATCH = 64
UNKNOWN = "und"


def spectra(texts: pa.Array) -> list[np.ndarray]:
    """The distinct byte strings of up to three bytes of each text, in lower case, each as
    its bytes in base 256 plus an offset for its length, sorted."""
    data, offsets = utf8(pc.utf8_lower(texts.cast(pa.large_string())))
    result = []
    for a, b in zip(offsets, offsets[1:]):
        code = data[a:b].astype(np.uint32)
        parts = [np.unique(code)]
        for n in range(2, ORDERS + 1):
            code = (code[:-1] << np.uint32(8)) | data[a + n - 1 : b] if b - a >= n else code[:0]
            parts.append(np.unique(code) + np.uint32(n << 24))
        result.append(np.concatenate(parts))
    return result


def kernel(xs: list[np.ndarray], vocabulary: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The presences of the strings of ``vocabulary`` in texts, each divided by the root of
    the text's number of strings, times ``table``."""
    result = np.zeros((len(xs), table.shape[1]), dtype=np.float32)
    for low in range(0, len(xs), BATCH):
        part = xs[low : low + BATCH]
        present = np.zeros((len(part), len(vocabulary)), dtype=np.float32)
        for k, x in enumerate(part):
            at = np.minimum(np.searchsorted(vocabulary, x), len(vocabulary) - 1)
            present[k, at[vocabulary[at] == x]] = 1 / np.sqrt(max(len(x), 1))
        result[low : low + BATCH] = present @ table
    return result


def landmark_kernels(xs: list[np.ndarray], marks: list[np.ndarray]) -> np.ndarray:
    """The kernels of texts with the landmarks."""
    result = np.zeros((len(xs), len(marks)), dtype=np.float32)
    for low in range(0, len(marks), BLOCK):
        part = marks[low : low + BLOCK]
        vocabulary = np.unique(np.concatenate(part))
        table = np.zeros((len(vocabulary), len(part)), dtype=np.float32)
        for k, x in enumerate(part):
            table[np.searchsorted(vocabulary, x), k] = 1 / np.sqrt(max(len(x), 1))
        result[:, low : low + BLOCK] = kernel(xs, vocabulary, table)
    return result


@dataclass(frozen=True)
class Model:
    languages: list[str]
    vocabulary: np.ndarray
    weights: np.ndarray
    offsets: np.ndarray

    def margins(self, xs: list[np.ndarray]) -> np.ndarray:
        return kernel(xs, self.vocabulary, self.weights) + self.offsets


def fit(names: list[str], number: np.ndarray, marks: list[np.ndarray], rows: Iterator[tuple[np.ndarray, np.ndarray]]) -> Model:
    """One-versus-rest kernel ridge regressions over the landmarks; languages weigh alike.

    ``rows`` has labels of sample texts and their kernels with the landmarks, of
    ``number`` texts for each of the languages ``names``.
    """
    left = np.zeros((len(marks), len(marks)))
    sums = np.zeros((len(names), len(marks)))
    for label, k_nm in rows:
        weight = 1 / (len(names) * number[label])
        weighted = k_nm * weight[:, None]
        left += weighted.T @ k_nm
        np.add.at(sums, label, weighted)
    # Targets are 1 for a language's own texts and -1 for all others, less their mean.
    mean = 2 / len(names) - 1
    right = (2 * sums - (1 + mean) * sums.sum(0)).T
    # Least squares with the ridge measured by the kernel between the landmarks.
    left += RIDGE / len(marks) * landmark_kernels(marks, marks).astype(np.float64) + 1e-9 * np.eye(len(marks))
    coefficients = np.linalg.solve(left, right)
    vocabulary = np.unique(np.concatenate(marks))
    weights = np.zeros((len(vocabulary), len(names)), dtype=np.float32)
    for x, c in zip(marks, coefficients):
        weights[np.searchsorted(vocabulary, x)] += (c / np.sqrt(max(len(x), 1))).astype(np.float32)
    return Model(names, vocabulary, weights, np.full(len(names), mean, dtype=np.float32))


def held_out(doc_id: Column) -> Column:
    """Whether a document is never learned from: its id's checksum leaves 1 on division by 3."""
    left = F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(3)) == 1
    return F.coalesce(left, F.lit(False))


def smallest_ids(usable: DataFrame, id_col: str, lang_col: str) -> DataFrame:
    """``(id, lang, order, rank)``: for every language the PER_LANGUAGE ids with the smallest hashes.

    Each task keeps so many distinct ids of each language, and so do SPLITS parts of a
    language before they meet. Repeated rows count once at every step.
    """
    pairs = usable.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.xxhash64(id_col).alias("order"))
    kind = pairs.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            both = (pa.concat_tables([held, table]) if held is not None else table).group_by(["lang", "order", "id"]).aggregate([])
            both = both.select(["id", "lang", "order"]).sort_by([("lang", "ascending"), ("order", "ascending"), ("id", "ascending")])
            # The place of each row in its language: rows are sorted, so it counts from the language's first.
            langs = both["lang"].combine_chunks().dictionary_encode().indices.to_numpy()
            first = np.searchsorted(langs, langs, side="left")
            held = both.filter(pa.array(np.arange(len(langs)) - first < PER_LANGUAGE))
        if held is not None:
            yield from held.to_batches()

    few = pairs.mapInArrow(cut, f"id {kind}, lang string, order long").distinct()
    for keys in (["lang", F.pmod("order", F.lit(SPLITS))], ["lang"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("order", "id"))
        few = few.withColumn("rank", rank).filter(F.col("rank") <= PER_LANGUAGE)
    return few


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """The model of a sample: for every language the texts with the smallest hashes of
    their ids, of texts with a letter that are not held out; of rows that repeat an id with
    a language one is used, the same in every run. None without any."""
    usable = docs.filter(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    chosen = stored(smallest_ids(usable, id_col, lang_col), "sample")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([x.tobytes() for x in spectra(batch.column(3))], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], found], names=["lang", "order", "rank", "strings"])

    texts = usable.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    # Of rows that repeat an id one is kept, in each task before they are dealt out by id.
    one = F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text")
    sample = (
        texts.join(F.broadcast(chosen), ["id", "lang"])
        .groupBy("lang", "order", "rank", "id")
        .agg(one)
        .select("lang", "order", "rank", "text")
        .mapInArrow(extract, "lang string, order long, rank int, strings binary")
    )
    sample = stored(sample, "spectra")
    counted = sample.groupBy("lang").count().orderBy("lang").collect()
    if not counted:
        return None
    names = sorted(r["lang"] for r in counted)
    number = {r["lang"]: r["count"] for r in counted}
    each = max(1, min(LANDMARKS, ALL_LANDMARKS // len(names)))
    first = sample.filter(F.col("rank") <= each).select("lang", "order", "strings").toArrow()
    first = first.sort_by([("lang", "ascending"), ("order", "ascending")])
    marks = [np.frombuffer(x, dtype=np.uint32) for x in first["strings"].to_pylist()]
    shared = docs.sparkSession.sparkContext.broadcast(marks)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs = [np.frombuffer(x, dtype=np.uint32) for x in batch.column(1).to_pylist()]
            found = landmark_kernels(xs, shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in found], pa.binary())], names=["lang", "row"])

    place = {name: k for k, name in enumerate(names)}

    def rows() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held: list = []
        for r in sample.select("lang", "strings").mapInArrow(compare, "lang string, row binary").toLocalIterator():
            held.append(r)
            if len(held) == PER_LANGUAGE:
                yield packed(held)
                held = []
        if held:
            yield packed(held)

    def packed(held: list) -> tuple[np.ndarray, np.ndarray]:
        label = np.array([place[r["lang"]] for r in held])
        return label, np.stack([np.frombuffer(r["row"], dtype=np.float32) for r in held]).astype(np.float64)

    return fit(names, np.array([number[n] for n in names]), marks, rows())


def predict_language(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, held_out, lang_pred, score)`` for every row of ``docs``.

    ``score`` is the best language's share of the softmax over all languages' margins.
    A text that is null or has no letter is ``und`` with score 0, and so are all texts
    without a model. Rows with a null id are predicted like all others, and repeated
    rows each. Other columns, the language's included, are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            langs = np.full(batch.num_rows, UNKNOWN, dtype=object)
            scores = np.zeros(batch.num_rows)
            asked = np.flatnonzero(batch.column(2).to_numpy(zero_copy_only=False)) if model else []
            for low in range(0, len(asked), BATCH):
                rows = asked[low : low + BATCH]
                margins = model.margins(spectra(batch.column(3).take(pa.array(rows))))
                best = margins.argmax(axis=1)
                power = np.exp(4 * (margins - margins.max(axis=1, keepdims=True)))
                langs[rows] = [model.languages[b] for b in best]
                scores[rows] = 1 / power.sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(langs.tolist(), pa.string()), pa.array(scores)],
                names=[id_col, "held_out", "lang_pred", "score"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    asked = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    return docs.select(F.col(id_col), held_out(F.col(id_col)), asked, F.col(text_col)).mapInArrow(
        predict, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double"
    )


def identify_languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """Languages of all texts, learned from the labelled ones that are not held out."""
    return predict_language(docs, train(docs, id_col, text_col, lang_col), id_col, text_col)
