"""Quality classifier: document evidence combined with site posteriors by empirical Bayes.

1. *Documents.* A logistic model over distinct words and word shapes gives each text
   its log-odds of being good. It is fitted on a bounded sample of labelled
   documents, over the features whose share differs significantly between labels.
2. *Sites.* Every document adds its probability to its host and to its path (host and
   section). A host's rate of good documents is shrunk toward the global rate, a
   path's rate toward that of its host. How strongly follows from the spread
   between sites (method of moments), so a site with few documents says little.
3. A document's score is its own log-odds moved by how much the log-odds of its
   path's rate differ from the global ones. It is kept if the score reaches a limit.

Sites are grouped aggregations whose sums are combined before the shuffle, so
a host with a third of all rows costs no more than others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewash.llm.words import is_letter_or_digit, is_space_free, mixed, slices, utf8, words_of
from tablewash.session import stored

# The bound on the labelled documents that the model is fitted on, and on its features.
MAX_LABELLED = 16_000
MAX_FEATURES = 512
MIN_G = 20.0
RIDGE = 0.3
STEPS = 12
# Documents whose features are laid out in a dense block at a time while fitting.
FIT_ROWS = 1024
# A document is kept from these log-odds of being good: about 82 in 100.
MIN_LOG_ODDS = 1.5
_SHAPE = np.uint64(0xA24BAED4963EE407)


def features_of(column: pa.Array) -> Iterator[list[np.ndarray]]:
    """For slices of the rows, each row's distinct features as sorted hashes: its words
    in lower case, what words end in beside letters and digits, and how many tenths
    of its ASCII letters are capitals and of its words repeat the one before."""
    data, offsets = utf8(column)
    alnum = is_letter_or_digit()
    for low, high in slices(offsets):
        at = offsets[low : high + 1]
        raw = data[at[0] : at[-1]]
        spans = at - at[0]
        words = words_of(raw, spans, alnum)
        hashes, rows = [words.hashes()], [words.row]
        tokens = words_of(raw, spans, is_space_free(), lower=False)
        if len(tokens):
            # Up to three last bytes of each token, while they are no letters or digits.
            shape, going = np.zeros(len(tokens), dtype=np.uint64), np.ones(len(tokens), dtype=bool)
            for k in range(1, 4):
                place = tokens.end - k
                going &= place >= tokens.start
                byte = tokens.data[np.maximum(place, 0)]
                going &= ~alnum[byte]
                shape[going] = mixed(shape[going] * _SHAPE + byte[going].astype(np.uint64) + np.uint64(1))
            ended = shape != 0
            hashes.append(shape[ended])
            rows.append(tokens.row[ended])
        capital = np.concatenate([[0], np.cumsum((raw >= 65) & (raw <= 90))])
        letter = np.concatenate([[0], np.cumsum(((raw >= 65) & (raw <= 90)) | ((raw >= 97) & (raw <= 122)))])
        counts = np.diff(letter[spans])
        tenth = (10 * np.diff(capital[spans])) // np.maximum(counts, 1)
        has = np.flatnonzero(counts)
        hashes.append(mixed(tenth[has].astype(np.uint64) + _SHAPE))
        rows.append(has)
        again = np.concatenate([[0], np.cumsum((hashes[0][1:] == hashes[0][:-1]) & (words.row[1:] == words.row[:-1]))])
        ends = np.maximum(words.first - 1, 0)
        count = np.diff(words.first)
        has = np.flatnonzero(count)
        if len(has):
            tenth = (10 * (again[ends[1:][has]] - again[words.first[:-1][has]])) // count[has]
            hashes.append(mixed(tenth.astype(np.uint64) + _SHAPE * np.uint64(3)))
            rows.append(has)
        everything, row = np.concatenate(hashes), np.concatenate(rows)
        order = np.argsort(row, kind="stable")
        everything, row = everything[order], row[order]
        edges = np.searchsorted(row, np.arange(high - low + 1))
        yield [np.unique(everything[a:b]) for a, b in zip(edges, edges[1:])]


@dataclass(frozen=True)
class Model:
    """Weights of features, sorted by their hashes, and the log-odds without any."""

    features: np.ndarray
    weights: np.ndarray
    intercept: float

    def evidence(self, rows: list[np.ndarray]) -> np.ndarray:
        size = np.array([len(r) for r in rows], dtype=np.int64)
        result = np.full(len(rows), self.intercept)
        if len(self.features) and size.sum():
            all_ = np.concatenate(rows)
            place = np.minimum(np.searchsorted(self.features, all_), len(self.features) - 1)
            weight = np.where(self.features[place] == all_, self.weights[place], 0.0)
            result += np.bincount(np.repeat(np.arange(len(rows)), size), weights=weight, minlength=len(rows))
        return result


def selected_features(sample: DataFrame, n_good: int, n_bad: int) -> np.ndarray:
    """Features that are more common in bad documents of ``sample (good, features)``: those with
    the largest likelihood-ratio statistics (G) of at least MIN_G. What is more common in good
    ones is left out, since a short text lacks it for no fault. Counted in Spark; only the
    selected ones come to the driver."""
    counts = sample.select("good", F.explode("features").alias("feature")).groupBy("feature")
    counts = counts.agg(F.sum("good").alias("in_good"), F.sum(1 - F.col("good")).alias("in_bad"))
    share = (F.col("in_good") + F.col("in_bad")) / (n_good + n_bad)
    g = F.lit(0.0)
    for seen, total in ((F.col("in_good"), n_good), (F.col("in_bad"), n_bad)):
        for count, expected in ((seen, total * share), (total - seen, total * (1 - share))):
            g += 2 * count * F.log(F.greatest(count.cast("double"), F.lit(1e-9)) / F.greatest(expected, F.lit(1e-9)))
    telling = counts.filter(F.col("in_good") * n_bad < F.col("in_bad") * n_good).withColumn("g", g).filter(F.col("g") >= MIN_G)
    best = telling.orderBy(F.desc("g"), "feature").limit(MAX_FEATURES).select("feature").toArrow()
    return np.sort(best["feature"].to_numpy().astype(np.int64).view(np.uint64))


def fit(features: np.ndarray, places: list[np.ndarray], good: np.ndarray) -> Model:
    """A ridge logistic model by Newton steps, over blocks of rows. ``places`` has, for each
    document, where its features are among ``features``."""
    width = len(features) + 1
    ridge = np.full(width, RIDGE)
    ridge[-1] = 1e-6
    w = np.zeros(width)

    def blocks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for low in range(0, len(places), FIT_ROWS):
            part = places[low : low + FIT_ROWS]
            x = np.zeros((len(part), width), dtype=np.float32)
            x[np.repeat(np.arange(len(part)), [len(p) for p in part]), np.concatenate(part)] = 1
            x[:, -1] = 1
            yield x, good[low : low + FIT_ROWS]

    for _ in range(STEPS):
        gradient, curvature = ridge * w, np.diag(ridge)
        for x, y in blocks():
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            curve = np.maximum(p * (1 - p), 1e-4).astype(np.float32)
            gradient += x.T @ (p - y)
            curvature += (x.T * curve) @ x
        w = w - np.linalg.solve(curvature, gradient)
    return Model(features, w[:-1], float(w[-1]))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(good, features)`` of at most MAX_LABELLED documents, one of each labelled id."""
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) != 1)
    clear = (
        labels.select(F.col("doc_id").alias("id"), good.cast("int").alias("good"))
        .filter("id is not null and good is not null")
        .groupBy("id")
        .agg(F.min("good").alias("good"), F.max("good").alias("most"))
        .filter("good = most")
        .select("id", "good")
    )
    chosen = stored(clear.orderBy(F.xxhash64("id"), "id").limit(MAX_LABELLED), "sample")
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Of rows that repeat an id one is kept, in each task before they are dealt out by id.
    one = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(
        F.first("good").alias("good"), F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text")
    )

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for rows in features_of(batch.column(1)):
                found = pa.array([r.view(np.int64) for r in rows], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(rows)), found], names=["good", "features"])
                done += len(rows)

    return stored(one.select("good", "text").mapInArrow(extract, "good int, features array<long>"), "features")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The document model. ``labels`` has the id, ``quality`` (1 is good) and ``toxic`` (1 is
    bad); an id that is labelled both ways, or not at all, is left out. At most
    MAX_LABELLED documents are used, those with the smallest hashes of their ids; of rows that
    repeat an id one is used, the same in every run."""
    sample = labelled_sample(docs, labels, id_col, text_col)
    total = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good")).first()
    n_good, n_bad = total["good"], total["n"] - total["good"]
    if not n_good or not n_bad:
        # Nothing to tell apart: without bad examples all are kept, without good ones none.
        return Model(np.zeros(0, dtype=np.uint64), np.zeros(0), -5.0 if n_bad else 5.0)
    features = selected_features(sample, n_good, n_bad)
    shared = docs.sparkSession.sparkContext.broadcast(features)

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            found = []
            for row in batch.column(1):
                own = row.values.to_numpy().view(np.uint64)
                at = np.searchsorted(known, own)
                hit = at < len(known)
                hit[hit] = known[at[hit]] == own[hit]
                found.append(at[hit].astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["good", "places"])

    # At most MAX_LABELLED rows of at most MAX_FEATURES places of two bytes, in an order of their own.
    rows = sample.mapInArrow(locate, "good int, places binary").toArrow().sort_by([("places", "ascending"), ("good", "ascending")])
    places = [np.frombuffer(p, dtype=np.uint16) for p in rows["places"].to_pylist()]
    return fit(features, places, rows["good"].to_numpy().astype(np.float64))


def with_evidence(docs: DataFrame, model: Model, text_col: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` with the model's log-odds as ``evidence``."""
    fields = docs.select(*keep).schema.fields
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for rows in features_of(batch.column(len(keep))):
                part = batch.slice(done, len(rows))
                found = pa.array(shared.value.evidence(rows))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in range(len(keep))), found], names=[*keep, "evidence"]
                )
                done += len(rows)

    read = docs.select(*keep, F.col(text_col).alias("__text"))
    return read.mapInArrow(score, T.StructType([*fields, T.StructField("evidence", T.DoubleType())]))


def host_of(source: Column) -> Column:
    """The host of an address, or the name of a source that is none."""
    return F.lower(F.regexp_extract(F.coalesce(source, F.lit("")), r"^(?:[A-Za-z][\w+.-]*://)?([^/?#]*)", 1))


def path_of(source: Column, section: Column) -> Column:
    """The host with the first part of the address's path, or else with ``section``."""
    first = F.regexp_extract(F.coalesce(source, F.lit("")), r"^(?:[A-Za-z][\w+.-]*://)?[^/?#]*/([^/?#]+)", 1)
    return F.concat(host_of(source), F.lit("/"), F.when(first != "", first).otherwise(F.coalesce(section, F.lit(""))))


def _strength(groups: DataFrame, rate: str) -> float:
    """How many documents a group's prior counts for: the Beta prior's size whose spread
    of rates, beside the spread from counting, is that between the groups."""
    mean = F.col("good") / F.col("n")
    noise = F.col(rate) * (1 - F.col(rate)) / F.col("n")
    row = groups.agg(
        F.avg((mean - F.col(rate)) ** 2 - noise).alias("between"), F.avg(F.col(rate) * (1 - F.col(rate))).alias("within")
    ).first()
    if row["between"] is None or row["between"] <= 0:
        return 1e4
    return float(min(max(row["within"] / row["between"] - 1, 2.0), 1e4))


def site_rates(scored: DataFrame) -> DataFrame:
    """``(host, path, host_good, path_good, shift)`` of every path, from ``(host, path, evidence)``."""
    good = 1 / (1 + F.exp(-F.col("evidence")))
    paths = stored(
        scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(good).cast("decimal(38,6)").alias("good")), "paths"
    ).withColumn("good", F.col("good").cast("double"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    rate = min(max((total["good"] or 0.0) / max(total["n"] or 0, 1), 1e-6), 1 - 1e-6)
    hosts = hosts.withColumn("rate", F.lit(rate))
    k = _strength(hosts, "rate")
    hosts = hosts.select("host", ((F.col("good") + k * rate) / (F.col("n") + k)).alias("host_good"))
    paths = paths.join(hosts, "host")
    k = _strength(paths, "host_good")
    path_good = (F.col("good") + k * F.col("host_good")) / (F.col("n") + k)
    odds = lambda p: F.log(p / (1 - p))
    shift = odds(F.least(F.greatest(F.col("path_good"), F.lit(1e-6)), F.lit(1 - 1e-6))) - odds(F.lit(rate))
    return stored(paths.withColumn("path_good", path_good).select("host", "path", "host_good", "path_good", shift.alias("shift")), "sites")


def classify(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    section_col: str = "lang",
    keep: list[str] | None = None,
    min_log_odds: float = MIN_LOG_ODDS,
) -> DataFrame:
    """``docs``, or its columns ``keep``, with ``evidence``, ``host``, ``path``, ``host_good``,
    ``path_good``, ``score`` and ``kept``, one row per row of ``docs``.

    A null or empty text has no features, so its evidence is the model's intercept. A null
    source or section is the empty one. Rows with a null id are classified but never
    learned from; repeated rows each count for their site. Without labels of
    both kinds, the model says the same of all texts. An empty table gives no rows.
    Columns of ``docs`` with the result's names are replaced.
    """
    made = ("evidence", "host", "path", "host_good", "path_good", "score", "kept")
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in made]
    sited = docs.select(
        F.struct(*keep).alias("row"),
        F.col(text_col).alias("text"),
        host_of(F.col(source_col)).alias("host"),
        path_of(F.col(source_col), F.col(section_col)).alias("path"),
    )
    model = train(docs, labels, id_col, text_col)
    sites = site_rates(with_evidence(sited, model, "text", ["host", "path"]))
    scored = with_evidence(sited, model, "text", ["row", "host", "path"]).join(sites, ["host", "path"])
    return scored.withColumn("score", F.col("evidence") + F.col("shift")).select(
        "row.*", *made[:5], "score", (F.col("score") >= min_log_odds).alias("kept")
    )
