"""Quality rules: countable faults of a text, and an n-gram log-likelihood ratio.

The ratio compares two multinomials over hashed words and word pairs: one of the
trusted documents, one of the whole corpus. A text's score is the mean of
``log(trusted / corpus)`` over its n-grams, so it does not depend on length, and
every text with a score below the threshold is rejected, always alike.

All of it is built from column expressions. Counting n-grams combines in each
task before one small shuffle; scoring reads the table of ratios, one number per
hash bucket, as a single array and needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewash.session import stored

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
BUCKETS = 1 << 17
PSEUDO_COUNT = 10.0
THRESHOLD = -0.15
MIN_WORDS = 50
MAX_REPEAT_SHARE = 50
# Trusted ids up to this many (8 bytes each) are broadcast, more are joined by a shuffle.
BROADCAST_ROWS = 4_000_000


def words(text: Column) -> Column:
    """The words between spaces and U+0009 to U+000D, in order."""
    return F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), "")


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _in_place(value: Column) -> Column:
    """The value, in a form that the optimizer does not copy into a filter above: a
    filter on a measure would otherwise evaluate a text's arrays once per element."""
    return F.when(F.spark_partition_id() >= 0, value)


def base_measures(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with the word hashes ``__h`` and the measures of each text."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda line: _without(line, SPACES) != "")
    hashed = docs.withColumns(
        {
            "__h": F.transform(words(body), lambda w: F.xxhash64(w)),
            "word_chars": F.length(_without(body, SPACES)).cast("long"),
            "n_symbols": (F.length(body) - F.length(_without(body, SYMBOLS))).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        }
    ).withColumn("n_words", F.size("__h").cast("long"))
    windows = F.transform(
        F.sequence(F.lit(1), F.size("__h") - 2),
        lambda i: F.xxhash64(F.element_at("__h", i), F.element_at("__h", i + 1), F.element_at("__h", i + 2)),
    )
    none = F.array().cast("array<bigint>")
    windowed = hashed.withColumn("__w", F.when(F.col("n_words") >= 3, windows).otherwise(none))
    # Windows that occur again lie side by side once sorted. Most texts have none.
    again = F.size(F.array_distinct("__w")) < F.size("__w")
    order = F.sort_array(F.transform("__w", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    placed = windowed.withColumn("__s", F.when(again, order))
    same = lambda k, d: F.get("__s", k)["h"].eqNullSafe(F.get("__s", k + d)["h"])
    places = F.filter(F.sequence(F.lit(0), F.size("__s") - 1), lambda k: same(k, -1) | same(k, 1))
    covered = F.flatten(
        F.transform(places, lambda k: F.transform(F.array(*map(F.lit, range(3))), lambda d: F.get("__s", k)["i"] + d))
    )
    repeat = F.when(F.col("__s").isNull(), 0).otherwise(F.size(F.array_distinct(covered))).cast("long")
    return placed.withColumn("n_repeat_words", _in_place(repeat)).drop("__w", "__s")


def _ngrams(hashes: str) -> Column:
    """The buckets of a text's words and word pairs."""
    one = F.transform(hashes, lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int"))
    two = F.transform(
        F.sequence(F.lit(1), F.size(hashes) - 1),
        lambda i: F.pmod(F.xxhash64(F.element_at(hashes, i), F.element_at(hashes, i + 1)), F.lit(BUCKETS)).cast("int"),
    )
    return F.when(F.size(hashes) >= 2, F.concat(one, two)).otherwise(one)


def ngram_ratios(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(ratios)``, one row: the log ratio of every bucket, as an array.

    ``trusted`` has the ids of trusted documents. The corpus is all of ``docs``.
    """
    ids = stored(
        trusted.select(F.col(trusted.columns[0]).alias("__id")).filter("__id is not null").distinct().withColumn("__t", F.lit(1)),
        "trusted",
    )
    few = ids.count() <= BROADCAST_ROWS
    body = F.coalesce(F.col(text_col), F.lit(""))
    marked = docs.select(F.col(id_col).alias("__id"), F.transform(words(body), lambda w: F.xxhash64(w)).alias("__h")).join(
        F.broadcast(ids) if few else ids, "__id", "left"
    )
    counts = (
        marked.select(F.coalesce("__t", F.lit(0)).alias("t"), F.explode(_ngrams("__h")).alias("bucket"))
        .groupBy("bucket")
        .agg(F.count("*").alias("n"), F.sum("t").alias("t"))
    )
    # At most BUCKETS rows from here on.
    counts = stored(counts, "ngrams")
    total = counts.agg(F.sum("n").alias("n"), F.sum("t").alias("t")).first()
    n, t = total["n"] or 0, total["t"] or 0
    # The corpus counts are scaled to the trusted total, so that both multinomials are
    # smoothed alike and a bucket with little evidence has a ratio near 1.
    expected = F.col("n") * (t / max(n, 1))
    log_ratio = F.log((F.col("t") + PSEUDO_COUNT) / (expected + PSEUDO_COUNT))
    buckets = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    filled = buckets.join(counts, "bucket", "left").fillna(0, ["n", "t"]).withColumn("ratio", log_ratio)
    pairs = F.sort_array(F.collect_list(F.struct("bucket", "ratio")))
    return stored(filled.agg(F.transform(pairs, lambda p: p["ratio"]).alias("ratios")), "ratios")


def quality_rules(
    docs: DataFrame,
    trusted: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``docs`` with ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words``, ``base_failed``, ``score`` and ``kept``, one row per row.

    The base fails for fewer than 50 words, or if over half of the words lie in
    three-word windows that occur twice or more in the text. ``score`` is 0 for a text
    without words, and ``kept`` is false where the base failed or the score is
    below ``threshold``. A null text has no words. Rows with a null id are scored
    like all others but are never trusted; repeated rows count each. If nothing is
    trusted, there is nothing to compare with: all scores are 0. Columns of ``docs``
    with the result's names are replaced.
    """
    ratios = ngram_ratios(docs, trusted, id_col, text_col)
    any_trusted = not trusted.isEmpty()
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]
    row = F.struct(*[c for c in docs.columns if c.lower() not in made]).alias("row")
    measured = base_measures(docs.select(row, F.col(text_col).alias("text")), "text").withColumn("__b", _ngrams("__h"))
    # A subquery can't stand inside a lambda, so the table becomes a column first.
    measured = measured.withColumn("__r", ratios.scalar())
    total = F.aggregate("__b", F.lit(0.0), lambda acc, b: acc + F.get("__r", b))
    score = F.when(F.size("__b") > 0, total / F.size("__b")).otherwise(0.0) if any_trusted else F.lit(0.0)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_SHARE * F.col("n_words"))
    return (
        measured.withColumn("score", _in_place(score))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
        .select("row.*", *made)
    )


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of documents labelled as good and not toxic."""
    return labels.filter("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id")
