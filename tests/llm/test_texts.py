"""Quality rules, languages, token counts, scores and decontamination, each against
a plain computation, and on messy and empty tables."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablewash.llm import class_model, decontamination, language_id, quality_classifier, quality_rules, token_counts
from tablewash.llm.class_model import class_model_scores, exchange_classes
from tablewash.llm.decontamination import benchmark_overlap, without_contamination
from tablewash.llm.language_id import identify_languages
from tablewash.llm.quality_classifier import classify
from tablewash.llm.token_counts import Counter as TokenCounter
from tablewash.llm.words import is_space_free, utf8, words_of

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
PATH = public_tokenizers.path("word_bpe_49k.json")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_words_of_rows():
    texts = ["", "A bé", None, "c", "  ", "dé f\n"]
    data, offsets = utf8(pa.array(texts))
    w = words_of(data, offsets, is_space_free())
    assert [bytes(w.data[a:b]).decode() for a, b in zip(w.start, w.end)] == ["a", "bé", "c", "dé", "f"]
    assert w.row.tolist() == [1, 1, 3, 5, 5] and w.first.tolist() == [0, 0, 2, 2, 3, 3, 5]
    h = w.hashes()
    assert len(set(h.tolist())) == 5 and h.dtype == np.uint64


def base_rules(text):
    w = words(text)
    windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    count = Counter(windows)
    covered = {k + d for k, x in enumerate(windows) if count[x] > 1 for d in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered), failed


def test_base_measures_equal_brute_force(small, messy, spark):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    trusted = quality_rules.trusted_ids(labels)
    for docs in (small, messy):
        found = quality_rules.quality_rules(docs, trusted).collect()
        assert len(found) == docs.count()
        for r in found:
            got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
            assert got == base_rules(r.text), r.doc_id
            assert r.kept == (not r.base_failed and r.score >= quality_rules.THRESHOLD)


def test_ratio_equals_a_plain_count(spark, small):
    """Scores from counts over exploded n-grams, without the shared array."""
    ids = spark.createDataFrame([(i,) for i in range(0, 200, 3)], "doc_id long")
    ratios = quality_rules.ngram_ratios(small, ids, "doc_id", "text").first().ratios
    grams = (
        small.select("doc_id", F.transform(quality_rules.words(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))
        .select("doc_id", quality_rules._ngrams("h").alias("b"))
        .collect()
    )
    n, t = Counter(), Counter()
    for r in grams:
        n.update(r.b)
        if r.doc_id % 3 == 0 and r.doc_id < 200:
            t.update(r.b)
    scale, k = sum(t.values()) / sum(n.values()), quality_rules.PSEUDO_COUNT
    want = {r.doc_id: sum(math.log((t[b] + k) / (n[b] * scale + k)) for b in r.b) / max(len(r.b), 1) for r in grams}
    found = quality_rules.quality_rules(small, ids).select("doc_id", "score").collect()
    assert len(ratios) == quality_rules.BUCKETS
    assert all(abs(r.score - want[r.doc_id]) < 1e-9 for r in found)


def test_quality_rules_filter_stays_cheap_and_native(spark, small):
    ids = small.select("doc_id")
    kept = quality_rules.quality_rules(small, ids).filter("kept and n_repeat_words < 10")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert kept.count() > 0


def test_quality_rules_without_trusted_or_rows(spark, messy, empty):
    none = spark.createDataFrame([], "doc_id long")
    assert {r.score for r in quality_rules.quality_rules(messy, none).collect()} == {0.0}
    assert quality_rules.quality_rules(empty, none).count() == 0


def test_languages_of_held_out_texts(small, messy, empty):
    found = identify_languages(small).join(small, "doc_id").collect()
    held = [r for r in found if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in found)
    by_id = {r.doc_id: r for r in identify_languages(messy).collect()}
    assert {i for i, r in by_id.items() if r.lang_pred == "und"} == {3, 4, 5, 10}
    assert identify_languages(empty).count() == 0
    unlabelled = messy.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in identify_languages(unlabelled).collect()} == {"und"}


def test_every_labelled_language_is_learned(spark):
    """More than 64 languages, the last of them with fewer texts than all others."""
    rng = random.Random(3)
    rows = []
    for c in range(70):
        own = ["".join(chr(0x4E00 + 40 * c + rng.randrange(40)) for _ in range(3)) for _ in range(20)]
        rows += [(len(rows) + i, " ".join(rng.choice(own) for _ in range(15)), f"l{c:02}") for i in range(12 if c < 64 else 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = identify_languages(docs).join(docs, "doc_id").filter("held_out").collect()
    late = [r for r in found if r.lang >= "l64"]
    assert late and sum(r.lang_pred == r.lang for r in late) >= 0.9 * len(late)
    assert sum(r.lang_pred == r.lang for r in found) >= 0.9 * len(found)


@pytest.fixture(scope="module")
def counter():
    return TokenCounter(PATH)


def test_token_counts_equal_the_library(counter):
    rng = random.Random(2)
    library = Tokenizer.from_file(PATH)
    alphabet = "abrevlstmd'’ ''\n\t 19 .,!?éÉßİΣσςАZ中文　​½²Ⅷ🎉ẞﬁ<|>\x1c\x85"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(70))) for _ in range(3000)]
    texts += ["<|endoftext|> a", "a<|startoftext|>b'll", "", None, "'re've'll's't'm'd 're'r'v'l'rex", " '" * 300, "x" * 50_000]
    texts += [chr(rng.randrange(0xE000, 0x110000)) * 3 for _ in range(500)]
    want = [len(library.encode(t or "", add_special_tokens=False)) for t in texts]
    assert counter.counts(pa.array(texts, pa.string())).tolist() == want


def test_chunk_maps_compose(counter):
    """The scan over chunk maps gives the states that one run from the start gives."""
    rng = np.random.default_rng(1)
    kinds = rng.integers(0, token_counts.CLASSES, 64 * 50).astype(np.uint8).reshape(-1, 64)
    total = token_counts.scanned(token_counts.chunk_maps(kinds))
    state = 0
    for k, row in enumerate(kinds):
        for c in row:
            state = token_counts.STEP[state, c]
        assert total[k, 0] == state


def test_token_count_tables(messy, empty, messy_rows):
    found = token_counts.token_counts(messy, PATH).collect()
    assert len(found) == len(messy_rows)
    by_id = {r.doc_id: r for r in found}
    assert by_id[3].n_bytes == 0 and by_id[3].n_tokens == 0 and by_id[6].over_limit and not by_id[7].over_limit
    assert token_counts.token_counts(empty, PATH).count() == 0


def check_scores(docs):
    rows = docs.select("doc_id", "text").collect()
    tokens = [(r.doc_id, [*words((r.text or "").translate(LOWER)), None]) for r in rows]
    learned = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 != 0
    count = Counter(t for i, ts in tokens if learned(i) for t in ts)
    n, v = sum(count.values()), len(count)
    want = sorted(
        (i is None, i or 0, not learned(i), len(t), sum(count[x] > 0 for x in t), n,
         round(sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t), 5))
        for i, t in tokens
    )
    found = class_model_scores(docs).collect()
    got = sorted(
        (r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in found
    )
    assert got == want
    return found


def test_class_model_scores(small, messy, empty, monkeypatch):
    found = check_scores(small)
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(math.isfinite(r.score) and r.score < 0 for r in found)
    check_scores(messy)
    assert class_model_scores(empty).count() == 0


def test_words_travel_as_rows_of_buckets(spark, small, monkeypatch):
    """A block sends a row to a bucket, not one per word, and the number of buckets changes no score."""
    parts = class_model.blocks(small, "doc_id", "text")
    assert class_model._entries(parts, 3).count() == 3 * parts.count()
    one = {r.doc_id: r for r in class_model_scores(small).collect()}
    monkeypatch.setattr(class_model, "BUCKET_ENTRIES", 200)
    for r in class_model_scores(small).collect():
        assert r.n_known == one[r.doc_id].n_known and abs(r.base_score - one[r.doc_id].base_score) < 1e-6
        assert abs(r.score - one[r.doc_id].score) < 1e-6


def test_best_classes_weigh_every_neighbour(monkeypatch):
    """Gains from cells are those from whole rows of counts of neighbouring classes."""
    monkeypatch.setattr(class_model, "MOVE_CELLS", 7)
    rng = np.random.default_rng(8)
    classes, words_ = 6, 40
    near = rng.poisson(0.8, (words_, 2 * classes)).astype(float)
    near[5] = 0
    label = rng.integers(1, classes, words_)
    label[3] = 0
    pair = rng.integers(20, 400, (classes, classes)).astype(float)
    left, right, total = pair.sum(1), pair.sum(0), pair.sum()
    ratio = lambda n, expected: math.log(max(n, 0) / max(expected, 1e-9) + class_model.CHANCE)
    want = []
    for w in range(words_):
        into, out, a = near[w, :classes], near[w, classes:], label[w]
        gain = [
            sum(into[c] * ratio(pair[c, b], left[c] * right[b] / total) + out[c] * ratio(pair[b, c], left[b] * right[c] / total) for c in range(classes))
            for b in range(classes)
        ]
        gain[a] = sum(into[c] * ratio(pair[c, a] - into[c], left[c] * (right[a] - into.sum()) / total) for c in range(classes))
        gain[a] += sum(out[c] * ratio(pair[a, c] - out[c], (left[a] - out.sum()) * right[c] / total) for c in range(classes))
        best = max(range(1, classes), key=lambda b: gain[b])
        want.append(best if a > 0 and near[w].sum() and gain[best] > gain[a] + 1e-9 else a)
    word, cell = np.nonzero(near)
    got = class_model.best_classes(word, cell, near[word, cell], label, pair)
    assert got.tolist() == want and (got != label).any()


def test_class_model_is_a_distribution():
    """Transition rows sum to one, and so do a class's words with its share for unseen ones."""
    rng = np.random.default_rng(3)
    bigrams = rng.poisson(0.02, (class_model.UNITS, class_model.UNITS))
    t = class_model._tables(bigrams, np.ones(class_model.UNITS), class_model.UNITS)
    assert np.allclose((10.0**t.transition).sum(1), 1)
    assert t.label[class_model.END_UNIT] == 0 and (t.label[:-1] > 0).all()


def likelihood(n, label, classes):
    one = np.zeros((len(n), classes))
    one[np.arange(len(n)), label] = 1
    f = lambda x: (x * np.log(np.maximum(x, 1e-12))).sum()
    pair = one.T @ n @ one
    return f(pair) - f(pair.sum(0)) - f(pair.sum(1))


def test_exchange_ends_where_no_move_helps():
    rng = np.random.default_rng(4)
    # Two kinds of words that alternate, and an end.
    n = np.zeros((41, 41), dtype=np.int64)
    n[:20, 20:40] = rng.integers(5, 50, (20, 20))
    n[20:40, :20] = rng.integers(5, 50, (20, 20))
    label = exchange_classes(n, classes=6)
    assert not set(label[:20]) & set(label[20:40]) and label[40] == 0
    reached = likelihood(n, label, 6)
    for u in range(40):
        for c in range(1, 6):
            moved = label.copy()
            moved[u] = c
            assert likelihood(n, moved, 6) <= reached + 1e-6


def test_rare_words_leave_the_class_of_their_ending(spark):
    """Two kinds of words that alternate and all end alike, most of them not frequent."""
    rng = random.Random(6)
    kinds = [[f"{k}{i}xyz" for i in range(600)] for k in "ab"]
    rows = [(i, " ".join(rng.choice(kinds[n % 2]) for n in range(200))) for i in range(300)]
    found = class_model_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    held = [r for r in found if r.held_out]
    assert sum(r.score - r.base_score for r in held) > 0.2 * sum(r.n_tokens for r in held)


def overlap(texts, items, window=10):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = [
        (name, w[k : k + min(window, len(w))])
        for name, t in items
        if name is not None
        for w in [find(t)]
        for k in range(max(len(w) - window + 1, 1) if w else 0)
    ]
    for text in texts:
        w, hit, names = find(text), set(), set()
        for name, x in windows:
            for k in range(len(w) - len(x) + 1):
                if w[k : k + len(x)] == x:
                    hit |= set(range(k, k + len(x)))
                    names.add(str(name))
        yield len(w), len(hit), sorted(names)


@pytest.mark.parametrize("part_bytes", [decontamination.PART_BYTES, 60])
def test_overlap_equals_brute_force(spark, messy_rows, part_bytes):
    rng = random.Random(9)
    vocabulary = ["a", "b", "c", "Dé", "e1"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60))) for _ in range(60)]
    texts += ["", None, "-- ..", *(r[1] for r in messy_rows)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n))) for i, n in enumerate([4, 5, 6, 10, 11, 14])]
    items += [(20, "one, TWO"), (21, ""), (22, None), (None, "a b c"), (3, "c c c dé"), (20, "one, TWO")]
    docs = spark.createDataFrame(list(enumerate(texts)), "k long, text string").repartition(3)
    found = benchmark_overlap(docs, spark.createDataFrame(items, "item_id long, text string"), part_bytes=part_bytes)
    got = [(r.n_words, r.n_hit, list(r["items"])) for r in sorted(found.collect(), key=lambda r: r.k)]
    assert got == list(overlap(texts, items))


def test_longest_match_and_spans(spark):
    item = " ".join(f"q{i}" for i in range(30))
    text = "x y " + " ".join(f"q{i}" for i in range(5, 28)) + " z"
    docs = spark.createDataFrame([(text,)], "text string")
    r = benchmark_overlap(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).first()
    assert [tuple(s) for s in r.spans] == [(2, 23)] and tuple(r.longest) == ("1", 2, 23) and r.n_hit == 23


def longest(texts, items):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    parts = {}
    for name, t in items:
        w = find(t)
        for a in range(len(w)):
            for b in range(a + 1, len(w) + 1):
                x = tuple(w[a:b])
                parts[x] = min(parts.get(x, str(name)), str(name))
    for text in texts:
        w = find(text)
        have = [(a - b, a, parts[tuple(w[a:b])]) for a in range(len(w)) for b in range(a + 1, len(w) + 1) if tuple(w[a:b]) in parts]
        n, first, item = min(have, default=(None, None, None))
        yield n and (item, first, -n)


@pytest.mark.parametrize("part_bytes", [decontamination.PART_BYTES, 60])
def test_every_row_has_its_longest_match(spark, part_bytes):
    """Copies, shorter shares of the same passage and rows without a window, in one shard."""
    rng = random.Random(10)
    items = [(i, " ".join(f"q{rng.randrange(9)}" for _ in range(n))) for i, n in enumerate([4, 12, 15, 30])]
    passage = items[3][1].split()
    texts = [f"x {' '.join(passage[a:b])} y" for a, b in [(2, 22), (2, 22), (2, 17), (2, 7), (5, 22), (3, 4)]]
    texts += [" ".join(f"q{rng.randrange(10)}" for _ in range(40)) for _ in range(30)] + ["none", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "k long, text string").coalesce(1)
    found = benchmark_overlap(docs, spark.createDataFrame(items, "item_id long, text string"), part_bytes=part_bytes)
    got = [r.longest and tuple(r.longest) for r in sorted(found.collect(), key=lambda r: r.k)]
    assert got == list(longest(texts, items))


def test_decontamination_keeps_columns(spark, messy, empty):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    kept = without_contamination(messy, bench)
    assert kept.columns == messy.columns and kept.count() == messy.count() - 3
    assert without_contamination(empty, bench).count() == 0
    assert without_contamination(messy, bench.limit(0)).count() == messy.count()


def test_classifier_on_held_out_labels(spark):
    at = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    test = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    found = classify(docs, labels.filter(~test), keep=["doc_id"]).join(labels.filter(test), "doc_id").collect()
    clean = [r.kept for r in found if r.quality == 1 and r.toxic == 0]
    bad = [r.kept for r in found if r.quality == 0 or r.toxic == 1]
    assert sum(clean) >= 0.98 * len(clean) and sum(bad) <= 0.15 * len(bad)


def test_sites_shrink_toward_the_global_rate(spark):
    """A host with two bad documents moves less than one with two hundred."""
    rows = [("big", "big/", -3.0)] * 200 + [("tiny", "tiny/", -3.0)] * 2 + [("good", "good/", 3.0)] * 400
    sites = quality_classifier.site_rates(spark.createDataFrame(rows, "host string, path string, evidence double"))
    rate = {r.host: r.path_good for r in sites.collect()}
    assert rate["big"] < rate["tiny"] < rate["good"]


def test_classifier_on_messy_tables(messy, empty, labels):
    found = classify(messy, labels)
    assert found.count() == messy.count()
    assert {"host.test/sec"} <= {r.path for r in found.collect()}
    assert classify(messy, labels.limit(0)).filter("not kept").count() == 0
    assert classify(empty, labels).count() == 0


def test_classifier_sample_of_repeated_ids(spark):
    """An id on thousands of rows is one labelled document, the same one however rows are dealt out."""
    texts = [f"good words number {k} stand here" for k in range(40)] + [f"bad spam !!! number {k} buy $$$" for k in range(40)]
    rows = [(k, t, "en", "s") for k, t in enumerate(texts)] + [(k, f"{texts[k]} {j}", "en", "s") for k in (3, 43) for j in range(2500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    marks = spark.createDataFrame([(k, int(k < 40), 0) for k in range(80)], "doc_id long, quality int, toxic int")
    sample = quality_classifier.labelled_sample(docs, marks, "doc_id", "text")
    assert sample.count() == 80
    one, two = (quality_classifier.train(docs.repartition(n), marks) for n in (1, 7))
    assert (one.features == two.features).all() and np.allclose(one.weights, two.weights)
    found = classify(docs, marks)
    assert found.count() == len(rows)
    assert found.filter("doc_id >= 40 and kept").count() == 0


def test_selected_features_equal_a_plain_count(spark):
    rng = random.Random(7)
    rows = [(int(rng.random() < 0.6), sorted(rng.sample(range(-30, 30), 12))) for _ in range(900)]
    rows = [(good, [f for f in fs if f % 7 or not good or rng.random() < 0.4]) for good, fs in rows]
    n = [sum(g for g, _ in rows), sum(1 - g for g, _ in rows)]
    want = []
    for f in range(-30, 30):
        seen = [sum(f in fs for g, fs in rows if g == label) for label in (1, 0)]
        share, g = sum(seen) / len(rows), 0
        for s, total in zip(seen, n):
            for count, expected in ((s, total * share), (total - s, total * (1 - share))):
                g += 2 * count * math.log(max(count, 1e-9) / max(expected, 1e-9))
        if g >= quality_classifier.MIN_G and seen[0] * n[1] < seen[1] * n[0]:
            want.append(f)
    sample = spark.createDataFrame(rows, "good int, features array<long>")
    got = quality_classifier.selected_features(sample, *n)
    assert want and got.tolist() == sorted(f % (1 << 64) for f in want)


def test_languages_of_repeated_rows(spark):
    hot = next(k for k in range(50) if zlib.crc32(str(k).encode()) % 3 != 1)
    rows = [(hot, f"the same words {j}", "en") for j in range(5000)] + [(k, f"mots pareils {k}", "fr") for k in range(50, 120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(9)
    usable = docs.filter(f"doc_id = {hot} or doc_id > 60")
    chosen = language_id.smallest_ids(usable, "doc_id", "lang").collect()
    assert len(chosen) == len({(r.id, r.lang) for r in chosen}) == 60
    found = identify_languages(docs)
    assert found.count() == len(rows) and found.filter(f"doc_id = {hot} and lang_pred <> 'en'").count() == 0


def test_smallest_ids_equal_a_sort(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("l"), F.col("id") % 3).alias("lang"))
    want = set()
    rows = docs.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).collect()
    for lang in {r.lang for r in rows}:
        want |= {(r.doc_id, lang) for r in sorted((r for r in rows if r.lang == lang), key=lambda r: r.h)[: language_id.PER_LANGUAGE]}
    got = language_id.smallest_ids(docs.union(docs).repartition(13), "doc_id", "lang").collect()
    assert {(r.id, r.lang) for r in got} == want and len(got) == len(want)


def test_token_counts_equal_the_library_on_marks_and_capitals():
    rng, counter, library = random.Random(11), TokenCounter(PATH), Tokenizer.from_file(PATH)
    parts = ["İ", "\u20ec", "\u0307", "\u0345", "A", "É", "e\u0301", "'", "'re", "'s", "<|endoftext|>", "<|startof", "1", " ", "\n", "Σ", "ς", "ǅ", "ﬁ", "한", "\u1100\u1161"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(4000)]
    ranges = [(0x20, 0x7F), (0x300, 0x370), (0xC0, 0x250), (0x370, 0x530), (0x4E00, 0x4F00), (0x1F600, 0x1F650), (0x20D0, 0x20F0)]
    texts += ["".join(chr(rng.randrange(*rng.choice(ranges))) for _ in range(rng.randrange(14))) for _ in range(4000)]
    texts += ["İ\u20ec", "x" * 20_000, "the" * 3000, ""]
    want = [len(e) for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    assert counter.counts(pa.array(texts)).tolist() == want


def test_other_tokenizers_are_refused(tmp_path):
    import json

    made = json.load(open(PATH))
    for change in ({"normalizer": None}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": made["model"] | {"end_of_word_suffix": None}}):
        path = tmp_path / "other.json"
        path.write_text(json.dumps(made | change))
        with pytest.raises(ValueError):
            TokenCounter(str(path))
