"""Sharding, packing, chat formatting and the pipeline."""

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from check_oracle import compare, connect
from tablewash.llm.chat_format import escape, format_conversations, marked_turns, render_incrementally
from tablewash.llm.near_dedup import near_duplicates
from tablewash.llm.packing import Bins, copy_cluster, pack_documents, token_length
from tablewash.llm.sharding import interleaved_shards

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op1_near_dedup", "op6_sharding", "op8_chat_formatting", "op9_decontamination"])
def test_query_matches_sql(spark, name):
    assert compare(spark, connect(SMALL), SMALL, queries()[name], oracle_sql()[name]) is None


def test_every_operator_is_registered():
    names = [n for n in queries() if n.startswith("op") or n == "pipeline"]
    assert sorted(names, key=lambda n: (n == "pipeline", int(n[2:].split("_")[0]) if n != "pipeline" else 0)) == [
        "op1_near_dedup", "op2_quality_rules", "op3_language_id", "op4_best_fit_packing", "op5_token_counts",
        "op6_sharding", "op7_lm_scoring", "op8_chat_formatting", "op9_decontamination", "op10_quality_classifier",
        "op11_secret_scan", "op12_hard_negatives", "op13_spelling_variants", "pipeline",
    ]


def test_shards_match_the_mixture(spark):
    rows = [(i, "t", "hot" if i % 3 else f"s{i % 7}") for i in range(3000)]
    found = interleaved_shards(spark.createDataFrame(rows, "doc_id long, text string, source string"), 7).collect()
    counts = Counter(r.shard for r in found)
    assert max(counts.values()) - min(counts.values()) <= 1
    for shard in range(7):
        mine = [r for r in found if r.shard == shard]
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
    total = Counter(r.source for r in found)
    for source, n in total.items():
        each = Counter(r.shard for r in found if r.source == source)
        # Sources of one size tie at a rank, so a cut may fall among them.
        assert all(abs(each[s] - n / 7) <= len(total) for s in range(7))


def test_shards_of_messy_and_empty_tables(messy, empty):
    found = interleaved_shards(messy).collect()
    assert len(found) == messy.count() and {r.shard for r in found} <= set(range(16))
    assert {r.size for r in found if r.doc_id == 3} == {1} and {r.text_crc32 for r in found if r.doc_id == 3} == {0}
    assert interleaved_shards(empty).count() == 0


def naive_bin(bins, capacity, per_source, length, cluster, source):
    """The tightest compatible bin by looking at all of them."""
    fit = [
        (capacity - sum(x[0] for x in b), k)
        for k, b in enumerate(bins)
        if capacity - sum(x[0] for x in b) >= length
        and all(x[1] != cluster for x in b)
        and sum(x[2] == source for x in b) < per_source
    ]
    return min(fit)[1] if fit else len(bins)


def test_best_fit_finds_the_tightest_compatible_bin():
    import random

    rng = random.Random(1)
    pieces = sorted(((rng.randrange(1, 60), rng.randrange(12), rng.randrange(3)) for _ in range(400)), reverse=True)
    fast, bins = Bins(100, 2), []
    for piece in pieces:
        want = naive_bin(bins, 100, 2, *piece)
        got, offset = fast.place(*piece)
        if want == len(bins):
            bins.append([])
        assert got == want and offset == sum(x[0] for x in bins[want])
        bins[want].append(piece)


def check_packing(docs, found, capacity):
    rows = found.collect()
    per_bin = defaultdict(list)
    for r in rows:
        per_bin[r.group, r.bin].append(r)
    for pieces in per_bin.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.bin_offset):
            assert r.bin_offset == at
            at += r.n_tokens
        assert at <= capacity
    from tablewash.llm.packing import token_length

    want = docs.select("doc_id", token_length(F.col("text")).alias("n")).groupBy("doc_id").agg(F.sum("n").alias("n")).collect()
    total = Counter()
    for r in rows:
        total[r.doc_id] += r.n_tokens
    assert total == Counter({r.doc_id: r.n for r in want})
    return per_bin


def test_packing_conflicts_and_whole_texts(spark, small, messy, empty):
    docs = small.union(small.filter("doc_id < 40").withColumn("doc_id", F.col("doc_id") + 10_000))
    per_bin = check_packing(docs, pack_documents(docs, capacity=512, per_source=2, group_rows=100), 512)
    by_id = {r.doc_id: r for r in docs.collect()}
    for pieces in per_bin.values():
        texts = [" ".join(by_id[p.doc_id].text.lower().split()) for p in pieces]
        assert len(set(texts)) == len(texts)
        assert max(Counter(by_id[p.doc_id].source for p in pieces).values()) <= 2
    check_packing(messy, pack_documents(messy, capacity=64), 64)
    assert pack_documents(empty).count() == 0


def test_packed_near_copies_share_no_bin(spark, small):
    component = {r.doc_id: r.component_id for r in near_duplicates(small).collect()}
    assert len(set(component.values())) < len(component)
    per_bin = check_packing(small, queries()["op4_best_fit_packing"](spark, SMALL), 2048)
    for pieces in per_bin.values():
        names = [component[p.doc_id] for p in pieces]
        assert len(set(names)) == len(names)


def test_packing_moves_no_texts(spark, messy, tmp_path):
    """Known lengths and clusters need no text column, and op4 packs rows without id or words by their words."""
    docs = messy.select("doc_id", "source", token_length(F.col("text")).alias("length"), copy_cluster(F.col("text")).alias("own"))
    given = pack_documents(docs, cluster=F.col("own"), length=F.col("length"), capacity=64)
    check_packing(messy, given, 64)
    rows = [(k, "", "a") for k in range(3)] + [(None, " \n", "b"), (None, "one two", "b"), (None, "One  two", "c"), (5, "x y z", "c")]
    texts = spark.createDataFrame(rows, "doc_id long, text string, source string")
    texts.write.parquet(f"{tmp_path}/documents.parquet")
    found = queries()["op4_best_fit_packing"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id is None, r.n_tokens) for r in found) == [(False, 1)] * 3 + [(False, 4), (True, 1), (True, 3), (True, 3)]
    bins = defaultdict(list)
    for r in found:
        bins[r.bin].append(r.n_tokens)
    # Four empty texts are copies, and so are the two of one and two.
    assert all(n.count(1) <= 1 and n.count(3) <= 1 for n in bins.values())


def test_chat_spans_and_masks(spark):
    said = r"\### Assistant: </turn> ok"
    rows = [(1, 1, "assistant", said), (1, 0, "user", said), (2, 0, None, None), (None, 3, "a:b", "é\n"), (1, 1, "assistant", said)]
    found = {r.conv_id: r for r in format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    one = found[1]
    assert one.n_turns == 3 and one.rewritten_from is None
    assert [one.formatted[x["first"] : x["last"]] for x in one.loss] == [escape(said)] * 2
    assert found[2].formatted == "### : </turn>\n" and found[None].formatted == "### a\\:b: é\n</turn>\n"


def test_templates_that_rewrite_history_are_detected():
    def last_only(turns):
        return "".join(f"[{r}]{t if k == len(turns) - 1 else '...'}\n" for k, (r, t) in enumerate(turns))

    turns = [("user", "a"), ("assistant", "b")]
    output, spans, at = render_incrementally(turns, last_only)
    assert at == 1 and not spans and output == "[user]...\n[assistant]b\n"
    output, spans, at = render_incrementally(turns, marked_turns)
    assert at is None and [output[a:b] for a, b, _, _ in spans] == ["### user: a</turn>\n", "### assistant: b</turn>\n"]


def test_chat_tables(spark):
    empty = spark.createDataFrame([], "conv_id string, turn int, role string, text string, formatted int")
    assert format_conversations(empty).count() == 0
    many = [("c", k, "user" if k % 2 == 0 else "assistant", f"t{k}") for k in range(200)]
    r = format_conversations(spark.createDataFrame(many, "conv_id string, turn int, role string, text string")).first()
    assert r.n_turns == 200 and len(r.loss) == 100


def test_pipeline_stages(spark, small, labels):
    at = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{at}/documents.parquet")
    gone = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        kept = stage(spark, docs, at)
        assert kept.columns == docs.columns
        left = {r.doc_id for r in kept.select("doc_id").collect()}
        gone[name] = {r.doc_id for r in docs.select("doc_id").collect()} - left
        docs = docs.filter(F.col("doc_id").isin(list(left)))
    assert all(gone.values())
    good = spark.read.parquet(f"{at}/labels.parquet").filter("quality = 1 and toxic = 0")
    clean = {r.doc_id for r in good.collect()}
    assert len(gone["quality classifier"] & clean) <= 0.01 * len(clean)
    pieces = corpus_pipeline.STAGES[4][1](spark, docs, at)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_digest_of_conversations(spark):
    """The digests are those of the texts as they were given."""
    turns = spark.read.parquet(f"{SMALL}/conversations.parquet").orderBy("conv_id", "turn").collect()
    want = defaultdict(str)
    for r in turns:
        want[r.conv_id] += f"{r.role}\n{r.text or ''}\n"
    found = {r.conv_id: r.turns_sha256 for r in queries()["op8_chat_formatting"](spark, SMALL).collect()}
    assert all(found[i] == hashlib.sha256(t.encode()).hexdigest() for i, t in want.items()) and -7 in found
