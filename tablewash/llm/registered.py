"""The registered queries of the operators, with SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewash.llm.class_model import class_model_scores
from tablewash.llm.chat_format import ESCAPE, HEADING, format_conversations
from tablewash.llm.decontamination import benchmark_overlap
from tablewash.llm.hard_negatives import hard_negatives
from tablewash.llm.language_id import identify_languages
from tablewash.llm.near_dedup import near_duplicates
from tablewash.llm.packing import copy_cluster, pack_documents, token_length
from tablewash.llm.quality_classifier import classify
from tablewash.llm.quality_rules import quality_rules, trusted_ids
from tablewash.llm.secret_scan import secret_spans
from tablewash.llm.sharding import SEED, interleaved_shards
from tablewash.llm.spelling import spelling_variants
from tablewash.llm.token_counts import token_counts
from tablewash.session import prepare_session

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(prepare_session(spark), sf_dir)

    QUERIES[build.__name__] = run
    return build


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


# Shingles of up to five words; pairs of texts with a common shingle; the smallest id reached.
SQL["op1_near_dedup"] = r"""
with recursive tokens as (
  select doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'),
    lambda w: w <> '') as w
  from documents),
shingles as (
  select distinct doc_id, unnest(case when len(w) = 0 then []
    when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s
  from tokens),
sizes as (select doc_id, count(*) as n from shingles group by all),
common as (
  select x.doc_id as a, y.doc_id as b, count(*) as c
  from shingles x join shingles y on x.s = y.s and x.doc_id <> y.doc_id group by all),
links as (
  select a, b from common join sizes p on a = p.doc_id join sizes q on b = q.doc_id
  where 100 * c >= 75 * (p.n + q.n - c)),
reached as (
  select doc_id as node, doc_id as root from tokens
  union select l.b, r.root from reached r join links l on l.a = r.node),
components as (select node, min(root) as component_id from reached group by all)
select t.doc_id, coalesce(n, 0)::bigint as n_shingles,
  coalesce(k.class_id, t.doc_id) as class_id, component_id, t.doc_id = component_id as kept
from tokens t join components c on c.node = t.doc_id left join sizes s on s.doc_id = t.doc_id
left join (
  select doc_id, min(doc_id) over (partition by list_sort(ss)) as class_id
  from (select doc_id, list(s) as ss from shingles group by all)) k on k.doc_id = t.doc_id
"""


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules(documents(spark, sf_dir).select("doc_id", "text"), trusted_ids(labels)).drop("text")


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(documents(spark, sf_dir))


@query
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    near = near_duplicates(docs).filter("n_shingles > 0").select("doc_id", F.concat(F.lit("c"), "component_id").alias("component"))
    # Rows that are in no component are copies by their words. What is needed of the texts
    # is taken from them before the join, which then moves a few numbers a row.
    length, alone = token_length(F.col("text")), F.col("doc_id").isNull() | (F.col("length") == 1)
    own = F.when(alone, copy_cluster(F.col("text")).cast("string"))
    measured = docs.withColumn("length", length).select("doc_id", "source", "length", own.alias("own"))
    return pack_documents(measured.join(near, "doc_id", "left"), cluster=F.coalesce("component", "own"), length=F.col("length"))


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


@query
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = interleaved_shards(documents(spark, sf_dir))
    return made.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


# The checksum's table by its rule (eight halvings, with the reversed polynomial
# 0xEDB88320 where a bit falls out), then one step per byte of the text.
SQL["op6_sharding"] = rf"""
with table_ as (
  select list(list_reduce([i] || range(8), lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)
    order by i) as t
  from range(256) r(i)),
checked as (
  select doc_id, source, coalesce(text, '') as s, hex(encode(coalesce(text, ''))) as h from documents),
bytes as (
  select doc_id, source, octet_length(encode(s)) as n,
    list_transform(range(1, length(h), 2), lambda i: ('0x' || h[i:i + 1])::bigint) as b
  from checked),
rows_ as (
  select doc_id, source, n + 1 as size, md5('{SEED}:' || doc_id) as k,
    xor(list_reduce([4294967295::bigint] || b, lambda c, x: xor(c // 256, t[xor(c, x) % 256 + 1])), 4294967295) as crc
  from bytes, table_),
ranked as (
  select *, (2 * row_number() over (partition by source order by k, doc_id) - 1)
    / (2 * count(*) over (partition by source)) as rank
  from rows_),
placed as (
  select *, row_number() over (order by rank, 's' || source, k, doc_id) - 1 as p, count(*) over () as n from ranked)
select doc_id, size::bigint as size, crc::bigint as text_crc32, 'rows' as law, (p * 16 // n)::int as shard,
  (p - ((p * 16 // n) * n + 15) // 16)::bigint as slot, null::int as grown_shard
from placed
"""


@query
def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_model_scores(documents(spark, sf_dir))


# A conversation whose texts hold the template's own control strings.
PROBE = "\\### Assistant: </turn> ok"


@query
def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], turns.schema)
    made = format_conversations(turns.union(probe))

    def part(first: Column, last: Column) -> Column:
        return F.substring("formatted", first + 1, last - first)

    def unescaped(text: Column) -> Column:
        return F.regexp_replace(text, ESCAPE, "$1")

    def turn(s: Column) -> Column:
        role = F.regexp_extract(part(s["first"], s["last"]), HEADING, 1)
        return F.concat(unescaped(role), F.lit("\n"), unescaped(part(s["text_first"], s["text_last"])), F.lit("\n"))

    trained = F.array_join(F.transform("loss", lambda s: unescaped(part(s["first"], s["last"]))), "")
    return made.select(
        "conv_id",
        "n_turns",
        F.sha2(F.array_join(F.transform("spans", turn), ""), 256).alias("turns_sha256"),
        F.length(trained).cast("long").alias("loss_chars"),
        F.sha2(trained, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL["op8_chat_formatting"] = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
said as (
  select *, length(regexp_replace(role, '[\\#<:]', '\\\0', 'g')) as role_chars,
    length(regexp_replace(text, '[\\#<:]', '\\\0', 'g')) as text_chars
  from turns)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length('### : </turn>') + 1 + role_chars + text_chars)::bigint as formatted_chars
from said group by conv_id
"""


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = benchmark_overlap(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), with_text=False)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


SQL["op9_decontamination"] = r"""
with words as (
  select 'd' as kind, doc_id as id, text from documents union all select 'b', item_id, text from benchmark),
tokens as (
  select kind, id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from words),
windows as (
  select distinct id as item_id, least(len(w), 10) as n,
    unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2),
      lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) as g
  from tokens where kind = 'b' and len(w) > 0),
places as (
  select id as doc_id, n, unnest(range(1, len(w) - n + 2)) as i,
    unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) as g
  from tokens, (select distinct n from windows) where kind = 'd' and len(w) >= n),
found as (select doc_id, i, p.n, item_id from places p join windows q on p.n = q.n and p.g = q.g),
hits as (
  select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + n)) as k from found) group by all),
items as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as s
  from (select distinct doc_id, item_id::varchar as item from found) group by all)
select t.id as doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit,
  coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(s, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 as contaminated
from tokens t left join hits h on h.doc_id = t.id left join items i on i.doc_id = t.id where kind = 'd'
"""


@query
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(documents(spark, sf_dir), labels, keep=["doc_id"])


@query
def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(documents(spark, sf_dir).select("doc_id", "text"))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "novel")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        "n_novel",
    )


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), label)


SQL["op12_hard_negatives"] = """
with rows_ as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as c
  from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scores as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as alike, list_inner_product(a.c, b.c)::bigint as score
  from rows_ a join rows_ b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scores where alike
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, (row_number() over w)::int as rank, vec_id as negative_id, positive_score, score as negative_score
from positives p join scores s using (anchor_id)
where not alike and 80 * positive_score <= 100 * score and score <= positive_score
window w as (partition by anchor_id, positive_id order by score desc, vec_id)
qualify row_number() over w <= 5
"""


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(documents(spark, sf_dir))


# The checksum as in op6. Words that are equal with one letter masked, or with one left
# out, are one edit apart.
SQL["op13_spelling_variants"] = r"""
with recursive table_ as (
  select list(list_reduce([i] || range(8), lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)
    order by i) as t
  from range(256) r(i)),
runs as (
  select coalesce(doc_id::varchar, '') as d, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) as run
  from documents),
counted as (
  select run, count(*) as c, hex(encode(d || ':' || run)) as x from runs where length(run) >= 5 group by d, run),
checked as (
  select run, c, xor(list_reduce([4294967295::bigint] || list_transform(range(1, length(x), 2), lambda i: ('0x' || x[i:i + 1])::bigint),
    lambda s, b: xor(s // 256, t[xor(s, b) % 256 + 1])), 4294967295) as h
  from counted, table_),
words as (
  select word, sum(c)::bigint as n
  from (select case when h % 97 = 0 then run[1:h % length(run)] || run[h % length(run) + 2:] else run end as word, c from checked)
  where length(word) >= 5 group by word having sum(c) >= 3),
places as (select word, n, unnest(range(1, length(word) + 1)) as i from words),
cut as (select word, n, word[1:i - 1] || '*' || word[i + 1:] as masked, word[1:i - 1] || word[i + 1:] as left_out from places),
near as (
  select distinct a.word, b.word as other, b.n from cut a join cut b on a.masked = b.masked and a.word <> b.word
  union select a.word, b.word, b.n from cut a join words b on a.left_out = b.word
  union select b.word, a.word, a.n from cut a join words b on a.left_out = b.word),
best as (
  select word, count(*) as n_near, first(other order by n desc, encode(other)) as other, max(n) as most from near group by word),
forms as (
  select w.word, w.n, coalesce(n_near, 0)::bigint as n_near, case when most >= 2 * w.n then other end as form,
    case when most >= 2 * w.n then most end as form_n
  from words w left join best b on w.word = b.word),
chain as (
  select word, word as at_ from forms
  union all select c.word, f.form from chain c join forms f on f.word = c.at_ where f.form is not null)
select f.word, f.form, c.at_ as root, f.n, f.n_near, f.form_n
from forms f join chain c on c.word = f.word join forms e on e.word = c.at_ and e.form is null
"""
