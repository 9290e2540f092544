"""Text functions and text predicates, over whole texts."""

from pyspark.sql import functions as F

from registry.common import SQL_SPACE_CLASS, query, scan, sql_trim, table
from tablewash import Table
from tablewash import functions as fx
from tablewash.operators import Patch, derive_column, scoped_rule
from tablewash.plans import apply_steps


@query(
    f"""select doc_id, regexp_replace({sql_trim("text")}, '{SQL_SPACE_CLASS}+', ' ', 'g') as text, lower(lang) as lang,
      upper(source) as source from documents"""
)
def text_clean(spark, sf_dir):
    return apply_steps(
        table(spark, sf_dir, "documents", "doc_id"),
        [
            scoped_rule(["text"], default=Patch(lambda r, v: fx.collapse_whitespace(fx.trim(v)))),
            scoped_rule(["lang"], default=Patch(lambda r, v: fx.lower(v))),
            scoped_rule(["source"], default=Patch(lambda r, v: fx.upper(v))),
        ],
    ).df.select("doc_id", "text", "lang", "source")


@query(
    f"""with m as (select conv_id, turn, chr(160) || chr(8195) || text || chr(12288) || chr(9) as padded from conversations)
    select conv_id, turn, {sql_trim("padded")} as trimmed, md5(lower(text)) as lowered
    from m join conversations using (conv_id, turn)"""
)
def trim_unicode_spaces(spark, sf_dir):
    padded = F.concat(F.lit("\u00a0\u2003"), F.col("text"), F.lit("\u3000\t"))
    df = scan(spark, sf_dir, "conversations").select("conv_id", "turn", "text", padded.alias("padded"))
    out = apply_steps(
        Table.of(df, ["conv_id", "turn"]),
        [
            derive_column("trimmed", "trimmed", lambda r: fx.trim(r["padded"])),
            scoped_rule(["text"], default=Patch(lambda r, v: fx.lower(v))),
        ],
    )
    return out.df.select("conv_id", "turn", "trimmed", F.md5("text").alias("lowered"))


@query(
    """with m as (select page_id, url, case when page_id % 4 <> 0 then (page_id % 7 - 2)::double end as s from pages)
    select page_id, url[9:28] as middle, substring(url, 1, 4) as head,
      case when s is null then url else substring(url, greatest(s, 0)::int + 1, 6) end as moving,
      replace(url, '/', '|') as piped, replace(url, 'example.', '') as short from m"""
)
def substring_replace(spark, sf_dir):
    key = F.col("page_id")
    df = scan(spark, sf_dir, "pages").select(
        "page_id", "url", F.when(key % 4 != 0, (key % 7 - 2).cast("double")).alias("s")
    )
    return apply_steps(
        Table.of(df, "page_id"),
        [
            derive_column("middle", "middle", lambda r: fx.substring(r["url"], 8, 20)),
            derive_column("head", "head", lambda r: fx.substring(r["url"], -5, 4)),
            derive_column("moving", "moving", lambda r: fx.substring(r["url"], r["s"], 6)),
            derive_column("piped", "piped", lambda r: fx.replace(r["url"], "/", "|")),
            derive_column("short", "short", lambda r: fx.replace(r["url"], "example.", "")),
        ],
    ).df.select("page_id", "middle", "head", "moving", "piped", "short")


@query(
    r"""select page_id, nullif(regexp_extract(url, '[a-z]+\.example\.[a-z]+'), '') as host,
      nullif(regexp_extract(url, '\d+'), '') as number,
      nullif(regexp_extract(html, '<title>[^<]*</title>'), '') as title,
      regexp_replace(url, '(\w+)://([^/]+)', '\2 (\1)', 'g') as swapped,
      regexp_replace(html, '<[^>]*>', '', 'g') as plain,
      regexp_matches(url, 'page=\d+') as paged from pages"""
)
def regex_functions(spark, sf_dir):
    return apply_steps(
        table(spark, sf_dir, "pages", "page_id"),
        [
            derive_column("host", "host", lambda r: fx.extract_regex(r["url"], r"[a-z]+\.example\.[a-z]+")),
            derive_column("number", "number", lambda r: fx.extract_regex(r["url"], r"\d+")),
            derive_column("title", "title", lambda r: fx.extract_regex(r["html"], r"<title>[^<]*</title>")),
            derive_column("swapped", "swapped", lambda r: fx.replace_regex(r["url"], r"(\w+)://([^/]+)", "$2 ($1)")),
            derive_column("plain", "plain", lambda r: fx.replace_regex(r["html"], "<[^>]*>", "")),
            derive_column("paged", "paged", lambda r: fx.matches_regex(r["url"], r"page=\d+")),
        ],
    ).df.select("page_id", "host", "number", "title", "swapped", "plain", "paged")


@query(
    rf"""select doc_id, regexp_replace(text, '(^|[^0-9A-Za-z_])[A-Z]+', '\1<$>', 'g') as marked,
      regexp_matches(text, '[\x{{00a0}}\x{{2003}}]') as odd_space, regexp_matches(text, '\.{SQL_SPACE_CLASS}') as sentence_break,
      regexp_matches(text, '\.\z') as ends_in_dot from documents"""
)
def regex_dialect(spark, sf_dir):
    return apply_steps(
        table(spark, sf_dir, "documents", "doc_id"),
        [
            derive_column("marked", "marked", lambda r: fx.replace_regex(r["text"], r"(^|[^0-9A-Za-z_])[A-Z]+", "$1<$$>")),
            derive_column("odd_space", "odd_space", lambda r: fx.matches_regex(r["text"], "[\u00a0\u2003]")),
            derive_column("sentence_break", "sentence_break", lambda r: fx.matches_regex(r["text"], r"\.\s")),
            derive_column("ends_in_dot", "ends_in_dot", lambda r: fx.matches_regex(r["text"], r"\.$")),
        ],
    ).df.select("doc_id", "marked", "odd_space", "sentence_break", "ends_in_dot")


@query(
    """select doc_id, contains(text, 'the') as has_the, starts_with(text, 'The') as starts, ends_with(text, '.') as finishes,
      contains(text, source) as names_source, false as never from documents"""
)
def text_predicates(spark, sf_dir):
    return apply_steps(
        table(spark, sf_dir, "documents", "doc_id"),
        [
            derive_column("has_the", "has_the", lambda r: fx.contains(r["text"], "the")),
            derive_column("starts", "starts", lambda r: fx.starts_with(r["text"], "The")),
            derive_column("finishes", "finishes", lambda r: fx.ends_with(r["text"], ".")),
            derive_column("names_source", "names_source", lambda r: fx.contains(r["text"], r["source"])),
            derive_column("never", "never", lambda r: fx.contains(r["text"], None)),
        ],
    ).df.select("doc_id", "has_the", "starts", "finishes", "names_source", "never")


@query(
    f"""select doc_id, length(text)::double + length(regexp_replace(text, '[^\\x{{10000}}-\\x{{10ffff}}]', '', 'g')) as units,
      len(string_split(text, ' '))::double as words, len(string_split(text, chr(10)))::double as lines,
      string_split(text, ' ')[1] as first_word, string_split(text, ' ')[-1] as last_word,
      left(text, 1) as first_char, right({sql_trim("text")}, 1) as last_char from documents"""
)
def text_lengths_and_words(spark, sf_dir):
    words = lambda r: fx.split(r["text"], " ")
    wanted = {
        "units": lambda r: fx.length(r["text"]),
        "words": lambda r: fx.length(words(r)),
        "lines": lambda r: fx.length(fx.split(r["text"], "\n")),
        "first_word": lambda r: fx.first(words(r)),
        "last_word": lambda r: fx.last(words(r)),
        "first_char": lambda r: fx.first(r["text"]),
        "last_char": lambda r: fx.last(fx.trim(r["text"])),
    }
    steps = [derive_column(n, n, build) for n, build in wanted.items()]
    return apply_steps(table(spark, sf_dir, "documents", "doc_id"), steps).df.select("doc_id", *wanted)


@query(
    """with m as (select event_id, case when event_id % 3 <> 0 then event_type end as t, case when event_id % 4 = 0 then '' when event_id % 4 = 1 then ' '
        when event_id % 4 = 2 then props end as p, case when event_id % 5 <> 0 then value end as v from events)
    select event_id, coalesce(t, '') || coalesce(p, '') || '/' || event_id::varchar || case when v > 0 then 'true' else 'false' end as joined,
      case when p is null or p = '' then coalesce(t, '?') else p end as either, coalesce(v, -1) as v_or,
      case when p is not null and p <> '' then p when t is not null then t else 'none' end as any_of from m"""
)
def concat_coalesce(spark, sf_dir):
    key = F.col("event_id")
    df = scan(spark, sf_dir, "events").select(
        "event_id",
        F.when(key % 3 != 0, F.col("event_type")).alias("t"),
        F.when(key % 4 == 0, F.lit("")).when(key % 4 == 1, F.lit(" ")).when(key % 4 == 2, F.col("props")).alias("p"),
        F.when(key % 5 != 0, F.col("value")).alias("v"),
    )
    return apply_steps(
        Table.of(df, "event_id"),
        [
            derive_column("joined", "joined", lambda r: fx.concat(r["t"], r["p"], "/", r["event_id"], fx.greater_than(r["v"], 0))),
            derive_column("either", "either", lambda r: fx.coalesce(r["p"], fx.coalesce(r["t"], "?"))),
            derive_column("v_or", "v_or", lambda r: fx.coalesce(r["v"], -1)),
            derive_column("any_of", "any_of", lambda r: fx.coalesce(r["p"], r["t"], "none")),
        ],
    ).df.select("event_id", "joined", "either", "v_or", "any_of")




def _whole(units):
    """Text from a list of units in SQL, in which U+E000 begins a pair and U+E001 ends it; lone halves are U+FFFD."""
    joined = f"regexp_replace(array_to_string({units}, ''), '\\x{{E000}}(.)\\x{{E001}}', '\\1', 'g')"
    return f"replace(regexp_replace({joined}, '\\x{{E000}}.', chr(65533), 'g'), chr(57345), chr(65533))"


@query(
    f"""with m as (select doc_id, (doc_id % 9)::int as s, chr(119987) || replace(lang, 'e', chr(128512)) || source || chr(128512) as t from documents),
    u as (select *, flatten(list_transform(string_split(t, ''),
      lambda c: case when unicode(c) > 65535 then [chr(57344) || c, chr(57345)] else [c] end)) as u from m)
    select doc_id, len(u)::double as units, {_whole("u[s + 1:s + 3]")} as cut, {_whole("u[3:len(u) - 1]")} as inner_part,
      nullif({_whole("u[s + 2:s + 2]")}, '') as one, {_whole("u[1:1]")} as head, {_whole("u[len(u):]")} as tail from u"""
)
def text_units(spark, sf_dir):
    """Slices and indexes by UTF-16 units of texts beyond the basic plane."""
    text = F.concat(F.lit("\U0001d4b3"), F.replace(F.col("lang"), F.lit("e"), F.lit("\U0001f600")), "source", F.lit("\U0001f600"))
    df = scan(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 9).cast("double").alias("s"), text.alias("t"))
    wanted = {
        "units": lambda r: fx.length(r["t"]),
        "cut": lambda r: fx.substring(r["t"], r["s"], 3),
        "inner_part": lambda r: fx.substring(r["t"], 2, fx.subtract(fx.length(r["t"]), 3)),
        "one": lambda r: fx.at_index(r["t"], fx.add(r["s"], 1)),
        "head": lambda r: fx.first(r["t"]),
        "tail": lambda r: fx.last(r["t"]),
    }
    return apply_steps(Table.of(df, "doc_id"), [derive_column(n, n, f) for n, f in wanted.items()]).df.select("doc_id", *wanted)


@query(
    """select page_id, split_part(url, '://', 1) || '[' || split_part(url, '://', 1) || '|' || substring(url, strpos(url, '://') + 3) || ']'
        || substring(url, strpos(url, '://') + 3) as around,
      string_split(url, '/')[1] || array_to_string(list_transform(range(2, len(string_split(url, '/')) + 1),
        lambda i: '<' || array_to_string(string_split(url, '/')[1:i - 1], '/') || '>' || string_split(url, '/')[i]), '') as before,
      regexp_replace(url, '([a-z]+)([0-9])', '\\2-\\1', 'g') as named from pages"""
)
def regex_around_matches(spark, sf_dir):
    """Replacements with the text before and after a match, and with named groups."""
    return apply_steps(
        table(spark, sf_dir, "pages", "page_id"),
        [
            derive_column("around", "around", lambda r: fx.replace_regex(r["url"], "://", "[$`|$']")),
            derive_column("before", "before", lambda r: fx.replace_regex(r["url"], "/", "<$`>")),
            derive_column("named", "named", lambda r: fx.replace_regex(r["url"], "(?<the_word>[a-z]+)(?<n>[0-9])", "$<n>-$<the_word>")),
        ],
    ).df.select("page_id", "around", "before", "named")


@query(
    """with m as (select page_id, url, page_id % 6 as k from pages)
    select page_id, case k when 0 then nullif(regexp_extract(url, '[a-z]+'), '') when 1 then nullif(regexp_extract(url, '[0-9]+'), '')
        when 4 then nullif(regexp_extract(url, '/[^/]*$'), '') when 5 then '' end as found,
      coalesce(case k when 0 then true when 1 then regexp_matches(url, '[0-9]+') when 4 then regexp_matches(url, '/[^/]*$') when 5 then true end, false) as hit,
      case k when 0 then regexp_replace(url, '[a-z]+', '<0>', 'g') when 1 then regexp_replace(url, '[0-9]+', '<\\0>', 'g')
        when 4 then regexp_replace(url, '/[^/]*$', '$', 'g') when 5 then url else url end as changed from m"""
)
def regex_columns(spark, sf_dir):
    """Each row's own pattern and replacement, of which some are invalid or null."""
    k, patterns = F.col("page_id") % 6, ["[a-z]+", r"\d+", "(a", None, "/[^/]*$", "q*?"]
    texts = ["<0>", "<$&>", "x", "x", "$$", None]
    pick = lambda values: F.get(F.array(*[F.lit(v).cast("string") for v in values]), k.cast("int"))
    df = scan(spark, sf_dir, "pages").select("page_id", "url", pick(patterns).alias("p"), pick(texts).alias("r"))
    return apply_steps(
        Table.of(df, "page_id"),
        [
            derive_column("found", "found", lambda r: fx.extract_regex(r["url"], r["p"])),
            derive_column("hit", "hit", lambda r: fx.matches_regex(r["url"], r["p"])),
            derive_column("changed", "changed", lambda r: fx.replace_regex(r["url"], r["p"], r["r"])),
        ],
    ).df.select("page_id", "found", "hit", "changed")
