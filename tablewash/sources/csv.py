"""CSV files: typed by their content, null and quoted empty text kept apart.

Files are read by physical lines, so they are split between tasks. A line alone
does not tell whether it begins inside quotes; what it does to either state is a map
of two states, and these maps compose. One reading takes each line for a record that
begins outside, and finds for every file whether any line leaves a quote open, the place
of its header, its widest row and the kinds of cells in each column. If no line
does, this was right, and the second reading is that of the data. Otherwise the maps
are composed within splits, then over the splits of a file, and the lines of records
that span several are put together; the records are stored, and all else is read
from there. If one of the first lines leaves a quote open, the first reading is left out.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewash.errors import StepError
from tablewash.functions import cells
from tablewash.reports.profile import CODE, column_types, text_kind, type_from_kinds
from tablewash.session import discard, stored
from tablewash.sources.headers import Header, normalize_headers
from tablewash.table import OrderKey, Table

# Fixed value: what a number looks like.
NUMBER = r"^-?(?:0|[1-9]\d*)(?:\.\d+)?\z"
# One field with the comma before it; possessive, so that long fields are safe.
QUOTED = r'"[^"]*+(?:""[^"]*+)*+'
FIELD = rf",(?:{QUOTED}\"?[^,]*+|[^,]*+)"
# A line that begins outside quotes and ends inside: whole fields, then one left open.
OPENS = rf'^(?:,(?:{QUOTED}"[^,"]*+(?=,|\z)|(?!")[^,]*+(?=,|\z)))*+,{QUOTED}\z'
# What of a line that begins inside quotes lies within them.
INSIDE = r'^[^"]*+(?:""[^"]*+)*+'
# Header rows of a folder that are compared with each other.
MAX_HEADERS = 1000
# Lines of one record. A quote that is never closed makes one record of all lines behind it.
MAX_RECORD_LINES = 100_000
# First lines that are looked at for open quotes before all are read.
PROBE_LINES = 2_000


@dataclass(frozen=True)
class CsvImport:
    """An imported file: its table and what was noticed about its headers."""

    table: Table
    headers: tuple[Header, ...]


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    width: int | None = None,
    types: dict[str, str] | None = None,
    max_record_lines: int = MAX_RECORD_LINES,
) -> Table:
    """One CSV file, or a folder of files with the same columns, as a table.

    Blank lines are rows of nulls, quoted fields may hold line breaks, and a file
    is read by several tasks if it is large. One reading finds the header, the number of
    columns and their types, and another gives the data; ``types`` (by column id) save
    the kinds of cells. A record of more than ``max_record_lines`` lines, as after a stray quote,
    fails the import. Files of a folder
    may have their columns in different orders. A row that is wider than ``width``, or a cell that does not have its given
    type, fails the job; files whose headers name other columns fail the import. Files
    without any line give an empty table.
    """
    return import_csv(spark, path, width, types, max_record_lines).table


def import_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    width: int | None = None,
    types: dict[str, str] | None = None,
    max_record_lines: int = MAX_RECORD_LINES,
) -> CsvImport:
    lines = _lines(spark, path if isinstance(path, str) else list(path))
    records = lines
    found = None if _opens_early(lines) else _survey(lines, types is None)
    spanning = found is None or found.opens > 0
    if spanning:
        # Records are put together from several readings of the lines; their patterns run once.
        marked = stored(lines, "lines")
        records = stored(_joined(marked, max_record_lines), "records").withColumn("opens", F.lit(False))
        discard(marked)
        found = _survey(records, types is None, True)
    kinds = None
    if found.settled:
        header, orders = _header(spark, [found.header] if found.header is not None else [])
        texts = F.lit(found.header)
        body = records.filter(~F.coalesce((F.col("text") == texts) & (F.col("__block") == 0), F.lit(False)))
        widest, kinds = found.width, found.kinds
    else:
        # Headers that differ in their text, or rows that repeat one: look at each file's first row.
        firsts = records.groupBy("__file").agg(F.min_by("text", F.struct("__block", "__row_id")).alias("text"))
        texts = [r["text"] for r in firsts.select("text").distinct().limit(MAX_HEADERS + 1).collect()]
        header, orders = _header(spark, texts)
        body = _below_headers(records, texts)
        widest = body.agg(F.max(F.size(_cells(F.col("text"))))).first()[0] if width is None else width
        if len(set(orders.values())) > 1:
            body = body.join(_places(spark, firsts, orders), "__file")
    fields = _cells(F.col("text"))
    if "places" in body.columns:
        # The header's fields in the common order, and then those beyond the header.
        rest = F.slice(fields, F.lit(len(header) + 1), F.size(fields))
        sorted_ = F.concat(F.transform("places", lambda p: F.get(fields, p)), rest)
        fields = F.when(F.size("places") > 0, sorted_).otherwise(fields)
    body = body.select(fields.alias("f"), "__file", "__block", "__row_id")
    width = max(len(header), (widest or 0) if width is None else width)
    headers = normalize_headers(header + [None] * (width - len(header)))
    wide = F.raise_error(F.format_string(f"a row has %d fields, and the given width is {width}", F.size("f"))).cast("string")
    columns = [F.get("f", F.lit(i)) for i in range(width)]
    if columns:
        columns[0] = F.when(F.size("f") > width, wide).otherwise(columns[0])
    raw = body.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)], "__file", "__block", "__row_id")
    inferred = types or _inferred(spark, raw, headers, kinds)
    checked = types is not None
    typed = raw.select(
        *[_typed(F.col(f"c{i}"), inferred[h.id], checked).alias(h.id) for i, h in enumerate(headers)],
        "__file", "__block", "__row_id",
    )
    table = Table.of(typed, "__row_id", names={h.id: h.name for h in headers}, types=inferred)
    keys = tuple(OrderKey(n, n) for n in ("__file", "__block", "__row_id"))
    # The splits of one file are read in order, unless lines were put together.
    in_order = not spanning and _is_one_file(spark, path)
    return CsvImport(replace(table, order=keys, in_order=in_order), tuple(headers))


@dataclass(frozen=True)
class _Survey:
    """What one reading of lines, or of records, says if each is a record. ``kinds`` has the codes of
    the cells of each of the header's columns; ``settled`` says that all files begin with
    the text ``header``, and that no other of their rows is equal to it."""

    opens: int
    settled: bool
    header: str | None
    width: int
    kinds: list[int | None]


def _opens_early(lines: DataFrame) -> bool:
    """Whether one of the first lines leaves a quote open, so that lines are known not to be records."""
    return any(r["opens"] for r in lines.select("opens").take(PROBE_LINES))


def _survey(lines: DataFrame, with_kinds: bool, stored_: bool = False) -> _Survey:
    # Any file's first line, from the first of the splits that begin a file.
    firsts = lines.filter("__block = 0").select("text", F.size(_cells(F.col("text"))).alias("n"), "__file", "__row_id")
    head = (firsts.orderBy("__file", "__row_id") if stored_ else firsts).first()
    if head is None:
        return _Survey(0, True, None, 0, [])
    alike = (F.col("text") == F.lit(head["text"])) & (F.col("__block") == 0)
    rows = lines.select("__file", "__block", "__row_id", "opens", alike.alias("alike"), _cells(F.col("text")).alias("f"))
    kinds = [F.when(~F.col("alike"), _kind(F.get("f", F.lit(i)))).alias(f"k{i}") for i in range(head["n"] if with_kinds else 0)]
    first, row = F.col("__block") == 0, F.col("__row_id")
    coded = rows.select(
        "__file",
        "opens",
        F.when(first, row).alias("first"),
        F.when(F.col("alike"), row).alias("guess"),
        F.when(~F.col("alike"), F.size("f")).alias("size"),
        *kinds,
    )
    bits = [F.bit_or(f"k{i}").alias(f"k{i}") for i in range(len(kinds))]
    files = coded.groupBy("__file").agg(
        F.count_if("opens").alias("opens"), F.min("first").alias("first"), F.min("guess").alias("guess"),
        F.count("guess").alias("alike"), F.max("size").alias("size"), *bits,
    )
    other = ~F.col("first").eqNullSafe(F.col("guess"))
    total = files.agg(
        F.sum("opens").alias("opens"), F.count_if(other | (F.col("alike") > 1)).alias("other"), F.max("size").alias("size"), *bits
    ).first()
    return _Survey(total["opens"], total["other"] == 0, head["text"], total["size"] or 0, [total[f"k{i}"] for i in range(len(kinds))])


def _is_one_file(spark: SparkSession, path: str | Sequence[str]) -> bool:
    if not isinstance(path, str):
        return False
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.exists(place) and files.getFileStatus(place).isFile()


def _lines(spark: SparkSession, path) -> DataFrame:
    """``(text, sep, opens, closes, __file, __block, __row_id)`` of every physical line.
    A line ends with CR, LF or both; ``opens`` and ``closes`` say whether it leaves
    the state outside and inside quotes."""
    read = spark.read.option("lineSep", "\n").text(path)
    ends = F.col("value").endswith("\r")
    body = F.when(ends, F.expr("substring(value, 1, length(value) - 1)")).otherwise(F.col("value"))
    last = F.when(ends, F.lit("\r\n")).otherwise(F.lit("\n"))
    pieces = F.split("body", "\r")
    each = F.transform(
        pieces, lambda p, i: F.struct(p.alias("text"), F.when(i < F.size(pieces) - 1, F.lit("\r")).otherwise(F.col("last")).alias("sep"))
    )
    whole = F.array(F.struct(F.col("body").alias("text"), F.col("last").alias("sep")))
    origin = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block")]
    text = F.col("text")
    after = F.expr(f"regexp_replace(text, r'{INSIDE}', '')")
    quotes = text.contains('"')
    return (
        read.select(body.alias("body"), last.alias("last"), *origin)
        .select(F.explode(F.when(F.col("body").contains("\r"), each).otherwise(whole)).alias("p"), "__file", "__block")
        .select("p.text", "p.sep", "__file", "__block", F.monotonically_increasing_id().alias("__row_id"))
        .withColumns(
            {
                "opens": quotes & F.concat(F.lit(","), text).rlike(OPENS),
                # From inside, the line must have a closing quote, and not open another.
                "closes": quotes & (after != "") & ~F.concat(F.lit(',"'), after).rlike(OPENS),
            }
        )
    )


def _joined(lines: DataFrame, most: int) -> DataFrame:
    """``(text, __file, __block, __row_id)`` of records, from lines of which some leave a
    quote open. Lines are dealt out by split; only what spans lines is grouped, and a
    record of more than ``most`` lines fails the job before its lines are gathered."""
    split = Window.partitionBy("__file", "__block").orderBy("__row_id").rowsBetween(Window.unboundedPreceding, 0)
    # A line sets the state (both ways end alike), keeps it, or swaps it.
    odd = lambda n: (n % 2) == 1
    xor = lambda a, b: a != b
    swaps = F.col("opens") & F.col("closes")
    sets = F.when(F.col("opens") != ~F.col("closes"), F.lit(None).cast("boolean")).otherwise(F.col("opens"))
    counted = lines.withColumn("swaps", F.sum(swaps.cast("int")).over(split)).withColumn(
        "set", F.last(xor(sets, odd(F.col("swaps"))), ignorenulls=True).over(split)
    )
    ends = counted.groupBy("__file", "__block").agg(F.max_by(F.struct("swaps", "set"), "__row_id").alias("e"))
    file = Window.partitionBy("__file").orderBy("__block").rowsBetween(Window.unboundedPreceding, 0)
    total = ends.withColumn("swaps", F.sum("e.swaps").over(file))
    value = xor(xor(F.col("e.set"), odd(F.col("e.swaps"))), odd(F.col("swaps")))
    total = total.withColumn("set", F.last(value, ignorenulls=True).over(file))
    open_after = xor(F.coalesce("set", F.lit(False)), odd(F.col("swaps")))
    before = F.lag(open_after, 1, False).over(Window.partitionBy("__file").orderBy("__block"))
    starts = total.select("__file", "__block", before.alias("begins_open"))
    placed = counted.join(starts, ["__file", "__block"])
    after = xor(F.coalesce("set", "begins_open"), odd(F.col("swaps")))
    place = Window.partitionBy("__file", "__block").orderBy("__row_id")
    placed = placed.withColumn("after", after).withColumn(
        "inside", F.coalesce(F.lag("after").over(place), F.col("begins_open"))
    )
    here = F.struct(F.col("__block").alias("b"), F.col("__row_id").alias("r"))
    start = F.last(F.when(~F.col("inside"), here), ignorenulls=True)
    placed = placed.withColumn("start", start.over(split))
    # A record that began in an earlier split: its start is the last one there.
    lasts = placed.groupBy("__file", "__block").agg(F.max("start").alias("start"))
    earlier = Window.partitionBy("__file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select("__file", "__block", F.last("start", ignorenulls=True).over(earlier).alias("carried"))
    placed = placed.join(carried, ["__file", "__block"]).withColumn("start", F.coalesce("start", "carried"))
    alone = placed.filter("not inside and not after").select("text", "__file", "__block", "__row_id")
    parts = F.array_sort(F.collect_list(F.struct("__block", "__row_id", "text", "sep")))
    said = F.transform(
        F.col("parts"), lambda p, i: F.concat(p["text"], F.when(i < F.size("parts") - 1, p["sep"]).otherwise(F.lit("")))
    )
    number = F.row_number().over(Window.partitionBy("__file", "start").orderBy("__block", "__row_id"))
    long = F.raise_error(F.format_string(f"recordTooLong: a quoted field in %s spans more than {most} lines", F.col("__file"))).cast("string")
    spanning = (
        placed.filter("inside or after")
        .withColumn("text", F.when(number > most, long).otherwise(F.col("text")))
        .groupBy("__file", "start")
        .agg(parts.alias("parts"))
        .select(F.array_join(said, "").alias("text"), "__file", F.col("start.b").alias("__block"), F.col("start.r").alias("__row_id"))
    )
    return alone.union(spanning)


def _cells(text: Column) -> Column:
    """The contents of a record's fields: null where a field is unquoted and empty."""
    plain = F.transform(F.split(text, ",", -1), lambda x: F.nullif(x, F.lit("")))
    quoted = F.transform(F.regexp_extract_all(F.concat(F.lit(","), text), F.lit(FIELD), F.lit(0)), _content)
    return F.when(text.contains('"'), quoted).otherwise(plain)


def _content(field: Column) -> Column:
    """A field's text, from the field with the comma before it. What follows a closing quote
    belongs to the text."""
    parts = rf'(?s)^,({QUOTED})"?(.*)$'
    inner = F.replace(F.substring(F.regexp_extract(field, parts, 1), 2, 2**31 - 1), F.lit('""'), F.lit('"'))
    quoted = F.concat(inner, F.regexp_extract(field, parts, 2))
    # Most quoted fields are empty, or are closed at their end and hold no quote.
    whole = F.substring(field, 3, 2**31 - 1)
    bare = F.substring(field, F.lit(3), F.length(field) - 3)
    simple = field.endswith('"') & (F.length(field) > 2) & ~bare.contains('"')
    opened = F.when(F.length(whole) == 0, F.lit("")).when(simple, bare).otherwise(quoted)
    return F.when(field.startswith(',"'), opened).when(field != ",", F.substring(field, 2, 2**31 - 1))


def _header(spark: SparkSession, texts: list[str]) -> tuple[list[str | None], dict[str, tuple[int, ...]]]:
    """The header's cells, and for each header row where its fields are of the common columns. All
    header rows must name the same columns, in whatever order: that of the row that sorts first."""
    if not texts:
        return [], {}
    if len(texts) > MAX_HEADERS:
        raise StepError("headerMismatch", f"the files have over {MAX_HEADERS} different headers")
    rows = spark.createDataFrame([(t,) for t in sorted(texts)], "text string")
    found = rows.select("text", _cells(F.col("text")).alias("f")).collect()
    ids = {r["text"]: [h.id for h in normalize_headers(list(r["f"]))] for r in found}
    first = ids[found[0]["text"]]
    other = next((i for i in ids.values() if sorted(i) != sorted(first)), None)
    if other is not None:
        raise StepError("headerMismatch", f"the files have different columns, such as {first} and {other}")
    return list(found[0]["f"]), {text: tuple(own.index(i) for i in first) for text, own in ids.items()}


def _places(spark: SparkSession, firsts: DataFrame, orders: dict[str, tuple[int, ...]]) -> DataFrame:
    """``(__file, places)``: where each file has the fields of the common columns, from its first row; an
    empty array where it has them in their order."""
    rows = [(text, list(order) if list(order) != sorted(order) else []) for text, order in orders.items()]
    return firsts.join(F.broadcast(spark.createDataFrame(rows, "text string, places array<int>")), "text").select("__file", "places")


def _below_headers(records: DataFrame, texts: list[str]) -> DataFrame:
    """The records without the first one of each file. A header is in its file's first
    split; a later row there may be equal to it."""
    alike = F.coalesce(F.col("text").isin(texts) & (F.col("__block") == 0), F.lit(False))
    per_file = records.filter(alike).groupBy("__file").agg(F.count("*").alias("n"), F.min("__row_id").alias("__row_id"))
    if per_file.filter("n > 1").isEmpty():
        return records.filter(~alike)
    return records.join(per_file.select("__file", "__row_id"), ["__file", "__row_id"], "left_anti")


def _is_boolean(raw: Column) -> Column:
    return F.lower(raw).isin("true", "false")


def _kind(raw: Column) -> Column:
    """Code of a field: typed by its text alone, quoted or not."""
    leading = F.substring(raw, 1, 1)
    numeric = ((leading == "-") | leading.between("0", "9")) & raw.rlike(NUMBER)
    boolean = F.length(raw).between(4, 5) & _is_boolean(raw)
    return F.when(numeric, CODE["number"]).when(boolean, CODE["boolean"]).otherwise(text_kind(raw))


def _inferred(spark: SparkSession, raw: DataFrame, headers: list[Header], kinds: list[int | None] | None) -> dict[str, str]:
    """Column types from the kinds found so far; columns beyond these take one more pass over their cells."""
    known = dict(zip((h.id for h in headers), kinds or []))
    found = {}
    if known:
        codes = spark.createDataFrame(list(known.items()), "id string, kinds int")
        found = {r["id"]: r["t"] for r in codes.select("id", type_from_kinds(F.col("kinds")).alias("t")).collect()}
    rest = {h.id: _kind(F.col(f"c{i}")) for i, h in enumerate(headers) if h.id not in known}
    if rest:
        found |= {r["column_id"]: r["logical_type"] for r in column_types(raw, rest).collect()}
    return found


def _typed(raw: Column, kind: str, checked: bool) -> Column:
    """The cell in its column's type; a given type that does not fit fails the job."""

    def fitting(value: Column, spark_type: str) -> Column:
        if not checked:
            return value
        wrong = F.raise_error(F.format_string(f"%s is no {kind}", raw)).cast(spark_type)
        return F.when(raw.isNull() | value.isNotNull(), value).otherwise(wrong)

    if kind == "boolean":
        return fitting(F.when(_is_boolean(raw), F.lower(raw) == "true"), "boolean")
    if kind == "number":
        return fitting(F.when(raw.rlike(NUMBER), raw.try_cast("double")), "double")
    if kind == "unknown":
        return fitting(F.lit(None).cast("string"), "string")
    if kind != "mixed":
        return raw
    boolean, numeric = _is_boolean(raw), raw.rlike(NUMBER)
    tag = F.when(boolean, F.lit("b")).when(numeric, F.lit("n")).otherwise(F.lit("s"))
    tagged = F.struct(
        tag.alias("k"),
        F.when(tag == "s", raw).alias("s"),
        F.when(tag == "n", raw.try_cast("double")).alias("n"),
        F.when(tag == "b", F.lower(raw) == "true").alias("b"),
    )
    return F.when(raw.isNotNull(), tagged).cast(cells.MIXED)
