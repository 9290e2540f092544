"""ECMAScript regular expressions for Spark, whose engine is java.util.regex.

Most syntax is shared. What differs (the meaning of ``$``, ``.``, ``\\s``,
``\\b``, some escapes, nested classes, names of groups) is rewritten here: once, on the driver,
for constant patterns, and once per distinct pattern of a task for patterns in columns.
Matching itself is always Spark's.
"""

from __future__ import annotations

import re
import sys
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewash import errors
from tablewash.errors import StepError
from tablewash.functions.cells import WHITESPACE_CLASS

# ECMAScript constructs and their java.util.regex spelling.
OUTSIDE_CLASS = {
    r"\s": f"[{WHITESPACE_CLASS}]",
    r"\S": f"[^{WHITESPACE_CLASS}]",
    r"\v": r"\x0B",
    r"\0": r"\x00",
    r"\b": r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))",
    r"\B": r"(?:(?<=[A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<![A-Za-z0-9_])(?![A-Za-z0-9_]))",
    "$": r"\z",
    ".": r"[^\n\r\u2028\u2029]",
    "[]": "(?!)",
    "[^]": r"[\s\S]",
}
INSIDE_CLASS = {
    r"\s": WHITESPACE_CLASS,
    r"\S": f"[^{WHITESPACE_CLASS}]",
    r"\v": r"\x0B",
    r"\0": r"\x00",
    r"\b": r"\x08",
    "[": r"\[",
    "&": r"\&",
}
# Letters that keep their meaning after a backslash; any other letter is itself.
ESCAPED_LETTERS = set("dDwWfnrtcxuk")

TOKEN = re.compile(
    r"""\\k<[^>]*>    # a reference to a named group
      | \\.            # an escape
      | \[\^?\]        # the empty class and its complement
      | \[\^?          # the start of a class
      | \(\?(?:[:=!]|<[=!]|<[A-Za-z_$][\w$]*>)?
      | \{\d+(?:,\d*)?\}
      | .""",
    re.VERBOSE | re.DOTALL,
)


@dataclass(frozen=True)
class JavaPattern:
    """A translated pattern, its number of groups, and what its named groups are called in Java."""

    pattern: str
    groups: int
    names: dict[str, str]


def _invalid(pattern: str, why: str) -> StepError:
    return StepError("invalidRegex", f"regular expression {pattern!r}: {why}")


def to_java(pattern: str) -> JavaPattern:
    """Translate one pattern, rejecting what ECMAScript rejects."""
    out: list[str] = []
    tokens = TOKEN.findall(pattern)
    named = [t[3:-1] for t in tokens if t.startswith("(?<") and t.endswith(">")]
    if len(set(named)) < len(named):
        raise _invalid(pattern, "two groups have one name")
    # Java's names are letters and digits only.
    names = {name: f"name{k}" for k, name in enumerate(named)}
    groups = 0
    in_class = False
    previous = ""
    for token in tokens:
        if token == "\\":
            raise _invalid(pattern, "ends with a backslash")
        known = (INSIDE_CLASS if in_class else OUTSIDE_CLASS).get(token)
        if known is not None:
            out.append(known)
        elif token.startswith("\\k<") and not in_class:
            if names and token[3:-1] not in names:
                raise _invalid(pattern, f"no group {token[3:-1]}")
            out.append(rf"\k<{names[token[3:-1]]}>" if names else token[1:])
        elif token[0] == "\\" and token[1].isalpha() and token[1] not in ESCAPED_LETTERS:
            out.append(token[1])
        elif in_class:
            # A class start matched as "[^" inside a class is two plain characters.
            out.append("\\" + token if token[0] == "[" else token)
            in_class = token[0] == "\\" or token[-1] != "]"
        elif token in ("[", "[^"):
            in_class = True
            out.append(token)
        elif token == "(?":
            raise _invalid(pattern, "unknown group")
        elif token == "(" or (token.startswith("(?<") and token.endswith(">")):
            groups += 1
            out.append(token if token == "(" else f"(?<{names[token[3:-1]]}>")
        elif token in ("{", "}"):
            out.append("\\" + token)
        elif token == "+" and (previous in ("+", "*", "?") or previous.startswith("{")):
            raise _invalid(pattern, "nothing to repeat")
        else:
            out.append(token)
        previous = token
    if in_class:
        raise _invalid(pattern, "unterminated character class")
    java = "".join(out)
    python = re.sub(r"\(\?<([A-Za-z_$])", r"(?P<\1", java).replace(r"\z", r"\Z")
    python = re.sub(r"\\k<(\w+)>", r"(?P=\1)", python).replace(r"\p{Z}", "")
    # Java looks behind over bounded lengths, Python over fixed ones: these are tested as looks ahead.
    if re.search(r"\(\?<[=!]", python):
        if _looks_behind_without_bound(tokens):
            raise _invalid(pattern, "a look-behind without a longest match is not supported")
        python = re.sub(r"\(\?<([=!])", r"(?\1", python)
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            re.compile(python)
    except (re.error, OverflowError, RecursionError) as error:
        raise _invalid(pattern, str(error)) from None
    return JavaPattern(java, groups, names)


def _looks_behind_without_bound(tokens: list[str]) -> bool:
    """Whether any look-behind holds a repetition without an upper bound."""
    open_: list[bool] = []
    in_class = False
    for token in tokens:
        if in_class:
            in_class = token[0] == "\\" or token[-1] != "]"
        elif token in ("[", "[^"):
            in_class = True
        elif token[0] == "(":
            open_.append(token in ("(?<=", "(?<!"))
        elif token == ")" and open_:
            open_.pop()
        elif any(open_) and (token in ("*", "+") or re.fullmatch(r"\{\d+,\}", token)):
            return True
    return False


REFERENCE = re.compile(r"\$(?:(\$)|(&)|(\d{1,2})|<([^>]*)>|([`']))|\\|\$")


@dataclass(frozen=True)
class Replacement:
    """A replacement in Java's spelling, cut where the text before (`` ` ``) or after (``'``) the match goes."""

    segments: list[str]
    around: list[str]


def replacement_to_java(text: str, java: JavaPattern) -> Replacement:
    """Translate ``$$``, ``$&``, ``$n``, ``$<name>``, `` $` `` and ``$'``; other text stays literal."""
    segments, around, at = [""], [], 0
    for match in REFERENCE.finditer(text):
        segments[-1] += text[at : match.start()]
        at = match.end()
        dollar, whole, digits, name, side = match.groups()
        if side:
            around.append(side)
            segments.append("")
        elif whole:
            segments[-1] += "$0"
        elif digits:
            used = next((d for d in (digits, digits[:1]) if 0 < int(d) <= java.groups), None)
            # Digits behind a group's number must not be read as part of it.
            tail = digits[len(used) :] if used else ""
            segments[-1] += (f"${int(used)}" + (f"\\{tail}" if tail else "")) if used else "\\$" + digits
        elif name is not None and java.names:
            segments[-1] += f"${{{java.names[name]}}}" if name in java.names else ""
        elif name is not None:
            segments[-1] += f"\\$<{name}>"
        else:
            segments[-1] += "\\$" if dollar or match.group() == "$" else "\\\\"
    segments[-1] += text[at:]
    return Replacement(segments, around)


def woven(text: Column, pattern: Column, segments: Column, around: Column) -> Column:
    """Every match of the Java ``pattern`` replaced by ``segments``, with the text before or after
    the match between them, as ``around`` says.

    Each match is marked in place together with its segments. Cut at the marks, the text is an
    array in which what lies between matches alternates with them, from which the original
    before and behind each match can be told. The marks hold the text's own digest, so
    that no text has them.
    """
    digest = F.md5(text)
    mark, cut = F.concat(F.lit("\ufdd0"), digest), F.concat(F.lit("\ufdd1"), digest)
    given = F.struct(
        text.alias("text"), pattern.alias("pattern"), segments.alias("segments"), around.alias("around"), mark.alias("mark"), cut.alias("cut")
    )
    # Each stage's value is bound by a list of one, so that it is computed once.
    marked = lambda g: F.struct(
        g["text"].alias("text"),
        g["around"].alias("around"),
        g["cut"].alias("cut"),
        F.split(F.regexp_replace(g["text"], g["pattern"], F.concat(g["mark"], F.lit("$0"), g["cut"], _joined(g["segments"], g["cut"]), g["mark"])), g["mark"], -1).alias("parts"),
    )
    return F.get(F.transform(F.transform(F.array(given), marked), _rewoven), F.lit(0))


def _rewoven(m: Column) -> Column:
    text, around, parts = m["text"], m["around"], m["parts"]

    def step(state: Column, i: Column) -> Column:
        record, between = F.split(F.get(parts, i), m["cut"], -1), F.get(parts, i + 1)
        found, said = F.get(record, F.lit(0)), F.slice(record, F.lit(2), F.size(record))
        after = F.substr(text, F.length(state["before"]) + F.length(found) + 1)
        side = lambda k: F.when(k == "`", state["before"]).when(k == "'", after).otherwise(F.lit(""))
        new = F.array_join(F.transform(said, lambda s, k: F.concat(s, side(F.coalesce(F.get(around, k), F.lit(""))))), "")
        return F.struct(
            F.concat(state["before"], found, between).alias("before"), F.concat(state["out"], new, between).alias("out")
        )

    first = F.get(parts, F.lit(0))
    places = F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: i % 2 == 1)
    return F.aggregate(places, F.struct(first.alias("before"), first.alias("out")), step, lambda state: state["out"])


def _joined(segments: Column, cut: Column) -> Column:
    """The segments with ``cut`` between them; an array's own join takes constants only."""
    return F.aggregate(
        F.slice(segments, F.lit(2), F.size(segments)), F.get(segments, F.lit(0)), lambda text, segment: F.concat(text, cut, segment)
    )


TRANSLATED = "struct<pattern:string,segments:array<string>,around:array<string>>"


def translated(pattern: Column, replacement: Column | None = None) -> Column:
    """Java's spelling of a column's patterns, and of replacements for them, as a struct TRANSLATED. It
    is null where a pattern or replacement is null, or where the pattern is invalid. Each distinct
    pair is translated once in a batch."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for patterns, replacements in batches:
            known: dict[tuple, tuple | None] = {}
            rows = []
            for pair in zip(patterns, replacements):
                if pair not in known:
                    known[pair] = _translated_pair(*pair)
                rows.append(known[pair])
            yield pd.DataFrame(rows, columns=["pattern", "segments", "around"])

    udf = F.pandas_udf(run, TRANSLATED)
    # Nulls must not reach the function as missing numbers.
    return F.when(pattern.isNotNull(), udf(pattern, F.lit("") if replacement is None else replacement))


def _translated_pair(pattern: str | None, replacement: str | None) -> tuple:
    nothing = (None, None, None)
    if not isinstance(pattern, str) or not isinstance(replacement, str):
        return nothing
    try:
        java = to_java(pattern)
    except StepError:
        return nothing
    parts = replacement_to_java(replacement, java)
    return java.pattern, parts.segments, parts.around


# Translation travels with the job: executors need no installed package.
for module in (sys.modules[__name__], errors):
    cloudpickle.register_pickle_by_value(module)
