"""Column names and ids from a header row."""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import groupby

from tablewash.table import collapse


@dataclass(frozen=True)
class Header:
    id: str
    name: str
    base: str
    blank: bool
    repeat: int


def slug(text: str) -> str:
    """Lower case letters and digits joined by single underscores."""
    return re.sub(r"[^a-z0-9]+", "_", text.lower()).strip("_") or "column"


def first_line(text: str) -> str:
    """The first non-blank line of a header cell."""
    return next((line.strip() for line in re.split(r"\r\n|\n", text) if line.strip()), "")


def _ranked(keys: list[str]) -> list[tuple[int, int]]:
    """For each key, the position of its first occurrence and its number among its equals."""
    found = [(0, 0)] * len(keys)
    for _, equal in groupby(sorted(range(len(keys)), key=lambda i: (keys[i], i)), key=lambda i: keys[i]):
        positions = list(equal)
        for number, position in enumerate(positions, 1):
            found[position] = (positions[0], number)
    return found


def normalize_headers(texts: list[str | None]) -> list[Header]:
    """Blank headers become ``Column``; a repeated name, ignoring case, gets
    `` (2)``, `` (3)``; ids are unique slugs of the name without that suffix."""
    clean = [collapse(text or "") for text in texts]
    labels = [text or "Column" for text in clean]
    names = _ranked([label.lower() for label in labels])
    bases = [labels[first] for first, _ in names]
    stems = [f"col_{slug(base)}" for base in bases]
    return [
        Header(
            id=stem if use == 1 else f"{stem}_{use}",
            name=base if repeat == 1 else f"{base} ({repeat})",
            base=base,
            blank=not text,
            repeat=repeat,
        )
        for text, base, stem, (_, repeat), (_, use) in zip(clean, bases, stems, names, _ranked(stems))
    ]
