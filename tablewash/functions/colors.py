"""Fill colours of cells."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewash.errors import StepError

# Font colours for light and dark fills, the luminance weights
# and the luminance from which a fill counts as light.
DARK_FONT, LIGHT_FONT = "#1c1a17", "#fffdf9"
WEIGHTS = (0.2126, 0.7152, 0.0722)
LIGHT_FROM = 160


def is_valid_fill(fill: str) -> bool:
    return re.fullmatch(r"#[0-9a-fA-F]{6}", fill.strip()) is not None


def normalize_fill(fill: str) -> str:
    if not isinstance(fill, str) or not is_valid_fill(fill):
        raise StepError("invalidColor", f"{fill!r} is not a colour like '#ffeb9c'")
    return fill.strip().lower()


def readable_text_color(fill: Column) -> Column:
    """The font colour that stays readable on the fill."""
    channels = [F.conv(F.substring(fill, start, 2), 16, 10).cast("double") for start in (2, 4, 6)]
    luminance = sum(F.lit(weight) * channel for weight, channel in zip(WEIGHTS, channels))
    return F.when(luminance >= LIGHT_FROM, F.lit(DARK_FONT)).otherwise(F.lit(LIGHT_FONT))
