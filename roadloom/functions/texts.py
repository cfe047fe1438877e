"""Wording of numbers and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def duration(seconds: Column) -> Column:
    """12.34s, 3m 4.50s or 1h 2m 3.00s."""
    whole = F.floor(seconds / 60)
    rest = seconds - 60 * whole
    return F.when(seconds < 60, F.format_string("%.2fs", seconds)).when(whole < 60, F.format_string("%dm %.2fs", whole, rest)).otherwise(F.format_string("%dh %dm %.2fs", F.floor(whole / 60), F.pmod(whole, F.lit(60)), rest))


def slug(name: Column) -> Column:
    """Lower case with underscores for white space, as file names have it."""
    return F.regexp_replace(F.lower(F.trim(name)), r"\s+", "_")
