"""Monetary amounts in text, in millions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULTS

# The three amount patterns (unit with dollar sign, bare dollars, unit without sign).
PATTERNS = (
    r"(?iU)\$[\d,]+(?:\.\d+)?\s*(?:trillion|billion|million|[TtBbMm])\b",
    r"(?iU)\$[\d,]+(?:\.\d+)?(?=\s|,|\.|$)",
    r"(?iU)\b[\d,]+(?:\.\d+)?\s*(?:trillion|billion|million|[TtBbMm])\b",
)


def to_millions(text: Column) -> Column:
    """One amount in millions; a bare number counts as millions; null if it can't be read."""
    plain = F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), r"[,$ ]", "")
    number = lambda unit: F.expr("double(null)") if unit is None else F.regexp_extract(plain, unit, 1).try_cast("double")
    billion, trillion, million, bare = r"^([\d.]+)[Bb](?:illion)?$", r"^([\d.]+)[Tt](?:rillion)?$", r"^([\d.]+)[Mm](?:illion)?$", r"^([\d.]+)$"
    return (
        F.when(plain.rlike(billion), number(billion) * 1e3)
        .when(plain.rlike(trillion), number(trillion) * 1e6)
        .when(plain.rlike(million), number(million))
        .when(plain.rlike(bare), number(bare))
    )


def amounts(answer: Column) -> Column:
    """All positive amounts of a text, pattern by pattern; overlapping readings all count."""
    found = F.concat(*(F.regexp_extract_all(answer, F.lit(p), F.lit(0)) for p in PATTERNS))
    return F.filter(F.transform(found, to_millions), lambda v: v > 0)


def numeric_match(expected: Column, answer: Column, tolerance: float = DEFAULTS.numeric_tolerance) -> Column:
    """Whether any amount lies within the relative tolerance of expected (a string, in millions)."""
    value = expected.try_cast("double")
    near = F.exists(amounts(answer), lambda v: F.abs(v - value) / F.greatest(F.abs(value), F.lit(1.0)) <= tolerance)
    return F.coalesce(F.when(value.isNotNull() & (expected != ""), near), F.lit(False))
