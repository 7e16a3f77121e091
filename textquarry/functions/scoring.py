"""Bands, readings and warnings of scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def flagged(score: Column, threshold: float, strict: bool = True) -> Column:
    """Whether a score passes the threshold; ``strict`` excludes equality."""
    return score > threshold if strict else score >= threshold


def band(score: Column, threshold: float) -> Column:
    """Four-way band of the distance to the threshold."""
    m = score - threshold
    return F.when(m > 4, "likely machine").when(m > 0, "leaning machine").when(m > -4, "leaning human").otherwise("likely human")


def reading(margin: Column) -> Column:
    """Side and confidence of a margin (P19): void below 4, then low, moderate from 8, high from 12."""
    size = F.abs(margin)
    level = F.when(size >= 12, "high").when(size >= 8, "moderate").otherwise("low")
    side = F.when(margin > 0, "machine").otherwise("human")
    return F.when(size < 4, "void").otherwise(F.concat_ws(" ", side, level))


def length_warning(words: Column) -> Column:
    """Warning of a short text (P20): null where it is long enough."""
    return F.when(words < 25, "not reliable").when(words < 75, "caution")


def gauge(margin: Column) -> Column:
    """Position on a gauge of 1 to 99."""
    return F.least(F.greatest((margin + 20) / 40 * 100, F.lit(1.0)), F.lit(99.0))
