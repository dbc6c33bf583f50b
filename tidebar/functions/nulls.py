"""Null discipline: missing is NULL only, and a comparison with NULL is false."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def yes(condition: Column) -> Column:
    """The condition, NULL read as false."""
    return F.coalesce(condition, F.lit(False))


def pmax(a: Column, b: Column) -> Column:
    """Greater of two, NULL if either is."""
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def pmin(a: Column, b: Column) -> Column:
    """Lesser of two, NULL if either is."""
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def known(c: Column) -> Column:
    """A double with NaN turned into NULL."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))
