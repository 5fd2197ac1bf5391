"""Scalar column functions whose meaning needs care with nulls, rounding or division."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """Within bounds; null stays null (``greatest`` and ``least`` alone would skip it)."""
    out = c if low is None else F.greatest(c, F.lit(low))
    return F.when(c.isNotNull(), out if high is None else F.least(out, F.lit(high)))


def round_even(c: Column, digits: int = 0) -> Column:
    """Halves go to the even neighbour."""
    return F.bround(c, digits)


def is_finite(c: Column) -> Column:
    return F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False))


def nan_as_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def holds(c: Column) -> Column:
    """A condition, with unknown as false."""
    return F.coalesce(c, F.lit(False))


def signed(c: Column) -> Column:
    return F.format_string("%+d", c)


def mapped(c: Column, values: dict, default=None) -> Column:
    """A small dictionary, as a constant."""
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[c], F.lit(default)) if default is not None else F.create_map(*pairs)[c]


def row_sum(columns: list[Column]) -> Column:
    """Sum over columns, nulls as 0."""
    return sum((F.coalesce(c, F.lit(0)) for c in columns[1:]), F.coalesce(columns[0], F.lit(0)))


def contained(needle: Column, text: Column) -> Column:
    """Whether one text stands in the other; unknown counts as no."""
    return holds(F.contains(text, needle))


def part(c: Column, separator: str, k: int) -> Column:
    """The k-th part (from 0); null beyond the last."""
    return F.get(F.split(c, separator), F.lit(k))


def shift_quarters(c: Column, k: int) -> Column:
    return F.add_months(F.trunc(c, "quarter"), 3 * k)
