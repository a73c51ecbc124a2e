"""Bins of read positions and of read lengths, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _steps(divisions: tuple[int, ...], powers: int) -> list[int]:
    return [d * 10**m for m in range(powers) for d in divisions]


def linear_interval(longest: Column) -> Column:
    """The smallest of 2, 5 and 10 times a power of ten that leaves fewer than 75 bins; an error beyond."""
    steps = F.array(*map(F.lit, _steps((2, 5, 10), 7)))  # one literal, so that the many uses of a bin stay small
    fits = F.array_min(F.filter(steps, lambda iv: 9 + F.ceil((longest - 9) / iv) < 75))
    return F.coalesce(fits, F.raise_error(F.lit("reads are too long for linear bins")).cast("int"))


def _once(values: dict[str, Column], body) -> Column:
    """body(values) as one lambda: evaluated once, and not repeated in generated code wherever a bin is used."""
    return F.transform(F.array(F.struct(*(v.alias(k) for k, v in values.items()))), body)[0]


def bin_low(pos: Column, longest: Column) -> Column:
    """First position of the bin of a 1-based position: single ones up to 9, then equal widths; single ones up to 75 in all."""
    return _once({"pos": pos, "longest": longest, "iv": linear_interval(longest)}, lambda x: _low(x["pos"], x["longest"], x["iv"]))


def _low(pos: Column, longest: Column, iv: Column) -> Column:
    wide = F.when(iv <= 10, 10 + F.floor((pos - 10) / iv) * iv).otherwise(F.greatest(F.lit(10), F.floor(pos / iv) * iv))
    return F.when((longest <= 75) | (pos <= 9), pos).otherwise(wide).cast("long")


def bin_high(low: Column, longest: Column) -> Column:
    return _once({"low": low, "longest": longest, "iv": linear_interval(longest)}, lambda x: _high(x["low"], x["longest"], x["iv"]))


def _high(low: Column, longest: Column, iv: Column) -> Column:
    end = F.when((iv > 10) & (low == 10), iv - 1).otherwise(low + iv - 1)
    return F.when((longest <= 75) | (low <= 9), low).otherwise(F.least(end, longest)).cast("long")


def exponential_width(pos: Column, longest: Column) -> Column:
    """Width of the bin that starts at a position, for the exponential scheme of long reads."""
    width = F.lit(1)
    for over, at, w in ((75, 10, 5), (200, 50, 10), (300, 100, 50), (1000, 500, 100), (2000, 1000, 500)):
        width = F.when((pos >= at) & (longest > over), w).otherwise(width)
    return width


def bin_label(low: Column, high: Column) -> Column:
    return F.when(low == high, low.cast("string")).otherwise(F.concat_ws("-", low.cast("string"), high.cast("string")))


def length_interval(low: Column, high: Column) -> Column:
    """The smallest of 1, 2 and 5 times a power of ten that cuts low..high into at most 51 bins."""
    steps = F.array(*map(F.lit, _steps((1, 2, 5), 9)))
    return F.array_min(F.filter(steps, lambda iv: F.floor((high - low) / iv) <= 50)).cast("long")
