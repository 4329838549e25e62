"""Rounding of counts and guarded ratios, as SQL expressions."""

from __future__ import annotations

#: Least count that is shown, and the base to which shown counts are rounded.
MIN_COUNT, BASE = 10, 10


def rounded(n: str, base: int = BASE) -> str:
    """Half up to a multiple of base; base 1 leaves the count alone."""
    return f"cast({n} as bigint)" if base == 1 else f"cast(floor(({n} + {base // 2}) / cast({base} as double)) * {base} as bigint)"


def safe(n: str, least: int = MIN_COUNT) -> str:
    return f"case when {n} >= {least} then {rounded(n)} end"


def percent(x: str) -> str:
    """A share as text with two decimals, as Spark writes it."""
    return f"format_string('%.2f%%', 100 * cast({x} as double))"


def thousands(n: str) -> str:
    """A whole number as text with commas."""
    return f"format_number({n}, 0)"
