"""Numeric expressions: coercion, safe division, closeness, differences, verdicts."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# The literals that mean missing, and the tolerances of closeness and of the gate.
MISSING = ("INDETERMINADO", "", "NA")
ATOL, GATE_ABSOLUTE, GATE_RELATIVE = 1e-8, 0.005, 0.01


def coerce(col: Column, missing: Sequence[str] = MISSING) -> Column:
    """A double, or null for a missing code and for anything that is no number."""
    return F.when(~F.trim(col).isin(*missing), F.trim(col).try_cast("double"))


def safe_div(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def is_close(a: Column, b: Column, rtol: float) -> Column:
    """Within an absolute 1e-8 plus a share of |b|; null is close to nothing."""
    return F.coalesce(F.abs(a - b) <= F.lit(ATOL) + F.lit(rtol) * F.abs(b), F.lit(False))


def rel_diff(a: Column, b: Column) -> Column:
    """|a - b| / |b|; zero against zero is no difference, anything else against zero is infinite."""
    return F.when((a == 0) & (b == 0), 0.0).when(b == 0, F.when(a.isNotNull(), float("inf"))).otherwise(F.abs(a - b) / F.abs(b))


def verdict(value: Column, target: Column, rtol: float) -> Column:
    """MATCH or MISMATCH; a target of zero is matched by zero alone."""
    return F.when(F.when(target == 0, value == 0).otherwise(F.abs(value - target) <= F.lit(rtol) * F.abs(target)), "MATCH").otherwise("MISMATCH")


def within_gate(value: Column, target: Column, absolute: float = GATE_ABSOLUTE, relative: float = GATE_RELATIVE) -> Column:
    return F.coalesce(F.abs(value - target) <= F.greatest(F.lit(absolute), F.lit(relative) * F.abs(target)), F.lit(False))


def all_of(conditions: Sequence[Column]) -> Column:
    return functools.reduce(operator.and_, conditions, F.lit(True))


def positive(cols: Sequence[str]) -> Column:
    """All columns present and above zero."""
    return all_of([F.coalesce(F.col(c) > 0, F.lit(False)) for c in cols])


def log_or_null(col: Column, zero: str = "exclude", c: float = 1.0) -> Column:
    """ln of positive values (others null), or ln(x + c)."""
    if zero == "exclude":
        return F.when(col > 0, F.ln(col))
    if zero == "log_plus_c":
        return F.when(col + c > 0, F.ln(col + c))
    raise ValueError(f"unknown handling of zeros: {zero}")
