"""Scalar functions of typed expressions, each a native expression with a rule for its unit."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from dimspark.errors import UnitError
from dimspark.functions.expr import UExpr, literal


def _same(name: str, fn: Callable[[Column], Column]) -> Callable[[UExpr], UExpr]:
    def apply(e: UExpr) -> UExpr:
        return replace(e, build=lambda: fn(e.column), sql=f"{name}({e.sql})")

    apply.__name__ = name
    apply.__doc__ = f"{name}, in the input's unit."
    return apply


abs_, negate = _same("abs", F.abs), _same("negative", F.negative)
floor, ceil = _same("floor", F.floor), _same("ceil", F.ceil)


def round_(e: UExpr, places: int = 0) -> UExpr:
    return replace(e, build=lambda: F.round(e.column, places), sql=f"round({e.sql}, {places})")


def _chosen(name: str, fn: Callable[..., Column], doing: str) -> Callable[..., UExpr]:
    def apply(first: UExpr, *others: Any) -> UExpr:
        """The inputs in the first one's unit; a side without a unit taints the result."""
        rest = [first.coerced(o if isinstance(o, UExpr) else first._other(o), doing) for o in others]
        sql = f"{name}({', '.join(x.sql for x in (first, *rest))})"
        unit = first.unit_
        if any(x.unit_ is None for x in (first, *rest)) and any(x.unit_ is not None for x in (first, *rest)):
            first.context.taint(sql, f"{sql} has a side without a unit")
            unit = None
        return replace(first, build=lambda: fn(*[x.column for x in (first, *rest)]), sql=sql, unit_=unit)

    apply.__name__ = name
    return apply


greatest, least, coalesce = _chosen("greatest", F.greatest, "compare"), _chosen("least", F.least, "compare"), _chosen("coalesce", F.coalesce, "join")


def when(condition: Column, then: UExpr, otherwise: UExpr | Any = None) -> UExpr:
    """A choice; both branches in the first one's unit."""
    if otherwise is None:
        return replace(then, build=lambda: F.when(condition, then.column), sql=f"CASE WHEN ... THEN {then.sql} END")
    other = then.coerced(otherwise if isinstance(otherwise, UExpr) else then._other(otherwise), "join")
    return replace(then, build=lambda: F.when(condition, then.column).otherwise(other.column), sql=f"CASE WHEN ... THEN {then.sql} ELSE {other.sql} END", unit_=then.unit_ if other.unit_ is not None else None)


def sqrt(e: UExpr) -> UExpr:
    """The root; exponents must be even."""
    if e.unit_ and any(n % 2 for _, n in e.unit_.terms):
        raise UnitError("E_EXP_RANGE", f"the root of {e.unit} would have a broken exponent")
    unit = e.context.registry.canonicalize("*".join(f"{s}^{n // 2}" for s, n in e.unit_.terms) or "1") if e.unit_ else None
    return replace(e, build=lambda: F.sqrt(e.column), sql=f"sqrt({e.sql})", unit_=unit, quantity=None)


def _pure(name: str, fn: Callable[[Column], Column], taken: str) -> Callable[[UExpr], UExpr]:
    def apply(e: UExpr) -> UExpr:
        x = e if e.unit_ is None else e.to(taken)
        return replace(x, build=lambda: fn(x.column), sql=f"{name}({x.sql})", unit_=e.context.registry.canonicalize("1") if e.unit_ else None, quantity=None)

    apply.__name__ = name
    apply.__doc__ = f"{name} of a number of {taken}; dimensionless."
    return apply


def _ieee(fn: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A logarithm that is -inf at 0 and NaN below; Spark's own are null there, as for a missing value."""
    return lambda c: F.coalesce(fn(c), F.when(c == 0, float("-inf")).when(c < 0, float("nan")))


exp, log, log10 = _pure("exp", F.exp, "1"), _pure("ln", _ieee(F.log), "1"), _pure("log10", _ieee(F.log10), "1")
sin, cos, tan = _pure("sin", F.sin, "rad"), _pure("cos", F.cos, "rad"), _pure("tan", F.tan, "rad")


def atan2(y: UExpr, x: UExpr) -> UExpr:
    """The angle of two lengths of one dimension, in rad."""
    other = y.coerced(x, "compare")
    return replace(y, build=lambda: F.atan2(y.column, other.column), sql=f"atan2({y.sql}, {other.sql})", unit_=y.context.registry.canonicalize("rad"), quantity=None)


def elements(e: UExpr, unit: str) -> UExpr:
    """An array column, whose tag speaks of its elements, in another unit."""
    from dimspark.functions.expr import scaled

    conversion = e.context.registry.conversion(e.unit, unit)
    return replace(e, build=lambda: F.transform(e.column, lambda x: scaled(x.cast("double"), conversion)), sql=f"transform({e.sql}, x -> ...)", unit_=e.context.registry.canonicalize(unit))


def constant(like: UExpr, value: Any, unit: str = "1") -> UExpr:
    return literal(like.context, value, unit)
