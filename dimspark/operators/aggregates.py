"""Typed aggregates and window functions: which are legal, what unit comes out, and the native Column."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from dimspark.errors import UnitError
from dimspark.functions.expr import UExpr
from dimspark.units.blob import Temporal


@dataclass(frozen=True)
class Aggregate:
    """An aggregate of a typed expression, still without a group or a window."""

    name: str
    source: UExpr | None
    build: Callable[[], Column]
    result: UExpr | None  # what its unit is taken from; none: untagged

    def over(self, window: WindowSpec) -> UExpr:
        shape = self.result if self.result is not None else _untagged(self.source)
        return replace(shape, build=lambda: self.build().over(window), sql=f"{self.name}({self.source.sql if self.source else '*'}) OVER (...)", numeric=None)

    def as_expression(self) -> UExpr:
        shape = self.result if self.result is not None else _untagged(self.source)
        return replace(shape, build=self.build, sql=f"{self.name}({self.source.sql if self.source else '*'})", numeric=None)


def _untagged(source: UExpr) -> UExpr:
    return replace(source, unit_=None, quantity=None, base=None, temporal=None)


def _is_rate(e: UExpr) -> bool:
    kind = e.context.registry.kinds.get(e.quantity or "")
    return bool(kind and kind.rate_of)


def sum_(e: UExpr, exact_scale: int | None = None) -> Aggregate:
    """The sum, in the input's unit.

    exact_scale: sum decimals of so many places, which no partitioning can change, instead of doubles.
    """
    registry = e.context.registry
    kind = registry.kinds.get(e.quantity or "")
    if e.temporal and e.temporal.kind == "instant" and (_is_rate(e) or kind is None):
        raise UnitError("E_TEMPORAL_MISMATCH", f"{e.sql} is a rate at instants: integrate it over intervals before summing")
    if kind and (kind.rate_of or not kind.summable_with):
        raise UnitError("E_KIND_UNSUMMABLE", f"{kind.id} is not summable" + (f": integrate it to {kind.rate_of} first" if kind.rate_of else ""))
    if e.unit_ and e.unit_.affine and (e.context.mode == "strict" or e.context.strict_affine):
        raise UnitError("E_AFFINE_COMPOUND", f"positions on the scale of {e.unit} have no sum", symbol=e.unit)
    temporal = replace(e.temporal, statistic="sum") if e.temporal and e.temporal.kind == "interval" else e.temporal
    if exact_scale is None:
        return Aggregate("sum", e, (lambda: F.expr(f"sum({e.native})")) if e.native else (lambda: F.sum(e.column)), replace(e, temporal=_longer(temporal)))
    return Aggregate("sum", e, lambda: _exact_sum(e, exact_scale), replace(e, temporal=_longer(temporal)))


def _exact_sum(e: UExpr, scale: int) -> Column:
    if e.native:
        return F.expr(f"CAST(sum(CAST({e.native} AS DECIMAL(28,{scale}))) AS DOUBLE)")
    return F.sum(e.column.cast(f"decimal(28,{scale})")).cast("double")


def _longer(t: Temporal | None) -> Temporal | None:
    """A total over several intervals has no fixed length of its own."""
    return replace(t, period=None) if t and t.kind == "interval" else t


def _keeping(name: str, fn: Callable[[Column], Column]) -> Callable[[UExpr], Aggregate]:
    def make(e: UExpr) -> Aggregate:
        return Aggregate(name, e, (lambda: F.expr(f"{name}({e.native})")) if e.native else (lambda: fn(e.column)), e)

    make.__name__ = name
    make.__doc__ = f"{name}, in the input's unit."
    return make


mean, min_, max_ = _keeping("avg", F.avg), _keeping("min", F.min), _keeping("max", F.max)
first, last, median = _keeping("first", F.first), _keeping("last", F.last), _keeping("median", F.median)


def exact_mean(e: UExpr, scale: int) -> Aggregate:
    """The mean of decimals of so many places: the same whatever the partitioning."""

    def build() -> Column:
        if e.native:
            return F.expr(f"CAST(sum(CAST({e.native} AS DECIMAL(28,{scale}))) AS DOUBLE) / CAST(count({e.native}) AS DOUBLE)")
        return F.sum(e.column.cast(f"decimal(28,{scale})")).cast("double") / F.count(e.column).cast("double")

    return Aggregate("avg", e, build, e)


def percentile(e: UExpr, p: float) -> Aggregate:
    return Aggregate("percentile", e, lambda: F.percentile(e.column, F.lit(p)), e)


def approx_percentile(e: UExpr, p: float, accuracy: int = 10_000) -> Aggregate:
    return Aggregate("approx_percentile", e, lambda: F.percentile_approx(e.column, p, accuracy), e)


def stddev(e: UExpr) -> Aggregate:
    """The spread, which is a difference: an affine input gives its unit of differences."""
    return Aggregate("stddev", e, lambda: F.stddev(e.column), replace(e, unit_=_delta(e), quantity=None))


def variance(e: UExpr) -> Aggregate:
    unit = _delta(e)
    squared = e.context.registry.canonicalize("*".join(f"{s}^{2 * n}" for s, n in unit.terms) or "1") if unit else None
    return Aggregate("variance", e, lambda: F.variance(e.column), replace(e, unit_=squared, quantity=None))


def _delta(e: UExpr):
    if e.unit_ is None or not e.unit_.affine:
        return e.unit_
    delta = e.context.registry.delta_of(e.unit_.affine)
    return e.context.registry.canonicalize(delta) if delta else None


def count(e: UExpr | None = None) -> Aggregate:
    """How many: no claim about a unit."""
    if e is None or e.native:
        return Aggregate("count", e, lambda: F.expr(f"count({e.native if e is not None else 1})"), None)
    return Aggregate("count", e, lambda: F.count(e.column), None)


def count_distinct(e: UExpr) -> Aggregate:
    return Aggregate("count_distinct", e, lambda: F.count_distinct(e.column), None)


def approx_count_distinct(e: UExpr, error: float = 0.05) -> Aggregate:
    return Aggregate("approx_count_distinct", e, lambda: F.approx_count_distinct(e.column, error), None)


def lag(e: UExpr, n: int = 1) -> Aggregate:
    return Aggregate("lag", e, lambda: F.lag(e.column, n), e)


def lead(e: UExpr, n: int = 1) -> Aggregate:
    return Aggregate("lead", e, lambda: F.lead(e.column, n), e)


def nth_value(e: UExpr, n: int) -> Aggregate:
    return Aggregate("nth_value", e, lambda: F.nth_value(e.column, n), e)


def change(e: UExpr, window: WindowSpec, n: int = 1) -> UExpr:
    """The change since n rows ago: a difference, so an affine unit gives its unit of differences."""
    before = lag(e, n).over(window)
    return replace(e, build=lambda: e.column - before.column, sql=f"({e.sql} - {before.sql})", unit_=_delta(e), quantity=None)


#: Ranks, which have no unit: Columns to be taken over a window.
RANKS = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank, "percent_rank": F.percent_rank, "cume_dist": F.cume_dist, "ntile": F.ntile}
