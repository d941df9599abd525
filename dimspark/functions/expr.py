"""Typed expressions: a native Column, its unit, and what else is known of the quantity.

Nothing here touches a value. An expression is checked when it is made, on the driver; the
Column is built when it is asked for, so expressions can also be typed without a session.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from fractions import Fraction
from functools import reduce
from math import isfinite
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from dimspark.errors import UnitError, UnitWarning
from dimspark.units import dims
from dimspark.units.blob import Base, Metadata, Temporal, period_seconds
from dimspark.units.exact import as_float
from dimspark.units.registry import CanonicalUnit, Conversion, Registry

STRICT, PERMISSIVE, UNTRACKED = "strict", "permissive", "untracked"
#: Fixed value: pi for engines without a function of it.
PI_TEXT = "3.141592653589793238462643383279502884197169399375"
_PLAIN_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


@dataclass
class Context:
    """What expressions of one lineage share: registry, mode, and the warnings given already."""

    registry: Registry
    mode: str = PERMISSIVE
    strict_affine: bool = False
    warned: set[tuple[str, str]] = field(default_factory=set)

    def __post_init__(self):
        if self.mode not in (STRICT, PERMISSIVE, UNTRACKED):
            raise ValueError(f"no mode {self.mode!r}")

    def warn(self, code: str, about: str, message: str) -> None:
        import warnings

        if self.mode == PERMISSIVE and (code, about) not in self.warned:
            self.warned.add((code, about))
            warnings.warn(UnitWarning(code, message), stacklevel=4)

    def taint(self, about: str, message: str, code: str = "E_UNIT_MISMATCH") -> None:
        """A column loses its unit: refused when strict, said once when permissive."""
        if self.mode == STRICT:
            raise UnitError(code, message)
        self.warn("W_TAINT_INTRODUCED", about, message)


def _number_text(n: int, dialect: str) -> str:
    """A whole number as SQL; beyond 64 bits as a double literal."""
    if -(2**63) <= n < 2**63:
        return str(n)
    return repr(float(n)).upper().replace("E+", "E") + ("D" if dialect == "spark" else "")


def native(text: str) -> Callable[[], Column]:
    """A builder of one Spark SQL text: a few calls of the JVM, however many operations it has."""
    build = lambda: F.expr(text)
    build.text = text
    return build


def double_text(x: float) -> str:
    return f"{repr(float(x)).upper()}D"


@dataclass(frozen=True)
class UExpr:
    """An expression of one unit; unit None: no claim about it."""

    context: Context
    build: Callable[[], Column]
    sql: str
    unit_: CanonicalUnit | None = None
    quantity: str | None = None
    base: Base | None = None
    temporal: Temporal | None = None
    numeric: str | None = None  # the Spark type of a plain column, where it is known

    @property
    def unit(self) -> str | None:
        return self.unit_.text if self.unit_ else None

    @property
    def column(self) -> Column:
        return self.build()

    @property
    def native(self) -> str | None:
        """Spark SQL that says what `column` is, with its doubles written as such; None where there is no such text."""
        return getattr(self.build, "text", None)

    def _native_double(self) -> str | None:
        text = self.native
        return text if text is None or self.numeric in (None, "double") else f"CAST({text} AS DOUBLE)"

    def _operated(self, op: str, other: UExpr, apply: Callable[[Column, Column], Column]) -> Callable[[], Column]:
        a, b = self._native_double(), other._native_double()
        return native(f"({a} {op} {b})") if a and b else lambda: apply(self._double(), other._double())

    @property
    def metadata(self) -> Metadata | None:
        return Metadata(self.unit, quantity=self.quantity, base=self.base, temporal=self.temporal) if self.unit_ else None

    def text(self, has_pi: bool = True) -> str:
        """The SQL text, for an audit or another engine; without a function of pi, its digits stand for it."""
        return self.sql if has_pi else self.sql.replace("pi()", PI_TEXT)

    def __repr__(self) -> str:
        return f"<{self.sql} :: {self.unit or 'untagged'}>"

    # conversion -----------------------------------------------------------

    def to(self, unit: str, policy: str = "promote", tolerance: float | None = None) -> UExpr:
        """The same quantity in another unit.

        policy promote: whole numbers and decimals become doubles first. preserve: the type
        stays, which must lose nothing (E_CAST_LOSSY), unless tolerance allows a relative error.
        """
        if self.unit_ is None:
            self.context.taint(self.sql, f"{self.sql} has no unit to convert from")
            return self
        if self.unit == "pu" and unit != "pu":
            return self.physical().to(unit, policy, tolerance)
        registry = self.context.registry
        conversion = registry.conversion(self.unit, unit)
        target = registry.canonicalize(unit)
        self._check_interval(target)
        if policy == "preserve":
            return self._preserved(conversion, target, tolerance)
        if policy != "promote":
            raise ValueError(f"no cast policy {policy!r}")
        if conversion.factor.ratio == 1 and not conversion.pi and not conversion.offset:
            return replace(self, unit_=target)
        return replace(self, build=self._scaled(conversion), sql=scaled_sql(self.sql, conversion), unit_=target, numeric="double")

    def _scaled(self, conversion: Conversion) -> Callable[[], Column]:
        text = self._native_double()
        return native(scaled_native(text, conversion)) if text else lambda: scaled(self._double(), conversion)

    def _preserved(self, conversion: Conversion, target: CanonicalUnit, tolerance: float | None) -> UExpr:
        floating = self.numeric in (None, "double", "float")
        whole = conversion.denominator == 1 and conversion.offset.denominator == 1 and not conversion.pi
        if not floating and not whole:
            if tolerance is None:
                raise UnitError("E_CAST_LOSSY", f"{self.sql} cannot go from {conversion.source} to {conversion.target} within {self.numeric}")
            self.context.warn("W_CAST_LOSSY", self.sql, f"{self.sql} is rounded within {self.numeric}, to a relative error of {tolerance:g} at most")
            return replace(self, build=lambda: F.round(scaled(self.column.cast("double"), conversion)).cast(self.numeric), sql=f"CAST(ROUND({scaled_sql(self.sql, conversion)}) AS {self.numeric})", unit_=target)
        if floating:
            return replace(self, build=self._scaled(conversion), sql=scaled_sql(self.sql, conversion), unit_=target)
        n, off = conversion.numerator, int(conversion.offset)
        return replace(self, build=lambda: (self.column * F.lit(n) + F.lit(off)).cast(self.numeric), sql=scaled_sql(self.sql, conversion), unit_=target)

    def _double(self) -> Column:
        return self.column if self.numeric in (None, "double") else self.column.cast("double")

    def _check_interval(self, target: CanonicalUnit) -> None:
        check_interval(self.context.registry, self.quantity, target)

    def physical(self) -> UExpr:
        """A per-unit column as what it stands for."""
        if self.unit != "pu":
            return self
        if self.base is None:
            raise UnitError("E_BASE_MISSING", f"{self.sql} is per unit of a base that it doesn't name", symbol="pu")
        value, unit = self.base.value, self.context.registry.canonicalize(self.base.unit)
        return replace(self, build=lambda: self._double() * F.lit(float(value)), sql=f"({self.sql} * {value:g})", unit_=unit, base=None, numeric="double")

    # arithmetic -----------------------------------------------------------

    def _other(self, other: Any) -> UExpr:
        if isinstance(other, Quantity):
            same = self.unit_ and self.unit_.dimension == self.context.registry.canonicalize(other.unit).dimension
            return other.in_unit(self.context, self.unit if same else other.unit)
        return other if isinstance(other, UExpr) else literal(self.context, other)

    def _combined(self, other: Any, sign: int) -> UExpr:
        right = other.in_unit(self.context, other.unit) if isinstance(other, Quantity) else self._other(other)
        op, text = ("*", lambda a, b: a * b) if sign > 0 else ("/", lambda a, b: a / b)
        made = dict(build=self._operated(op, right, text), sql=f"({self.sql} {op} {right.sql})", quantity=None, base=None, numeric="double", temporal=self._time(right))
        if self.unit_ is None or right.unit_ is None:
            self.context.taint(made["sql"], f"{made['sql']} has a side without a unit")
            return replace(self, unit_=None, **made)
        for side in (self, right):
            alone = side.unit_.affine or (side.unit if side.unit == "pu" else None)
            if alone:
                raise UnitError("E_AFFINE_COMPOUND", f"{alone!r} may only stand alone, not in {made['sql']}", symbol=alone)
        powers: dict[str, int] = dict(self.unit_.terms)
        for symbol, exponent in right.unit_.terms:
            powers[symbol] = powers.get(symbol, 0) + sign * exponent
        return replace(self, unit_=self._unit_of(powers), **made)

    def _unit_of(self, powers: dict[str, int]) -> CanonicalUnit:
        kept = {s: e for s, e in powers.items() if e}
        if any(not -128 <= e <= 127 for e in kept.values()):
            raise UnitError("E_EXP_RANGE", "an exponent leaves the range -128 to 127")
        return self.context.registry.canonicalize("*".join(f"{s}^{e}" for s, e in kept.items()) or "1")

    def __mul__(self, other: Any) -> UExpr:
        return self._combined(other, 1)

    def __truediv__(self, other: Any) -> UExpr:
        return self._combined(other, -1)

    def __rmul__(self, other: Any) -> UExpr:
        return literal(self.context, other)._combined(self, 1)

    def __rtruediv__(self, other: Any) -> UExpr:
        return literal(self.context, other)._combined(self, -1)

    def try_divide(self, other: Any) -> UExpr:
        """Division that gives null for a divisor of 0."""
        right = self._other(other)
        made = self._combined(right, -1)
        return replace(made, build=lambda: F.try_divide(self._double(), right._double()), sql=f"try_divide({self.sql}, {right.sql})")

    def coerced(self, right: UExpr, doing: str) -> UExpr:
        """right in this expression's unit; both must be of one dimension."""
        if self.unit_ is None or right.unit_ is None:
            return right
        if self.unit_.dimension != right.unit_.dimension:
            raise UnitError("E_DIM_MISMATCH", f"cannot {doing} {self.unit} to {right.unit}: {dims.text(self.unit_.dimension)} and {dims.text(right.unit_.dimension)}")
        if self.unit == right.unit == "pu" and self.base != right.base:
            raise UnitError("E_BASE_MISMATCH", f"cannot {doing} per-unit values of different bases")
        return right if self.unit == right.unit else right.to(self.unit)

    def _summed(self, other: Any, op: str) -> UExpr:
        right = self._other(other)
        temporal = self._time(right)
        doing = "add" if op == "+" else "subtract"
        unit, strict = self.unit_, self.context.strict_affine and self.unit_ and self.unit_.affine
        if strict and right.unit_ and right.unit_.affine:
            if op == "+":
                raise UnitError("E_AFFINE_COMPOUND", f"cannot add {self.unit} to {right.unit}: two positions on a scale have no sum", symbol=self.unit)
            delta = self.context.registry.delta_of(self.unit)
            unit = self.context.registry.canonicalize(delta) if delta else None
        b = self._delta_added(right) if strict and right.unit_ and not right.unit_.affine else self.coerced(right, doing)
        sql = f"({self.sql} {op} {b.sql})"
        if self.unit_ is None or b.unit_ is None:
            self.context.taint(sql, f"{sql} has a side without a unit")
            unit = None
        build = self._operated(op, b, (lambda x, y: x + y) if op == "+" else (lambda x, y: x - y))
        return replace(self, build=build, sql=sql, unit_=unit, quantity=self._kind(right, op), temporal=temporal, numeric="double")

    def _delta_added(self, right: UExpr) -> UExpr:
        """A difference in the size of this affine unit's degree."""
        delta = self.context.registry.delta_of(self.unit)
        if delta is None:
            raise UnitError("E_AFFINE_COMPOUND", f"{self.unit!r} names no unit of differences", symbol=self.unit)
        if self.unit_.dimension != right.unit_.dimension:
            raise UnitError("E_DIM_MISMATCH", f"cannot add {self.unit} to {right.unit}")
        return right.to(delta)

    def _kind(self, right: UExpr, op: str) -> str | None:
        kinds = self.context.registry.kinds
        if op == "-" and self.quantity in kinds and kinds[self.quantity].opposes and kinds[self.quantity].opposes == right.quantity:
            return kinds[self.quantity].balance
        return self.quantity if self.quantity == right.quantity else None

    def _time(self, right: UExpr) -> Temporal | None:
        if self.temporal and right.temporal and self.temporal != right.temporal:
            message = f"{self.sql} and {right.sql} differ in what they say of time"
            if self.context.mode == STRICT:
                raise UnitError("E_TEMPORAL_MISMATCH", message)
            self.context.warn("W_TAINT_INTRODUCED", message, message)
            return None
        return self.temporal or right.temporal

    def __add__(self, other: Any) -> UExpr:
        return self._summed(other, "+")

    def __sub__(self, other: Any) -> UExpr:
        return self._summed(other, "-")

    def __radd__(self, other: Any) -> UExpr:
        return literal(self.context, other)._summed(self, "+")

    def __rsub__(self, other: Any) -> UExpr:
        return literal(self.context, other)._summed(self, "-")

    def __neg__(self) -> UExpr:
        return replace(self, build=lambda: -self.column, sql=f"(- {self.sql})")

    def __pow__(self, n: int) -> UExpr:
        if not isinstance(n, int):
            raise TypeError("powers of quantities are whole numbers")
        product = " * ".join([self.sql] * n) if 1 <= n <= 4 else ""
        power = (lambda: reduce(lambda a, b: a * b, [self._double()] * n)) if product else (lambda: F.pow(self._double(), F.lit(n)))
        made = dict(build=power, sql=f"({product})" if product else f"power({self.sql}, {n})", quantity=None, base=None, numeric="double")
        if self.unit_ is None:
            return replace(self, **made)
        if self.unit_.affine or self.unit == "pu":
            raise UnitError("E_AFFINE_COMPOUND", f"{self.unit!r} may only stand alone", symbol=self.unit)
        return replace(self, unit_=self._unit_of({s: e * n for s, e in self.unit_.terms}), **made)

    # comparison -----------------------------------------------------------

    def _compared(self, other: Any, op: str, apply: Callable[[Column, Column], Column]) -> Column:
        right = self._other(other)
        b = self.coerced(right, "compare")
        if (self.unit_ is None) != (right.unit_ is None) and isinstance(other, UExpr):
            self.context.taint(f"{self.sql} {op}", f"{self.sql} {op} {right.sql} compares a unit with none")
        if self.native and b.native:
            return F.expr(f"{self.native} {op} {b.native}")
        return apply(self.column, b.column)

    def __lt__(self, other: Any) -> Column:
        return self._compared(other, "<", lambda a, b: a < b)

    def __le__(self, other: Any) -> Column:
        return self._compared(other, "<=", lambda a, b: a <= b)

    def __gt__(self, other: Any) -> Column:
        return self._compared(other, ">", lambda a, b: a > b)

    def __ge__(self, other: Any) -> Column:
        return self._compared(other, ">=", lambda a, b: a >= b)

    def __eq__(self, other: Any) -> Column:  # type: ignore[override]
        return self._compared(other, "=", lambda a, b: a == b)

    def __ne__(self, other: Any) -> Column:  # type: ignore[override]
        return self._compared(other, "<>", lambda a, b: a != b)

    __hash__ = None  # type: ignore[assignment]

    def between(self, low: Any, high: Any) -> Column:
        return (self >= low) & (self <= high)

    def is_null(self) -> Column:
        return self.column.isNull()

    # time -----------------------------------------------------------------

    def integrate(self) -> UExpr:
        """A mean over fixed intervals as the amount over each: times the interval's length."""
        t = self.temporal
        if t is None or t.kind != "interval" or not t.period:
            raise UnitError("E_TEMPORAL_MISMATCH", f"{self.sql} is no mean over intervals of a fixed length")
        length, unit = _period(t.period)
        made = self * literal(self.context, length, unit)
        kind = self.context.registry.kinds.get(self.quantity or "")
        return replace(made, quantity=kind.rate_of if kind else None, temporal=Temporal("interval", "sum", t.period))

    def differentiate(self) -> UExpr:
        """A sum over fixed intervals as the mean rate over each."""
        t = self.temporal
        if t is None or t.kind != "interval" or t.statistic != "sum" or not t.period:
            raise UnitError("E_TEMPORAL_MISMATCH", f"{self.sql} is no sum over intervals of a fixed length")
        length, unit = _period(t.period)
        made = self / literal(self.context, length, unit)
        rate = next((k.id for k in self.context.registry.kinds.values() if k.rate_of and k.rate_of == self.quantity), None)
        return replace(made, quantity=rate, temporal=Temporal("interval", "mean", t.period))


def _period(period: str) -> tuple[Fraction, str]:
    seconds = period_seconds(period)
    return (Fraction(seconds, 3600), "h") if seconds % 900 == 0 else (Fraction(seconds), "s")


def scaled(x: Column, c: Conversion) -> Column:
    """x by a conversion, in the order of the emitted text: times numerator, times pi, over denominator, over pi, plus offset."""
    if c.numerator != 1:
        x = x * F.lit(float(c.numerator))
    for _ in range(max(c.pi, 0)):
        x = x * F.pi()
    if c.denominator != 1:
        x = x / F.lit(float(c.denominator))
    for _ in range(max(-c.pi, 0)):
        x = x / F.pi()
    if c.offset:
        x = x + F.lit(as_float(c.offset))
    return x


def scaled_native(x: str, c: Conversion) -> str:
    """`scaled` as Spark SQL."""
    if c.numerator != 1:
        x = f"{x} * {double_text(float(c.numerator))}"
    x += " * pi()" * max(c.pi, 0)
    if c.denominator != 1:
        x += f" / {double_text(float(c.denominator))}"
    x += " / pi()" * max(-c.pi, 0)
    if c.offset:
        x += f" + {double_text(as_float(c.offset))}"
    return f"({x})"


def scaled_sql(x: str, c: Conversion, dialect: str = "spark", pi: str = "pi()") -> str:
    parts = [x]
    if c.numerator != 1:
        parts.append(f"* {_number_text(c.numerator, dialect)}")
    parts += [f"* {pi}"] * max(c.pi, 0)
    if c.denominator != 1:
        parts.append(f"/ {_number_text(c.denominator, dialect)}")
    parts += [f"/ {pi}"] * max(-c.pi, 0)
    if c.offset:
        n, d = c.offset.numerator, c.offset.denominator
        parts.append(f"+ {n}" if d == 1 else f"+ {n}.0 / {d}")
    return f"({' '.join(parts)})" if len(parts) > 1 else x


def column(context: Context, name: str, meta: Metadata | str | None = None, numeric: str | None = None) -> UExpr:
    """A plain column, with what its tag says."""
    meta = Metadata(meta) if isinstance(meta, str) else meta
    quoted = name if _PLAIN_NAME.fullmatch(name) else "`" + name.replace("`", "``") + "`"
    made = UExpr(context, native("`" + name.replace("`", "``") + "`"), quoted, numeric=numeric)
    if meta is None:
        return made
    try:
        unit = context.registry.canonicalize(meta.unit, meta.grammar)
    except UnitError as e:
        if e.code != "E_UNKNOWN_UNIT" or context.mode == STRICT:
            raise
        context.warn("W_UNRESOLVED_SYMBOL", f"{name}:{meta.unit}", f"{name} is tagged {meta.unit!r}, which this registry doesn't know")
        return made
    return replace(made, unit_=unit, quantity=meta.quantity, base=meta.base, temporal=meta.temporal)


def literal(context: Context, value: Any, unit: str = "1") -> UExpr:
    """A number of a unit; a bare number is dimensionless, and exact as it is written."""
    if isinstance(value, Column):
        return UExpr(context, lambda: value, "expression", context.registry.canonicalize(unit))
    exact = value if isinstance(value, Fraction) else Fraction(str(value))
    text = str(exact.numerator) if exact.denominator == 1 else repr(as_float(exact))
    if isinstance(value, bool):
        return UExpr(context, lambda: F.lit(value), str(value))
    return UExpr(context, native(double_text(as_float(exact))), text, context.registry.canonicalize(unit), numeric="double")


@dataclass(frozen=True)
class Quantity:
    """A number with a unit, before it meets a context: q(5, "MW")."""

    value: Any
    unit: str

    def in_unit(self, context: Context, target: str) -> UExpr:
        """The number itself converted, so that the column it is compared with stays bare and can be pushed down."""
        conversion = context.registry.conversion(self.unit, target)
        exact = conversion.apply_exact(Fraction(str(self.value)))
        number = as_float(exact) if exact is not None else conversion.apply(float(self.value))
        return UExpr(context, native(double_text(number)) if isfinite(number) else lambda: F.lit(number), repr(number), context.registry.canonicalize(target), numeric="double")


def q(value: Any, unit: str) -> Quantity:
    return Quantity(value, unit)


def check_interval(registry: Registry, quantity: str | None, unit: CanonicalUnit) -> None:
    """Kinds of differences take units of differences, and kinds that say they are none take the others."""
    kind = registry.kinds.get(quantity or "")
    if kind is None or kind.interval is None:
        return
    deltas = {u.delta for u in registry.units.values() if u.is_affine and u.delta}
    if kind.interval and unit.affine:
        raise UnitError("E_INTERVAL_MISUSE", f"{quantity} is a difference and takes {registry.delta_of(unit.affine) or 'a unit of differences'}, not {unit}", symbol=unit.text)
    if kind.interval is False and unit.text in deltas:
        raise UnitError("E_INTERVAL_MISUSE", f"{quantity} is no difference; {unit} is a unit of differences", symbol=unit.text)
