"""Dimensions: vectors of small exponents over ten bases."""

from __future__ import annotations

from collections.abc import Mapping

from dimspark.errors import UnitError

#: The base dimensions in their order.
BASES = ("length", "mass", "time", "current", "temperature", "amount", "luminosity", "count", "currency", "angle")

Dimension = tuple[int, ...]
NONE: Dimension = (0,) * len(BASES)


def checked(vector: Dimension) -> Dimension:
    if any(not -128 <= e <= 127 for e in vector):
        raise UnitError("E_EXP_RANGE", "a dimension's exponent leaves the range -128 to 127")
    return vector


def combine(a: Dimension, b: Dimension, power: int = 1) -> Dimension:
    """a times b to a power."""
    return checked(tuple(x + power * y for x, y in zip(a, b)))


def from_map(exponents: Mapping[str, int]) -> Dimension:
    strange = sorted(set(exponents) - set(BASES))
    if strange:
        raise UnitError("E_REGISTRY_INVALID", f"not among the ten base dimensions: {', '.join(strange)}")
    return checked(tuple(exponents.get(b, 0) for b in BASES))


def to_map(vector: Dimension) -> dict[str, int]:
    return {b: e for b, e in zip(BASES, vector) if e}


def text(vector: Dimension) -> str:
    parts = [b if e == 1 else f"{b}^{e}" for b, e in to_map(vector).items()]
    return "·".join(parts) or "dimensionless"
