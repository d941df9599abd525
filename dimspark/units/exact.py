"""Exact numbers: fractions within 128-bit bounds, and scales that keep powers of pi apart."""

from __future__ import annotations

import math
from dataclasses import dataclass
from fractions import Fraction

from dimspark.errors import UnitError

BOUND = 2**127


def bounded(value: Fraction) -> Fraction:
    """The value itself, refused where its lowest terms leave signed 128 bits."""
    if not (-BOUND <= value.numerator < BOUND and value.denominator < BOUND):
        raise UnitError("E_EXP_RANGE", "a factor leaves the range of exact 128-bit ratios")
    return value


def as_float(value: Fraction) -> float:
    """Numerator and denominator rounded apart, then divided: what an engine does with the emitted arithmetic."""
    return float(value.numerator) / float(value.denominator)


@dataclass(frozen=True)
class Scale:
    """ratio * pi**pi."""

    ratio: Fraction = Fraction(1)
    pi: int = 0

    def __mul__(self, other: Scale) -> Scale:
        return Scale(bounded(self.ratio * other.ratio), self.pi + other.pi)

    def __truediv__(self, other: Scale) -> Scale:
        return Scale(bounded(self.ratio / other.ratio), self.pi - other.pi)

    def __pow__(self, n: int) -> Scale:
        if n and abs(n) * max(self.ratio.numerator.bit_length(), self.ratio.denominator.bit_length()) > 40 * 128:
            raise UnitError("E_EXP_RANGE", "a factor leaves the range of exact 128-bit ratios")
        return Scale(bounded(self.ratio**n), self.pi * n)

    def __float__(self) -> float:
        value = as_float(self.ratio)
        for _ in range(abs(self.pi)):
            value = value * math.pi if self.pi > 0 else value / math.pi
        return value

    def __str__(self) -> str:
        power = "" if not self.pi else "·π" if self.pi == 1 else f"·π^{self.pi}"
        return f"{self.ratio}{power}"


ONE = Scale()
