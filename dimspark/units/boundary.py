"""Reading data that was tagged against another registry: do the symbols in use mean the same here?"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from dimspark.units import dims
from dimspark.units.registry import Registry, Unit

#: What can differ, the gravest first, with the code that a strict reader raises.
GRAVITY = (("dimension", "E_DIM_MISMATCH"), ("unknown here", "E_UNKNOWN_UNIT"), ("unknown there", "E_UNIT_MISMATCH"), ("offset", "E_UNIT_MISMATCH"), ("factor", "E_UNIT_MISMATCH"))


@dataclass(frozen=True)
class Conflict:
    symbol: str
    kind: str
    here: Unit | None
    there: Unit | None

    @property
    def ratio(self) -> float | None:
        """This registry's value of the symbol over the other's."""
        return float(self.here.factor) / float(self.there.factor) if self.here and self.there else None

    def text(self) -> str:
        def side(unit: Unit | None) -> str:
            return f"{unit.factor} ({dims.text(unit.dimension)})" if unit else "nothing"

        more = f", values differ by {(self.ratio - 1) * 100:.1f}%" if self.kind == "factor" and self.ratio is not None else ""
        return f"{self.symbol!r}, {self.kind}: here {side(self.here)}, there {side(self.there)}{more}"


@dataclass(frozen=True)
class Verdict:
    """kind: same_pin, compatible, incompatible or unverifiable."""

    kind: str
    checked: int = 0
    conflicts: tuple[Conflict, ...] = ()
    foreign_pin: str = ""

    @property
    def is_safe(self) -> bool:
        return self.kind in ("same_pin", "compatible")

    @property
    def strict_code(self) -> str | None:
        if self.kind == "unverifiable":
            return "E_REGISTRY_INVALID"
        kinds = {c.kind for c in self.conflicts}
        return next((code for kind, code in GRAVITY if kind in kinds), None)

    def message(self) -> str:
        match self.kind:
            case "same_pin":
                return "both sides name the same registry"
            case "compatible":
                return f"the registries differ, but {self.checked} symbols in use agree"
            case "unverifiable":
                return f"the registry {self.foreign_pin} is not available here, so its units cannot be checked: fetch it, or have the data published with its registry embedded"
        return "the registries differ on symbols in use: " + "; ".join(c.text() for c in self.conflicts)


def _difference(here: Unit | None, there: Unit | None) -> str | None:
    if here is None:
        return "unknown here"
    if there is None:
        return "unknown there"
    if here.dimension != there.dimension:
        return "dimension"
    if (here.offset or 0) != (there.offset or 0):
        return "offset"
    return "factor" if here.factor != there.factor else None


def check_boundary(here: Registry, there: Registry | None, symbols: Iterable[str], here_pin: str | None = None, there_pin: str | None = None) -> Verdict:
    """Compares the symbols in use; without the other registry nothing can be said unless the pins agree."""
    here_pin, there_pin = here_pin or here.pin, there_pin or (there.pin if there else "")
    if here_pin == there_pin:
        return Verdict("same_pin")
    if there is None:
        return Verdict("unverifiable", foreign_pin=there_pin)
    used = list(symbols)
    found = [(s, here.resolve(s), there.resolve(s)) for s in used]
    conflicts = tuple(Conflict(s, kind, a, b) for s, a, b in found if (kind := _difference(a, b)))
    return Verdict("incompatible", conflicts=conflicts, foreign_pin=there_pin) if conflicts else Verdict("compatible", checked=len(used))
