"""What a tagged column stores: a JSON object with the unit, and what else is known of the quantity."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, replace
from typing import Any

from dimspark.errors import UnitError
from dimspark.units.grammar import GRAMMAR_VERSION

_LEX = re.compile(r'\s*(?:(?P<text>"(?:[^"\\]|\\.)*")|(?P<mark>[{}\[\],:])|(?P<other>[^\s"{}\[\],:]+))')


def _bad(message: str) -> UnitError:
    return UnitError("E_BAD_METADATA", message)


def check_unit_token(token: str) -> str:
    """The text of a raw JSON string token that must be free of escapes."""
    if len(token) < 2 or token[0] != '"' or token[-1] != '"':
        raise _bad("a unit must be a JSON string")
    if "\\" in token:
        raise _bad("a unit is written without escapes")
    return token[1:-1]


def raw_tokens(text: str) -> dict[tuple[str, ...], str]:
    """The raw tokens of the strings in nested objects, by their path; the last of a repeated key counts."""
    found: dict[tuple[str, ...], str] = {}
    path: list[str | None] = []  # a key for each open object; None for an open array
    waiting, at = False, 0
    while m := _LEX.match(text, at):
        at = m.end()
        match m[0].strip():
            case "{" | "[" as mark:
                path.append("" if mark == "{" else None)
                waiting = mark == "{"
            case "}" | "]":
                path.pop()
                waiting = False
            case ",":
                waiting = bool(path) and path[-1] is not None
            case ":":
                waiting = False
            case token if m["text"] and waiting:
                path[-1] = json.loads(token)
            case token if m["text"] and None not in path:
                found[tuple(path)] = token
    return found


@dataclass(frozen=True)
class Base:
    """What one per-unit is: value times unit of a quantity."""

    quantity: str
    value: float
    unit: str


@dataclass(frozen=True)
class Temporal:
    """instant or interval; the statistic over the interval; its ISO 8601 length."""

    kind: str
    statistic: str | None = None
    period: str | None = None


@dataclass(frozen=True)
class Metadata:
    unit: str
    grammar: int = GRAMMAR_VERSION
    quantity: str | None = None
    base: Base | None = None
    temporal: Temporal | None = None
    extra: dict[str, Any] = field(default_factory=dict, hash=False)

    def with_quantity(self, quantity: str | None) -> Metadata:
        return replace(self, quantity=quantity)

    def to_json(self) -> str:
        def number(x: float):
            return int(x) if float(x).is_integer() else x

        out: dict[str, Any] = {"unit": self.unit, "grammar": self.grammar}
        if self.quantity is not None:
            out["quantity"] = self.quantity
        if self.base:
            out["base"] = {"quantity": self.base.quantity, "value": number(self.base.value), "unit": self.base.unit}
        if self.temporal:
            out["temporal"] = {k: v for k, v in (("kind", self.temporal.kind), ("statistic", self.temporal.statistic), ("period", self.temporal.period)) if v is not None}
        out |= {k: self.extra[k] for k in sorted(self.extra)}
        return json.dumps(out, ensure_ascii=False, separators=(",", ":"))

    @classmethod
    def from_json(cls, text: str) -> Metadata:
        try:
            body = json.loads(text)
        except ValueError as e:
            raise _bad(f"not JSON: {e}") from None
        if not isinstance(body, dict):
            raise _bad("not a JSON object")
        tokens = raw_tokens(text)
        if not isinstance(body.get("unit"), str):
            raise _bad("unit is missing or not a string")
        check_unit_token(tokens["unit",])
        grammar = body.get("grammar")
        if not isinstance(grammar, int) or isinstance(grammar, bool) or grammar < 1:
            raise _bad("grammar is missing or not a positive whole number")
        if grammar > GRAMMAR_VERSION:
            raise UnitError("E_GRAMMAR_VERSION", f"grammar {grammar} is not read here")
        base = body.get("base")
        if base is not None:
            if not isinstance(base, dict) or not isinstance(base.get("unit"), str) or not isinstance(base.get("value"), (int, float)):
                raise _bad("base must be an object of quantity, value and unit")
            check_unit_token(tokens["base", "unit"])
            base = Base(base.get("quantity", ""), base["value"], base["unit"])
        temporal = body.get("temporal")
        if temporal is not None:
            if not isinstance(temporal, dict) or not isinstance(temporal.get("kind"), str):
                raise _bad("temporal must be an object with a kind")
            temporal = Temporal(temporal["kind"], temporal.get("statistic"), temporal.get("period"))
        extra = {k: v for k, v in body.items() if k not in ("unit", "grammar", "quantity", "base", "temporal")}
        return cls(body["unit"], grammar, body.get("quantity"), base, temporal, extra)


_PERIOD = re.compile(r"P(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?")


def period_seconds(period: str) -> int:
    """The seconds of an ISO 8601 duration of fixed length; months and years have none."""
    m = _PERIOD.fullmatch(period)
    if not m or not any(m.groups()):
        raise UnitError("E_TEMPORAL_MISMATCH", f"{period!r} is not a duration of fixed length")
    return sum(int(n or 0) * s for n, s in zip(m.groups(), (604800, 86400, 3600, 60, 1)))
