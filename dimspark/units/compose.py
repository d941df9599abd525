"""Composition of registries: one effective registry from several sources, and rulings where they differ.

The composed registry is written in one fixed form, so that its hash names it.
"""

from __future__ import annotations

import hashlib
import json
import tomllib
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property
from pathlib import Path
from typing import Any

from dimspark.errors import UnitError
from dimspark.units.registry import Registry, invalid

SECTIONS = ("dimension", "unit", "quantity")
_BARE = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-")
_ESCAPES = str.maketrans({'"': '\\"', "\\": "\\\\", "\n": "\\n", "\t": "\\t"})


def pin_of(text: str) -> str:
    return f"sha256:{hashlib.sha256(text.encode()).hexdigest()}"


def verify_pin(text: str, pin: str) -> bool:
    return pin_of(text) == pin


# --- the fixed form ---------------------------------------------------------


def _quoted(text: str) -> str:
    return f'"{text.translate(_ESCAPES)}"'


def _key(key: str) -> str:
    return key if key and set(key) <= _BARE else _quoted(key)


def _ordered(table: dict) -> list[tuple[str, Any]]:
    return sorted(table.items(), key=lambda x: x[0].encode())


def _inline(value: Any) -> str:
    match value:
        case bool():
            return "true" if value else "false"
        case int():
            return str(value)
        case str():
            return _quoted(value)
        case list():
            return f"[{', '.join(map(_inline, value))}]"
        case dict():
            return f"{{ {', '.join(f'{_key(k)} = {_inline(v)}' for k, v in _ordered(value))} }}"
    raise TypeError(type(value))


def write_toml(doc: dict) -> str:
    """TOML in the fixed form: keys in byte order, a table's own values before its tables, a blank line between tables."""
    blocks: list[str] = []

    def visit(path: tuple[str, ...], table: dict) -> None:
        own = [(k, v) for k, v in _ordered(table) if not isinstance(v, dict)]
        inner = [(k, v) for k, v in _ordered(table) if isinstance(v, dict)]
        lines = "".join(f"{_key(k)} = {_inline(v)}\n" for k, v in own)
        if path and (own or not inner):
            lines = f"[{'.'.join(map(_key, path))}]\n{lines}"
        if lines:
            blocks.append(lines)
        for k, v in inner:
            visit((*path, k), v)

    visit((), doc)
    return "\n".join(blocks)


# --- composing ----------------------------------------------------------------


@dataclass(frozen=True)
class Source:
    name: str
    version: str
    toml: str

    @property
    def pin(self) -> str:
        return pin_of(self.toml)

    @cached_property
    def doc(self) -> dict:
        try:
            return tomllib.loads(self.toml)
        except tomllib.TOMLDecodeError as e:
            raise invalid(f"source {self.name!r} is not TOML: {e}") from None

    @classmethod
    def from_path(cls, path: str | Path) -> Source:
        text = Path(path).read_text(encoding="utf-8")
        head = tomllib.loads(text).get("registry", {})
        return cls(head.get("name", ""), head.get("version", ""), text)


@dataclass(frozen=True)
class Ruling:
    symbol: str
    source: str
    reason: str


@dataclass(frozen=True)
class Contest:
    symbol: str
    section: str
    sources: tuple[str, ...]


@dataclass(frozen=True)
class Composed:
    name: str
    version: str
    toml: str
    pin: str
    inputs: tuple[tuple[str, str, str], ...]
    applied: tuple[Ruling, ...]
    agreed: tuple[str, ...]

    @cached_property
    def registry(self) -> Registry:
        return Registry(self.toml)

    def provenance_json(self, full: bool = True) -> str:
        """What a table carries of its registry: with its text, or with its pin alone."""
        head = {"name": self.name, "version": self.version, "hash": self.pin} | ({"source": self.toml} if full else {})
        inputs = [{"name": n, "version": v, "hash": h} for n, v, h in self.inputs]
        return json.dumps({"registry": head, "composed_from": inputs}, ensure_ascii=False, separators=(",", ":"))

    def metadata_bytes(self, full: bool = True) -> int:
        return len(self.provenance_json(full).encode())


def _definitions(sources: Iterable[Source], section: str) -> dict[str, dict[str, Any]]:
    """symbol -> {source: body}, sources in their order."""
    found: dict[str, dict[str, Any]] = {}
    for source in sources:
        for symbol, body in (source.doc.get(section) or {}).items():
            found.setdefault(symbol, {})[source.name] = body
    return found


def contested(sources: list[Source]) -> list[Contest]:
    """What sources define differently: what there is to rule on."""
    contests = [Contest(symbol, section, tuple(bodies)) for section in SECTIONS for symbol, bodies in _definitions(sources, section).items() if any(b != next(iter(bodies.values())) for b in bodies.values())]
    return sorted(contests, key=lambda c: c.symbol.encode())


def compose(name: str, version: str, sources: list[Source], rulings: Iterable[Ruling] = ()) -> Composed:
    if not sources:
        raise invalid("nothing to compose")
    names = [s.name for s in sources]
    if twice := [n for n in names if names.count(n) > 1]:
        raise invalid(f"two sources are named {twice[0]!r}")
    by_symbol: dict[str, Ruling] = {}
    for ruling in rulings:
        if not ruling.reason.strip():
            raise invalid(f"the ruling on {ruling.symbol!r} gives no reason", ruling.symbol)
        if ruling.source not in names:
            raise invalid(f"the ruling on {ruling.symbol!r} is for {ruling.source!r}, which is not among the sources", ruling.symbol)
        if ruling.symbol in by_symbol:
            raise invalid(f"there are two rulings on {ruling.symbol!r}", ruling.symbol)
        by_symbol[ruling.symbol] = ruling
    merged: dict[str, dict] = {}
    settled, agreed = set(), set()
    for section in SECTIONS:
        for symbol, bodies in _definitions(sources, section).items():
            first, *others = bodies.values()
            if all(b == first for b in others):
                if others and section == "unit":
                    agreed.add(symbol)
                body = first
            elif symbol not in by_symbol:
                raise invalid(f"{section} {symbol!r} is defined differently by {' and '.join(bodies)}: rule for one of them, with a reason", symbol)
            elif by_symbol[symbol].source not in bodies:
                raise invalid(f"the ruling on {symbol!r} is for {by_symbol[symbol].source!r}, which does not define it", symbol)
            else:
                settled.add(symbol)
                body = bodies[by_symbol[symbol].source]
            merged.setdefault(section, {})[symbol] = body
    if idle := [s for s in by_symbol if s not in settled]:
        raise invalid(f"the ruling on {idle[0]!r} settles nothing: no sources differ on it", idle[0])
    applied = tuple(by_symbol[s] for s in sorted(settled, key=str.encode))
    inputs = tuple((s.name, s.version, s.pin) for s in sorted(sources, key=lambda s: s.name.encode()))
    head: dict[str, Any] = {"schema_version": 1, "name": name, "version": version}
    head |= _carried(sources)
    head["composed_from"] = {n: {"version": v, "hash": h} for n, v, h in inputs}
    if applied:
        head["reconciliation"] = {r.symbol: {"from": r.source, "reason": r.reason} for r in applied}
    text = write_toml(merged | {"registry": head})
    try:
        Registry(text)
    except UnitError as e:
        more = ". Each source is sound alone: add a source of your own that rules on it under [registry.prefix_collisions]" if "is ambiguous" in e.message else ""
        raise invalid(f"the composed registry does not load: {e.message}{more}", e.symbol) from None
    return Composed(name, version, text, pin_of(text), inputs, applied, tuple(sorted(agreed, key=str.encode)))


def _carried(sources: list[Source]) -> dict[str, Any]:
    """The sources' own rulings and refusals, the first on each symbol, marked with where they come from."""
    collisions: dict[str, str] = {}
    refused: dict[str, dict] = {}
    for source in sources:
        head = source.doc.get("registry") or {}
        note = f"(carried forward from {source.name})"
        for symbol, reason in (head.get("prefix_collisions") or {}).items():
            collisions.setdefault(symbol, f"{reason} {note}")
        for symbol, body in (head.get("ambiguous") or {}).items():
            refused.setdefault(symbol, body | ({"reason": f"{body['reason']} {note}"} if "reason" in body else {}))
    return ({"prefix_collisions": collisions} if collisions else {}) | ({"ambiguous": refused} if refused else {})


def compose_paths(name: str, version: str, paths: Iterable[str | Path], rulings: Iterable[Ruling] = ()) -> Composed:
    return compose(name, version, [Source.from_path(p) for p in paths], rulings)
