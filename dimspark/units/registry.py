"""Registries: units, aliases, dimensions and quantity kinds, loaded from TOML and checked as a whole."""

from __future__ import annotations

import hashlib
import re
import tomllib
from collections import Counter
from dataclasses import dataclass, field, replace
from fractions import Fraction
from functools import cached_property, lru_cache
from pathlib import Path
from typing import TYPE_CHECKING, Any

from dimspark.errors import UnitError
from dimspark.units import dims
from dimspark.units.dims import Dimension
from dimspark.units.exact import BOUND, ONE, Scale, bounded
from dimspark.units.grammar import GRAMMAR_VERSION, parse

if TYPE_CHECKING:
    from pyspark.sql import DataFrame, SparkSession

#: Long name, symbol and power of ten of each SI prefix.
SI = (
    ("quetta", "Q", 30), ("ronna", "R", 27), ("yotta", "Y", 24), ("zetta", "Z", 21), ("exa", "E", 18), ("peta", "P", 15),
    ("tera", "T", 12), ("giga", "G", 9), ("mega", "M", 6), ("kilo", "k", 3), ("hecto", "h", 2), ("deca", "da", 1),
    ("deci", "d", -1), ("centi", "c", -2), ("milli", "m", -3), ("micro", "u", -6), ("nano", "n", -9), ("pico", "p", -12),
    ("femto", "f", -15), ("atto", "a", -18), ("zepto", "z", -21), ("yocto", "y", -24), ("ronto", "r", -27), ("quecto", "q", -30),
)
PREFIX_SETS = {"si": SI, "si-engineering": tuple(p for p in SI if p[2] % 3 == 0 and -18 <= p[2] <= 18)}
#: Endings of names with two English spellings.
SPELLINGS = (("metre", "meter"), ("litre", "liter"), ("deca", "deka"))
#: The keys that a unit may have.
UNIT_KEYS = {"dimension", "factor", "offset", "delta", "aliases", "display", "prefixes", "provenance", "variants", "pi"}
PER_UNIT = "pu"
_SYMBOL = re.compile(r"[A-Za-z][A-Za-z0-9_@]*")
_NAME = re.compile(r"[a-z0-9-]+")


def invalid(message: str, symbol: str | None = None) -> UnitError:
    return UnitError("E_REGISTRY_INVALID", message, symbol=symbol)


@dataclass(frozen=True)
class Provenance:
    system: str | None = None
    source: str | None = None
    scope: str | None = None
    note: str | None = None


@dataclass(frozen=True)
class Unit:
    symbol: str
    dimension_name: str
    dimension: Dimension
    factor: Scale
    offset: Fraction | None = None
    delta: str | None = None
    aliases: tuple[str, ...] = ()
    display: dict[str, str] = field(default_factory=dict, hash=False)
    provenance: Provenance = Provenance()
    prefixed_from: str | None = None

    @property
    def is_affine(self) -> bool:
        return bool(self.offset)

    @property
    def stands_alone(self) -> bool:
        """Whether it may only be a whole unit: affine scales and per-unit values."""
        return self.is_affine or self.symbol == PER_UNIT

    @property
    def label(self) -> str:
        """The form to show."""
        return self.display.get("unicode", self.symbol)


@dataclass(frozen=True)
class Kind:
    id: str
    parent: str | None = None
    interval: bool | None = None
    rate_of: str | None = None
    summable_with: tuple[str, ...] = ()
    opposes: str | None = None
    balance: str | None = None
    same_as: str | None = None
    broader: str | None = None
    display: dict[str, str] = field(default_factory=dict, hash=False)


@dataclass(frozen=True)
class Refusal:
    symbol: str
    reason: str
    use: tuple[str, ...] = ()
    see: str | None = None

    def text(self) -> str:
        advice = f" Write {' or '.join(self.use)}." if self.use else ""
        more = f" See {self.see}." if self.see else ""
        return f"{self.symbol!r} has several readings and is refused rather than guessed: {self.reason}.{advice}{more}"


@dataclass(frozen=True)
class CollisionRisk:
    symbol: str
    authored: str | None
    prefix: str
    prefix_long: str
    base: str
    resolved: bool
    reason: str | None


@dataclass(frozen=True)
class CanonicalUnit:
    """A unit in its one spelling."""

    text: str
    dimension: Dimension
    terms: tuple[tuple[str, int], ...]
    scale: Scale | None  # to the base units; none for an affine unit
    affine: str | None = None

    def __str__(self) -> str:
        return self.text


def _spellings(name: str) -> list[str]:
    """A name in its own spelling, then in the other, if it has one."""
    for a, b in SPELLINGS:
        for old, new in ((a, b), (b, a)):
            m = re.fullmatch(f"(.*){old}(s?)", name)
            if m:
                return [name, f"{m[1]}{new}{m[2]}"]
    return [name]


def _input_names(display: dict[str, str]) -> list[str]:
    """The one-word names of a unit, lower case, as it may be typed."""
    words = [display[k].lower() for k in ("long", "plural") if _SYMBOL.fullmatch(display.get(k, ""))]
    return [s for w in words for s in _spellings(w)]


def edit_distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance, or most + 1 where it is more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return min(row[-1], most + 1)


class _Reader:
    """Checks and typed access for one parsed document."""

    def __init__(self, doc: dict[str, Any]):
        self.doc = doc

    @staticmethod
    def scan(value: Any, where: str) -> None:
        if isinstance(value, dict):
            for k, v in value.items():
                _Reader.scan(v, f"{where}.{k}" if where else k)
        elif isinstance(value, list):
            for v in value:
                if isinstance(v, dict) and not where.endswith(".use"):
                    raise invalid(f"{where}: tables in arrays are not read")
                _Reader.scan(v, where)
        elif isinstance(value, bool) or isinstance(value, str):
            return
        elif isinstance(value, int):
            if not -BOUND <= value < BOUND:
                raise invalid(f"{where}: {value} leaves signed 128 bits")
        else:
            raise invalid(f"{where}: only whole numbers, strings and truth values are exact; {value!r} is none")

    def table(self, name: str) -> dict[str, dict]:
        found = self.doc.get(name, {})
        if not isinstance(found, dict) or any(not isinstance(v, dict) for v in found.values()):
            raise invalid(f"[{name}] must hold tables")
        return found


def _text(body: dict, key: str, where: str, needed: bool = False) -> str | None:
    value = body.get(key)
    if value is None and not needed:
        return None
    if not isinstance(value, str) or (needed and not value.strip()):
        raise invalid(f"{where}: {key} must be a text")
    return value


def _texts(body: dict, key: str, where: str) -> tuple[str, ...]:
    value = body.get(key, [])
    if not isinstance(value, list) or any(not isinstance(x, str) for x in value):
        raise invalid(f"{where}: {key} must be an array of texts")
    return tuple(value)


def _whole(value: Any) -> bool:
    return isinstance(value, int) and not isinstance(value, bool)


def _pair(body: dict, key: str, where: str) -> Fraction | None:
    value = body.get(key)
    if value is None:
        return None
    if not isinstance(value, list) or len(value) != 2 or not all(map(_whole, value)) or value[1] == 0:
        raise invalid(f"{where}: {key} must be a pair of whole numbers, the second not 0")
    return Fraction(*value)


class Registry:
    """An immutable set of definitions. Everything is on the driver; see the `*_df` methods for tables."""

    def __init__(self, toml: str):
        try:
            doc = tomllib.loads(toml)
        except tomllib.TOMLDecodeError as e:
            raise invalid(f"not TOML: {e}") from None
        _Reader.scan(doc, "")
        reader = _Reader(doc)
        self.source, self.pin = toml, f"sha256:{hashlib.sha256(toml.encode()).hexdigest()}"
        self.units: dict[str, Unit] = {}
        self.aliases: dict[str, str] = {}
        self.derived: dict[str, Unit] = {}
        self.shadowed: dict[str, str] = {}
        self.prefixable: dict[str, tuple] = {}
        self._head(doc)
        self.dimensions = self._dimensions(reader)
        for symbol, body in reader.table("unit").items():
            self._unit(symbol, body)
        self._clashes()
        self._prefixed()
        self._names()
        self._refused()
        self._deltas()
        self.kinds = self._kinds(reader)

    @classmethod
    def from_path(cls, path: str | Path) -> Registry:
        return cls(Path(path).read_text(encoding="utf-8"))

    def __reduce__(self):
        """Sent as its text, and loaded again where it arrives."""
        return Registry, (self.source,)

    # loading -------------------------------------------------------------

    def _head(self, doc: dict) -> None:
        head = doc.get("registry")
        if not isinstance(head, dict):
            raise invalid("[registry] is missing")
        self.name, self.version = _text(head, "name", "[registry]", True), _text(head, "version", "[registry]", True)
        if not _NAME.fullmatch(self.name):
            raise invalid(f"[registry]: the name {self.name!r} has other than small letters, digits and hyphens")
        if head.get("schema_version") != 1 or isinstance(head.get("schema_version"), bool):
            raise invalid("[registry]: schema_version must be 1")
        self.head = head
        self._declared = {s: r for s, r in (head.get("prefix_collisions") or {}).items()}
        for symbol, reason in self._declared.items():
            if not isinstance(reason, str) or not reason.strip():
                raise invalid(f"prefix_collisions: {symbol!r} needs a reason", symbol)
        self.refusals: dict[str, Refusal] = {}
        for symbol, body in (head.get("ambiguous") or {}).items():
            where = f"[registry.ambiguous.{symbol}]"
            if not isinstance(body, dict):
                raise invalid(f"{where} must be a table", symbol)
            self.refusals[symbol] = Refusal(symbol, _text(body, "reason", where, True), _texts(body, "use", where), _text(body, "see", where))

    @staticmethod
    def _dimensions(reader: _Reader) -> dict[str, Dimension]:
        found = {}
        for name, body in reader.table("dimension").items():
            vector = body.get("vector")
            if not isinstance(vector, dict) or not all(map(_whole, vector.values())):
                raise invalid(f"[dimension.{name}] needs a vector of whole numbers")
            try:
                found[name] = dims.from_map(vector)
            except UnitError as e:
                raise invalid(f"[dimension.{name}]: {e.message}") from None
            if name in dims.BASES and found[name] != dims.from_map({name: 1}):
                raise invalid(f"[dimension.{name}] has a base dimension's name but not its vector")
        return found

    def _unit(self, symbol: str, body: dict) -> None:
        where = f"[unit.{symbol}]"
        if not _SYMBOL.fullmatch(symbol):
            raise invalid(f"{where}: not a symbol", symbol)
        if strange := sorted(set(body) - UNIT_KEYS):
            raise invalid(f"{where} has unknown keys: {', '.join(strange)}", symbol)
        name = _text(body, "dimension", where, True)
        if name in self.dimensions:
            vector = self.dimensions[name]
        elif name in dims.BASES:
            vector = dims.from_map({name: 1})
        elif name == "dimensionless":
            vector = dims.NONE
        else:
            raise invalid(f"{where}: no dimension {name!r}", symbol)
        ratio, pi = _pair(body, "factor", where), body.get("pi", 0)
        if ratio is None or ratio <= 0 or [ratio.numerator, ratio.denominator] != body["factor"]:
            raise invalid(f"{where}: factor must be a positive pair in lowest terms", symbol)
        if not _whole(pi) or not -8 <= pi <= 8:
            raise invalid(f"{where}: pi must be from -8 to 8", symbol)
        display = body.get("display", {})
        if not isinstance(display, dict) or any(not isinstance(v, str) for v in display.values()):
            raise invalid(f"{where}: display must hold texts", symbol)
        said = body.get("provenance", {})
        said = Provenance(**{k: _text(said, k, where) for k in ("system", "source", "scope", "note")})
        aliases = _texts(body, "aliases", where)
        self.units[symbol] = Unit(symbol, name, vector, Scale(ratio, pi), _pair(body, "offset", where), _text(body, "delta", where), aliases, dict(display), said)
        for alias in aliases:
            if not _SYMBOL.fullmatch(alias):
                raise invalid(f"{where}: the alias {alias!r} is not a symbol", symbol)
            if alias in self.aliases:
                raise invalid(f"the alias {alias!r} is claimed by {self.aliases[alias]!r} and {symbol!r}", alias)
            self.aliases[alias] = symbol
        chosen = _text(body, "prefixes", where)
        if chosen is not None:
            if chosen not in PREFIX_SETS:
                raise invalid(f"{where}: no prefix set {chosen!r}; there are {', '.join(PREFIX_SETS)}", symbol)
            if self.units[symbol].is_affine:
                raise invalid(f"{where}: an affine unit takes no prefixes", symbol)
            self.prefixable[symbol] = PREFIX_SETS[chosen]

    def _clashes(self) -> None:
        for alias, target in self.aliases.items():
            if alias in self.units:
                raise invalid(f"the alias {alias!r} of {target!r} is a unit's own symbol", alias)

    def _prefixed(self) -> None:
        """All prefixed forms; each must be one thing only, or be ruled on in prefix_collisions."""
        claims: dict[str, list[str]] = {}
        for base, chosen in self.prefixable.items():
            unit = self.units[base]
            for long, prefix, power in chosen:
                symbol = f"{prefix}{base}"
                claims.setdefault(symbol, []).append(f"{long}-{base}")
                try:
                    factor = unit.factor * Scale(Fraction(10) ** power)
                except UnitError:
                    raise invalid(f"{symbol!r}, {long} of {base!r}, leaves the range of exact factors", symbol) from None
                display = {k: long + unit.display[k] for k in ("long", "plural") if k in unit.display}
                if "unicode" in unit.display:
                    display["unicode"] = ("µ" if prefix == "u" else prefix) + unit.display["unicode"]
                self.derived[symbol] = replace(unit, symbol=symbol, factor=factor, aliases=(), display=display, prefixed_from=base, delta=None)
        for symbol, readings in claims.items():
            held = "an authored unit" if symbol in self.units else f"an alias of {self.aliases[symbol]!r}" if symbol in self.aliases else None
            if held is None and len(readings) == 1:
                continue
            if symbol not in self._declared:
                also = " and ".join(readings + ([held] if held else []))
                raise invalid(f"{symbol!r} is ambiguous: it reads as {also}. Rule on it under [registry.prefix_collisions]", symbol)
            self.shadowed[symbol] = self._declared[symbol]
            del self.derived[symbol]
        if stale := sorted(set(self._declared) - set(self.shadowed)):
            raise invalid(f"prefix_collisions rules on what doesn't collide: {', '.join(stale)}", stale[0])

    def _names(self) -> None:
        """Whole names as input, for authored units and for prefixed ones."""
        named: dict[str, str] = {}
        for unit in self.units.values():
            for name in _input_names(unit.display):
                if name in self.units or name in self.aliases:
                    continue
                if named.setdefault(name, unit.symbol) != unit.symbol:
                    raise invalid(f"the name {name!r} is that of {named[name]!r} and of {unit.symbol!r}", name)
        self.aliases |= named
        self.long_names: dict[str, str] = {}
        for unit in self.derived.values():
            for name in _input_names(unit.display):
                for spelled in {name, *(f"deka{name[4:]}" for _ in [0] if name.startswith("deca"))}:
                    if spelled not in self.units and spelled not in self.aliases and spelled not in self.derived:
                        self.long_names.setdefault(spelled, unit.symbol)
        for alias in self.aliases:
            if alias in self.derived:
                raise invalid(f"{alias!r} is ambiguous: a name of {self.aliases[alias]!r} and a prefixed {self.derived[alias].prefixed_from!r}", alias)

    def _refused(self) -> None:
        for symbol in self.refusals:
            if self.resolve(symbol):
                raise invalid(f"{symbol!r} is refused and defined at once", symbol)

    def _deltas(self) -> None:
        for unit in self.units.values():
            if unit.delta is None:
                continue
            target = self.units.get(unit.delta)
            if target is None or target.offset or target.dimension != unit.dimension or target.factor != unit.factor:
                raise invalid(f"[unit.{unit.symbol}]: delta {unit.delta!r} must be a unit of the same dimension and factor, without offset", unit.symbol)

    @staticmethod
    def _kinds(reader: _Reader) -> dict[str, Kind]:
        found = {}
        for name, body in reader.table("quantity").items():
            where = f'[quantity."{name}"]'
            interval = body.get("interval")
            if interval is not None and not isinstance(interval, bool):
                raise invalid(f"{where}: interval must be true or false", name)
            links = {k: _text(body, k, where) for k in ("parent", "rate_of", "opposes", "balance", "same_as", "broader")}
            found[name] = Kind(name, interval=interval, summable_with=_texts(body, "summable_with", where), display=dict(body.get("display", {})), **links)
        for kind in found.values():
            for target in (kind.parent, kind.rate_of, kind.opposes, kind.balance, *kind.summable_with):
                if target is not None and target not in found:
                    raise invalid(f'[quantity."{kind.id}"] names {target!r}, which is not defined', kind.id)
            seen, at = {kind.id}, kind.parent
            while at is not None:
                if at in seen:
                    raise invalid(f'[quantity."{kind.id}"]: its parents run in a circle', kind.id)
                seen.add(at)
                at = found[at].parent
        return found

    # look-up --------------------------------------------------------------

    def resolve(self, symbol: str) -> Unit | None:
        """The unit behind a spelling: a symbol, an alias, a prefixed form or a prefixed name."""
        if symbol in self.shadowed and symbol not in self.units:
            return None
        target = self.aliases.get(symbol, symbol)
        return self.units.get(target) or self.derived.get(target) or self.derived.get(self.long_names.get(target, ""))

    def canonical_symbol(self, symbol: str) -> str | None:
        unit = self.resolve(symbol)
        return unit.symbol if unit else None

    def describe(self, symbol: str) -> str | None:
        unit = self.resolve(symbol)
        return unit and (unit.display.get("long") or unit.display.get("unicode"))

    @cached_property
    def candidates(self) -> tuple[str, ...]:
        """Every spelling that resolves, in order."""
        return tuple(sorted({*self.units, *self.aliases, *self.derived, *self.long_names}))

    def suggest(self, text: str) -> list[str]:
        """Up to four spellings that may be meant: those that differ by case, then by an edit or two."""
        lower, most = text.lower(), 1 if len(text) <= 4 else 2
        ranked = []
        for c in self.candidates:
            if c != text:
                distance = edit_distance(lower, c.lower(), most)
                if distance <= most:
                    ranked.append((distance > 0, distance, c))
        return [c for _, _, c in sorted(ranked)[:4]]

    @cached_property
    def display_forms(self) -> dict[str, str]:
        """Display forms that are no symbols, to the symbol that they show."""
        found: dict[str, str] = {}
        for unit in [*self.units.values(), *self.derived.values()]:
            for form in unit.display.values():
                if not _SYMBOL.fullmatch(form):
                    found.setdefault(form, unit.symbol)
        return found

    def by_display(self, form: str) -> str | None:
        return self.display_forms.get(form)

    def delta_of(self, symbol: str) -> str | None:
        """The unit of differences: an affine unit's delta, another unit itself."""
        unit = self.resolve(symbol)
        return None if unit is None else unit.delta if unit.is_affine else unit.symbol

    @property
    def authored_count(self) -> int:
        return len(self.units)

    @property
    def unit_count(self) -> int:
        return len(self.units) + sum(map(len, self.prefixable.values()))

    def collision_risks(self) -> list[CollisionRisk]:
        risks = (self.would_collide(s) for s in self.prefix_reserved())
        return [r for r in risks if r.authored is not None or r.reason is not None]

    def would_collide(self, symbol: str) -> CollisionRisk | None:
        """The prefixed reading that a unit of this symbol would contest."""
        for base, chosen in self.prefixable.items():
            for long, prefix, _ in chosen:
                if symbol == prefix + base:
                    unit, reason = self.units.get(symbol), self.shadowed.get(symbol)
                    return CollisionRisk(symbol, unit and unit.dimension_name, prefix, long, base, reason is not None, reason)
        return None

    def prefix_reserved(self) -> list[str]:
        return sorted({p + base for base, chosen in self.prefixable.items() for _, p, _ in chosen})

    def systems(self) -> list[tuple[str | None, int]]:
        counts = Counter(u.provenance.system for u in self.units.values())
        return sorted(counts.items(), key=lambda x: (-x[1], x[0] is not None, x[0] or ""))

    def units_without_a_stated_system(self) -> list[str]:
        return sorted(s for s, u in self.units.items() if u.provenance.system is None)

    # units in their one spelling ------------------------------------------

    def canonicalize(self, text: str, grammar: int = GRAMMAR_VERSION) -> CanonicalUnit:
        if grammar != GRAMMAR_VERSION:
            raise UnitError("E_GRAMMAR_VERSION", f"grammar {grammar} is not read here; this is grammar {GRAMMAR_VERSION}")
        return self._canonicalize(text)

    @cached_property
    def _canonicalize(self):
        return lru_cache(maxsize=4096)(self._canonicalize_once)

    def _canonicalize_once(self, text: str) -> CanonicalUnit:
        try:
            terms = parse(text)
        except UnitError as e:
            forms = [f for f in self.display_forms if f and f in text]
            if e.code != "E_UNIT_SYNTAX" or not forms:
                raise
            form = max(forms, key=len)
            raise UnitError(e.code, f"{form!r} is a display form: write `{self.display_forms[form]}`", offset=e.offset) from None
        found = [(self._known(t.symbol, t.offset), t.exponent) for t in terms]
        for unit, exponent in found:
            if unit.stands_alone and (len(found) > 1 or exponent != 1):
                raise UnitError("E_AFFINE_COMPOUND", f"{unit.symbol!r} may only stand alone" + (f"; for differences use {unit.delta!r}" if unit.delta else ""), symbol=unit.symbol)
        powers: Counter[str] = Counter()
        for unit, exponent in found:
            powers[unit.symbol] += exponent
        kept = {s: e for s, e in powers.items() if e}
        if any(not -128 <= e <= 127 for e in kept.values()):
            raise UnitError("E_EXP_RANGE", "an exponent leaves the range -128 to 127")
        ordered = sorted(kept.items(), key=lambda x: (x[1] < 0, x[0].encode()))
        dimension, units = dims.NONE, {u.symbol: u for u, _ in found}
        for symbol, exponent in ordered:
            dimension = dims.combine(dimension, units[symbol].dimension, exponent)
        written = "*".join(s if e == 1 else f"{s}^{e}" for s, e in ordered) or "1"
        affine = next((s for s, _ in ordered if units[s].is_affine), None)
        return CanonicalUnit(written, dimension, tuple(ordered), None if affine else self._scale(ordered, units), affine)

    @staticmethod
    def _scale(ordered: list[tuple[str, int]], units: dict[str, Unit]) -> Scale:
        total = ONE
        for symbol, exponent in ordered:
            total = total * units[symbol].factor**exponent
        return total

    def _known(self, symbol: str, offset: int | None = None) -> Unit:
        if symbol in self.refusals:
            raise UnitError("E_UNKNOWN_UNIT", self.refusals[symbol].text(), offset=offset, symbol=symbol)
        unit = self.resolve(symbol)
        if unit is None:
            near = self.suggest(symbol)
            asked = f"; is {' or '.join(near)} meant?" if near else ""
            raise UnitError("E_UNKNOWN_UNIT", f"no unit {symbol!r} in {self.name}@{self.version}{asked}", offset=offset, symbol=symbol)
        return unit

    def units_equal(self, a: str, b: str) -> bool:
        return self.canonicalize(a).text == self.canonicalize(b).text

    def commensurable(self, a: str, b: str) -> bool:
        return self.canonicalize(a).dimension == self.canonicalize(b).dimension

    def dimension(self, unit: str) -> dict[str, int]:
        return dims.to_map(self.canonicalize(unit).dimension)

    def conversion(self, source: str, target: str) -> Conversion:
        a, b = self.canonicalize(source), self.canonicalize(target)
        if a.dimension != b.dimension:
            raise UnitError("E_DIM_MISMATCH", f"cannot convert {a} ({dims.text(a.dimension)}) to {b} ({dims.text(b.dimension)})")
        (fa, oa), (fb, ob) = self._line(a), self._line(b)
        factor = fa / fb
        offset = bounded((oa - ob) / fb.ratio) if oa or ob else Fraction(0)
        return Conversion(a.text, b.text, factor, offset)

    def _line(self, unit: CanonicalUnit) -> tuple[Scale, Fraction]:
        """Factor and offset to the base units."""
        if unit.affine:
            one = self.resolve(unit.affine)
            return one.factor, one.offset
        return unit.scale, Fraction(0)

    # as tables ------------------------------------------------------------

    def units_df(self, spark: SparkSession) -> DataFrame:
        """A row for each unit that resolves, authored or prefixed."""
        rows = [(u.symbol, u.dimension_name, dims.to_map(u.dimension), str(u.factor.ratio.numerator), str(u.factor.ratio.denominator), u.factor.pi, str(u.offset) if u.offset else None, self.describe(u.symbol), u.prefixed_from, u.provenance.system) for u in [*self.units.values(), *self.derived.values()]]
        return spark.createDataFrame(rows, "symbol string, dimension string, exponents map<string,int>, numerator string, denominator string, pi int, offset string, description string, prefixed_from string, system string")

    def aliases_df(self, spark: SparkSession) -> DataFrame:
        rows = sorted([*self.aliases.items(), *self.long_names.items()])
        return spark.createDataFrame([(a, self.canonical_symbol(a)) for a, _ in rows], "alias string, symbol string")

    def dimensions_df(self, spark: SparkSession) -> DataFrame:
        rows = [(n, dims.to_map(v), dims.text(v)) for n, v in sorted(self.dimensions.items())]
        return spark.createDataFrame(rows, "name string, exponents map<string,int>, text string")

    def kinds_df(self, spark: SparkSession) -> DataFrame:
        rows = [(k.id, k.parent, k.interval, k.rate_of, list(k.summable_with)) for _, k in sorted(self.kinds.items())]
        return spark.createDataFrame(rows, "id string, parent string, interval boolean, rate_of string, summable_with array<string>")

    def refusals_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(r.symbol, r.reason, list(r.use)) for r in self.refusals.values()], "symbol string, reason string, use array<string>")

    def candidates_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(c,) for c in self.candidates], "candidate string")


@dataclass(frozen=True)
class Conversion:
    """y = factor * x + offset, exactly."""

    source: str
    target: str
    factor: Scale
    offset: Fraction = Fraction(0)

    @property
    def is_affine(self) -> bool:
        return self.offset != 0

    @property
    def is_exact_rational(self) -> bool:
        return self.factor.pi == 0

    @property
    def numerator(self) -> int:
        return self.factor.ratio.numerator

    @property
    def denominator(self) -> int:
        return self.factor.ratio.denominator

    @property
    def pi(self) -> int:
        return self.factor.pi

    def apply(self, x: float) -> float:
        from dimspark.units.exact import as_float

        return x * float(self.factor) + as_float(self.offset)

    def apply_exact(self, x: Fraction | int) -> Fraction | None:
        """The exact result; none where pi is in the factor."""
        return bounded(Fraction(x) * self.factor.ratio + self.offset) if self.is_exact_rational else None

    def formula(self) -> str:
        scaled = "y = x" if self.factor == ONE else f"y = x × {self.factor}"
        return scaled if not self.offset else f"{scaled} + {self.offset}"
