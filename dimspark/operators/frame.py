"""UnitFrame: a DataFrame whose every operation is checked for units before any job runs.

Catalyst sees ordinary DataFrame operations; checks and retagging are on the driver alone.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import cached_property
from typing import Any

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from dimspark.errors import UnitError
from dimspark.functions.expr import PERMISSIVE, Context, UExpr, column
from dimspark.operators.aggregates import Aggregate
from dimspark.sources import tagging
from dimspark.sources.provenance import merge_provenance, provenance_of, with_provenance
from dimspark.units import default_registry, dims
from dimspark.units.blob import Base, Metadata, Temporal
from dimspark.units.boundary import Verdict, check_boundary
from dimspark.units.registry import Registry

ORDER = {"strict": 0, "permissive": 1, "untracked": 2}


@dataclass(frozen=True)
class UnitFrame:
    """raw has the rows; pending the metadata of columns that the next projection, or `df`, puts on them."""

    raw: DataFrame
    context: Context
    log: tuple[dict, ...] = ()
    pin: str | None = None
    key: str = field(default=tagging.KEY, repr=False)
    pending: dict[str, dict] = field(default_factory=dict, repr=False)

    @classmethod
    def of(cls, df: DataFrame, registry: Registry | None = None, mode: str = PERMISSIVE, strict_affine: bool = False, pin: str | None = None) -> UnitFrame:
        registry = registry or default_registry()
        return cls(df, Context(registry, mode, strict_affine), ({"op": "source", "columns": df.columns},), pin or registry.pin)

    # reading --------------------------------------------------------------

    @property
    def registry(self) -> Registry:
        return self.context.registry

    @cached_property
    def df(self) -> DataFrame:
        return tagging.with_schema_metadata(self.raw, self.schema) if self.pending else self.raw

    @cached_property
    def schema(self) -> StructType:
        old = self.raw.schema
        return StructType([StructField(f.name, f.dataType, f.nullable, self.pending.get(f.name, f.metadata)) for f in old.fields]) if self.pending else old

    @cached_property
    def tags(self) -> dict[str, Metadata]:
        return tagging.metadata_of(self.schema, self.key)

    @property
    def units(self) -> dict[str, str]:
        return {name: m.unit for name, m in self.tags.items()}

    @property
    def _rows(self) -> tuple[DataFrame, dict[str, dict]]:
        """What the next operation works on, and the metadata that it has to put on columns; df, once someone has it, for its columns are then known by it."""
        return (self.df, {}) if "df" in self.__dict__ else (self.raw, self.pending)

    @staticmethod
    def _kept(name: str, pending: dict[str, dict]) -> Column | str:
        quoted = f"`{name}`"
        return tagging.named(F.expr(quoted), name, pending[name]) if name in pending else quoted

    def __getitem__(self, name: str) -> UExpr:
        if name not in self.schema.names:
            raise KeyError(f"{name!r} is no column; tagged are {', '.join(sorted(self.units)) or 'none'}")
        return column(self.context, name, self.tags.get(name), self.schema[name].dataType.simpleString())

    def __contains__(self, name: str) -> bool:
        return name in self.units

    def __repr__(self) -> str:
        return f"<UnitFrame {', '.join(f'{k}:{v}' for k, v in sorted(self.units.items()))}>"

    def tainted(self) -> frozenset[str]:
        """Numeric columns without a unit."""
        from pyspark.sql.types import NumericType

        return frozenset(f.name for f in self.schema.fields if isinstance(f.dataType, NumericType) and f.name not in self.units)

    def _next(self, df: DataFrame, op: str, _pending: dict[str, dict] | None = None, **args: Any) -> UnitFrame:
        return replace(self, raw=df, pending=_pending or {}, log=(*self.log, {"op": op, **args}))

    # tags -----------------------------------------------------------------

    def tag(self, units: dict[str, str], quantities: dict[str, str] | None = None, **options: Any) -> UnitFrame:
        df, pending = self._rows
        tagged = tagging.tag_schema(self.schema, units, self.registry, quantities, key=self.key, **options)
        changed = {f.name: f.metadata for f in tagged.fields if f.name in units}
        return self._next(df, "tag", pending | changed, units=dict(units))

    def tag_base(self, name: str, unit: str, value: float, base_unit: str, quantity: str = "core:power") -> UnitFrame:
        return self.tag({name: unit}, bases={name: Base(quantity, value, base_unit)})

    def tag_temporal(self, name: str, unit: str, kind: str, statistic: str | None = None, period: str | None = None, quantity: str | None = None) -> UnitFrame:
        return self.tag({name: unit}, {name: quantity} if quantity else None, temporals={name: Temporal(kind, statistic, period)})

    def _named(self, name: str, e: UExpr | Column | Aggregate) -> Column:
        """A Column under a name, with its tag and no metadata but that."""
        if isinstance(e, Aggregate):
            e = e.as_expression() if e.source is not None else e.build()
        if isinstance(e, Column):
            return e.alias(name)
        meta = e.metadata
        return tagging.named(e.column, name, {self.key: meta.to_json()} if meta else {})

    # projection -----------------------------------------------------------

    def select(self, *names: str, **made: UExpr | Column) -> UnitFrame:
        df, pending = self._rows
        columns = [self._kept(n, pending) for n in names] + [self._named(n, e) for n, e in made.items()]
        return self._next(df.select(*columns), "project", columns=list(names), made={n: self._text(e) for n, e in made.items()})

    def with_columns(self, **made: UExpr | Column) -> UnitFrame:
        df, pending = self._rows
        kept = [self._kept(n, pending) for n in self.schema.names if n not in made]
        return self._next(df.select(*kept, *[self._named(n, e) for n, e in made.items()]), "arithmetic", made={n: self._text(e) for n, e in made.items()})

    @staticmethod
    def _text(e: Any) -> Any:
        if isinstance(e, Aggregate):
            e = e.as_expression() if e.source is not None else None
        return {"sql": e.sql, "unit": e.unit} if isinstance(e, UExpr) else "expression"

    def convert(self, units: dict[str, str], keep_description: bool = False, **options: Any) -> UnitFrame:
        """Columns in other units, in place."""
        made = {n: self[n].to(u, **options) for n, u in units.items()}
        df, pending = self._rows
        out = df.select(*[self._named(n, made[n]) if n in made else self._kept(n, pending) for n in self.schema.names])
        if keep_description:
            for n in made:
                note = {k: v for k, v in (self.df.schema[n].metadata or {}).items() if k in (tagging.DESCRIPTION, tagging.DISPLAY_NAME)}
                out = out.withMetadata(n, {**(out.schema[n].metadata or {}), **note})
        return self._next(out, "convert", units=dict(units))

    def rename(self, names: dict[str, str]) -> UnitFrame:
        """New names; what described the old name is dropped."""
        out = self.df.withColumnsRenamed(names)
        for old, new in names.items():
            meta = out.schema[new].metadata or {} if old in self.df.columns else {}
            if tagging.DESCRIPTION in meta:
                out = out.withMetadata(new, {k: v for k, v in meta.items() if k != tagging.DESCRIPTION})
        return self._next(out, "rename", names=dict(names))

    def drop(self, *names: str) -> UnitFrame:
        return self._next(self.df.drop(*names), "project", dropped=list(names))

    # rows -----------------------------------------------------------------

    def filter(self, condition: Column) -> UnitFrame:
        df, pending = self._rows
        return self._next(df.filter(condition), "filter", pending)

    where = filter

    def order_by(self, *by: Any, **options: Any) -> UnitFrame:
        return self._next(self.df.orderBy(*[b.column if isinstance(b, UExpr) else b for b in by], **options), "sort")

    def limit(self, n: int) -> UnitFrame:
        return self._next(self.df.limit(n), "limit", n=n)

    def top(self, n: int, by: UExpr, descending: bool = True) -> UnitFrame:
        """The first n rows by a quantity: one bounded heap for each task."""
        return self.order_by(by.column.desc() if descending else by.column.asc()).limit(n)

    def distinct(self) -> UnitFrame:
        return self._next(self.df.distinct(), "distinct")

    def drop_duplicates(self, *names: str) -> UnitFrame:
        return self._next(self.df.dropDuplicates(list(names) or None), "distinct", names=list(names))

    def sample(self, fraction: float, seed: int) -> UnitFrame:
        return self._next(self.df.sample(fraction=fraction, seed=seed), "sample", fraction=fraction, seed=seed)

    def repartition(self, *args: Any) -> UnitFrame:
        return self._next(self.df.repartition(*args), "repartition")

    # aggregation ----------------------------------------------------------

    def group_by(self, *keys: str) -> Grouped:
        df, pending = self._rows
        return Grouped(self, list(keys), df.groupBy(*keys), "aggregate", {k: pending[k] for k in keys if k in pending})

    def rollup(self, *keys: str) -> Grouped:
        return Grouped(self, list(keys), self.df.rollup(*keys), "aggregate.rollup")

    def cube(self, *keys: str) -> Grouped:
        return Grouped(self, list(keys), self.df.cube(*keys), "aggregate.cube")

    def grouping_sets(self, sets: list[list[str]], *keys: str) -> Grouped:
        return Grouped(self, list(keys), self.df.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys]), "aggregate.sets")

    def agg(self, **made: Aggregate) -> UnitFrame:
        return Grouped(self, [], self.df.groupBy(), "aggregate").agg(**made)

    # two frames -----------------------------------------------------------

    def boundary(self, other: UnitFrame, names: list[str] | None = None) -> Verdict:
        """What the other frame's symbols in use mean under this frame's registry."""
        used = set()
        for name, unit in other.units.items():
            if names is None or name in names:
                used |= {s for s, _ in other.registry.canonicalize(unit).terms}
        return check_boundary(self.registry, other.registry, sorted(used), self.pin, other.pin)

    def _meet(self, other: UnitFrame, names: list[str] | None = None) -> Verdict:
        verdict = self.boundary(other, names)
        if not verdict.is_safe:
            self.context.taint(verdict.message(), verdict.message(), verdict.strict_code)
        return verdict

    def _merged(self, other: UnitFrame) -> Context:
        """The weaker of both modes, and all warnings that either has given."""
        mode = max(self.context.mode, other.context.mode, key=ORDER.__getitem__)
        return replace(self.context, mode=mode, warned=self.context.warned | other.context.warned)

    def _joined(self, out: DataFrame, other: UnitFrame, op: str, **args: Any) -> UnitFrame:
        """What comes of two frames, with the weaker of their modes and, if both say where their units come from, both told."""
        mine, theirs = provenance_of(self.df), provenance_of(other.df)
        if mine and theirs and mine != theirs and len(set(out.columns)) == len(out.columns):
            out = with_provenance(out, merge_provenance(mine, theirs))
        return replace(self._next(out, op, **args), context=self._merged(other))

    def _check_keys(self, other: UnitFrame, pairs: list[tuple[str, str]]) -> None:
        """Keys must be of one unit: equality of rows is no place for a conversion."""
        for a, b in pairs:
            ua, ub = self.units.get(a), other.units.get(b)
            if ua == ub:
                continue
            if ua is None or ub is None:
                self.context.taint(f"key {a}={b}", f"the key {a} = {b} has a unit on one side only")
                continue
            same = self.registry.canonicalize(ua).dimension == other.registry.canonicalize(ub).dimension
            raise UnitError("E_UNIT_MISMATCH" if same else "E_DIM_MISMATCH", f"the key {a} is in {ua} and {b} in {ub}: convert one first")

    def join(self, other: UnitFrame, on: str | list[str] | list[tuple[str, str]], how: str = "inner", hint: str | None = None) -> UnitFrame:
        """An equi-join; keys by one name for both sides, or pairs of names."""
        names = [on] if isinstance(on, str) else list(on)
        pairs = [(k, k) if isinstance(k, str) else k for k in names]
        self._meet(other)
        self._check_keys(other, pairs)
        right = other.df.hint(hint) if hint else other.df
        if all(a == b for a, b in pairs):
            out = self.df.join(right, [a for a, _ in pairs], how)
            for a, _ in pairs:
                if how in ("full", "outer", "full_outer", "fullouter") and a in self.units:
                    out = out.withMetadata(a, self.df.schema[a].metadata or {})
        else:
            condition = [self.df[a] == other.df[b] for a, b in pairs]
            out = self.df.join(right, condition, how)
        return self._joined(out, other, "join", how=how, on=[list(p) for p in pairs])

    def cross_join(self, other: UnitFrame) -> UnitFrame:
        self._meet(other)
        return self._joined(self.df.crossJoin(other.df), other, "join", how="cross")

    def join_where(self, other: UnitFrame, condition: Callable[[UnitFrame, UnitFrame], Column], on: list[tuple[str, str]] = (), how: str = "inner", nested: bool = False) -> UnitFrame:
        """A join by comparisons of quantities, which are coerced, besides keys, which are not.

        Column names of both sides must differ, so that expressions of either side are plain. Without
        keys every pair of rows is compared: that must be asked for, by nested=True; where a value is
        sought in ranges, `range_join` does without.
        """
        if not on and not nested:
            raise ValueError("a join without keys compares all pairs: give keys, use range_join, or say nested=True")
        if clash := set(self.df.columns) & set(other.df.columns):
            raise ValueError(f"both sides have {', '.join(sorted(clash))}")
        self._meet(other)
        self._check_keys(other, list(on))
        both = condition(self, other)
        for a, b in on:
            both = (F.col(a) == F.col(b)) & both
        return self._joined(self.df.join(other.df, both, how), other, "join", how=how, on=[list(p) for p in on])

    def range_join(self, other: UnitFrame, value: str, low: str, high: str, width: float, unit: str | None = None) -> UnitFrame:
        """Rows whose value lies in [low, high) of the other side.

        An equi-join on bins instead of a comparison of all pairs. An interval goes to bins as wide
        as itself or wider by less than two, of width (in unit, or the value's own) times a power
        of two, so it touches three at most; a value goes to one bin for each power that
        intervals have, a small table of powers that is broadcast.
        """
        x, a, b = self[value], other[low], other[high]
        a, b = x.coerced(a, "compare"), x.coerced(b, "compare")
        if unit is not None and x.unit_ is not None:
            width = float(self.registry.conversion(unit, x.unit).apply(width))
        bin_of = lambda c: F.floor(c / (F.lit(width) * F.pow(F.lit(2.0), F.col("__level"))))
        span = (F.col("__high") - F.col("__low")) / F.lit(width)
        right = other.df.withColumns({"__low": a.column, "__high": b.column}).where(F.col("__low") < F.col("__high"))
        right = right.withColumn("__level", F.when(span <= 1, 0).otherwise(F.least(F.ceil(F.log2(span)), F.lit(1100))).cast("int"))
        levels = F.broadcast(right.select("__level").distinct())
        left = self.df.crossJoin(levels).withColumn("__bin", bin_of(x.column))
        right = right.withColumn("__bin", F.explode(F.sequence(bin_of(F.col("__low")), bin_of(F.col("__high")))))
        out = left.join(right, ["__level", "__bin"]).where((x.column >= F.col("__low")) & (x.column < F.col("__high"))).drop("__level", "__bin", "__low", "__high")
        self._meet(other)
        return self._joined(out, other, "join", how="range")

    def asof_join(self, other: UnitFrame, by: list[str], left_on: str, right_on: str, columns: list[str], bin_width: float | None = None) -> UnitFrame:
        """For each row the other side's latest row of the same keys that is not later.

        Both sides in one stream, ordered, with the last value carried on. bin_width (in seconds
        for times, else in the column's numbers) also cuts the stream of a key in bins, so that a
        key with a large part of all rows goes to many tasks; a table of each bin's last value,
        one row for a bin, carries values on from bin to bin.
        """
        self._meet(other)
        self._check_keys(other, [(k, k) for k in by])
        carried = F.struct(*[F.col(f"`{c}`") for c in columns])
        kind = other.df.select(carried.alias("c")).schema["c"].dataType
        left = self.df.select(F.struct("*").alias("__row"), *by, F.col(left_on).alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast(kind).alias("__carried"))
        row = left.schema["__row"].dataType
        right = other.df.select(F.lit(None).cast(row).alias("__row"), *by, F.col(right_on).alias("__at"), F.lit(0).alias("__side"), carried.alias("__carried"))
        both = left.unionByName(right)
        keys = [f"`{k}`" for k in by]
        if bin_width is not None:
            timed = both.schema["__at"].dataType.simpleString() in ("timestamp", "timestamp_ntz", "date")
            number = F.unix_micros(F.col("__at").cast("timestamp")) / F.lit(1e6) if timed else F.col("__at").cast("double")
            both = both.withColumn("__bin", F.floor(number / F.lit(bin_width)))
            keys.append("__bin")
        latest = F.expr(f"last(__carried, true) over (partition by {', '.join(keys)} order by __at, __side rows between unbounded preceding and current row)")
        found = both.withColumn("__latest", latest).where("__side = 1")
        if bin_width is not None:
            lasts = both.groupBy(*by, "__bin").agg(F.max(F.when(F.col("__side") == 0, F.struct("__at", "__carried")))["__carried"].alias("__last"))
            before = F.expr(f"last(__last, true) over (partition by {', '.join(keys[:-1])} order by __bin rows between unbounded preceding and 1 preceding)")
            lasts = lasts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(by)], F.col("__bin").alias("__b"), before.alias("__before"))
            match = F.col("__bin").eqNullSafe(F.col("__b"))
            for i, k in enumerate(by):
                match = match & F.col(k).eqNullSafe(F.col(f"__k{i}"))
            found = found.join(lasts, match, "left").withColumn("__latest", F.coalesce("__latest", "__before"))
        out = found.select(*[F.col("__row")[c].alias(c, metadata=self.df.schema[c].metadata or {}) for c in self.df.columns], *[F.col("__latest")[c].alias(c, metadata=other.df.schema[c].metadata or {}) for c in columns])
        return self._joined(out, other, "join", how="asof", on=by)

    def _aligned(self, other: UnitFrame, op: str) -> DataFrame:
        if set(self.df.columns) != set(other.df.columns):
            raise ValueError(f"{op} needs the same columns on both sides")
        return other.df.select(*self.df.columns)

    def union(self, other: UnitFrame) -> UnitFrame:
        """Rows of both, by name. Units that differ are refused when strict, else coerced to this side's."""
        right = self._aligned(other, "a union")
        verdict = self._meet(other)
        lost, made = [], {}
        for name in self.df.columns:
            ua, ub = self.units.get(name), other.units.get(name)
            if ua == ub and (ua is None or verdict.is_safe):
                continue
            if ua is None or ub is None or not verdict.is_safe:
                self.context.taint(f"union {name}", f"{name} has a unit on one side only" if verdict.is_safe else verdict.message())
                lost.append(name)
                continue
            a, b = self.registry.canonicalize(ua), self.registry.canonicalize(ub)
            if a.dimension != b.dimension:
                raise UnitError("E_DIM_MISMATCH", f"{name} is in {ua} ({dims.text(a.dimension)}) and in {ub} ({dims.text(b.dimension)})")
            if self.context.mode == "strict":
                raise UnitError("E_UNIT_MISMATCH", f"{name} is in {ua} and in {ub}: convert one first")
            self.context.warn("W_COERCED", f"union {name}", f"{name} is converted from {ub} to {ua}")
            made[name] = self._named(name, other[name].to(ua))
        right = right.select(*[made.get(n, F.col(f"`{n}`")) for n in self.df.columns])
        out = self.df.unionByName(right)
        for name in lost:
            out = tagging.untag(out, name, key=self.key)
        for name in self.df.columns:
            meta = out.schema[name].metadata or {}
            if tagging.DESCRIPTION in meta and meta[tagging.DESCRIPTION] != (other.df.schema[name].metadata or {}).get(tagging.DESCRIPTION):
                out = out.withMetadata(name, {k: v for k, v in meta.items() if k != tagging.DESCRIPTION})
        return self._joined(out, other, "concat")

    def _set(self, other: UnitFrame, op: str, apply: Callable[[DataFrame, DataFrame], DataFrame]) -> UnitFrame:
        right = self._aligned(other, op)
        self._meet(other)
        self._check_keys(other, [(n, n) for n in self.df.columns])
        return self._joined(apply(self.df, right), other, op)

    def intersect(self, other: UnitFrame) -> UnitFrame:
        return self._set(other, "intersect", DataFrame.intersect)

    def intersect_all(self, other: UnitFrame) -> UnitFrame:
        return self._set(other, "intersect", DataFrame.intersectAll)

    def except_(self, other: UnitFrame) -> UnitFrame:
        return self._set(other, "except", DataFrame.subtract)

    def except_all(self, other: UnitFrame) -> UnitFrame:
        return self._set(other, "except", DataFrame.exceptAll)

    # SQL and the plan --------------------------------------------------------

    def sql(self, query: str, name: str = "frame") -> tuple[UnitFrame, tagging.Retagged]:
        """A query over this frame as {name}: pass-through columns keep their tags, derived ones have none."""
        out = self.df.sparkSession.sql(query, **{name: self.df})
        out, report = tagging.retag(out, self.df, self.key)
        return self._next(out, "sql", query=query), report

    def plan_json(self) -> str:
        """The operations so far in one fixed form."""
        return json.dumps(self.log, sort_keys=True, ensure_ascii=False, separators=(",", ":"), default=str)

    def plan_hash(self) -> str:
        return f"sha256:{hashlib.sha256(self.plan_json().encode()).hexdigest()}"

    def export(self) -> DataFrame:
        """The DataFrame, with one notice of the numeric columns that go out without a unit."""
        if bare := sorted(self.tainted()):
            self.context.warn("W_TAINT_INTRODUCED", "export", f"without a unit: {', '.join(bare)}")
        return self.df


@dataclass(frozen=True)
class Grouped:
    frame: UnitFrame
    keys: list[str]
    grouped: GroupedData
    op: str
    pending: dict[str, dict] = field(default_factory=dict)

    def agg(self, **made: Aggregate) -> UnitFrame:
        out = self.grouped.agg(*[self.frame._named(n, a) for n, a in made.items()])
        return self.frame._next(out, self.op, self.pending, keys=self.keys, made={n: {"fn": a.name, "of": self.frame._text(a)} for n, a in made.items()})
