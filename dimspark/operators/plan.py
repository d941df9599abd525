"""Plans without data: the units of columns, and typed expressions that lower to SQL text."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from dimspark.functions.expr import PERMISSIVE, Context, UExpr, column
from dimspark.sources.tagging import metadata_of
from dimspark.units.registry import Registry


class Plan:
    """Named columns of known units; needs no session until a Column is asked for."""

    def __init__(self, registry: Registry, units: dict[str, Any], mode: str = PERMISSIVE):
        self.context = Context(registry, mode)
        self._columns = {n: column(self.context, n, u) for n, u in units.items()}

    @classmethod
    def from_table(cls, data: DataFrame | StructType, registry: Registry) -> Plan:
        return cls(registry, metadata_of(data))

    def __getitem__(self, name: str) -> UExpr:
        if name not in self._columns:
            raise KeyError(f"{name!r} is not tagged; tagged are {', '.join(sorted(self._columns)) or 'none'}")
        return self._columns[name]

    def __contains__(self, name: str) -> bool:
        return name in self._columns

    def __repr__(self) -> str:
        return f"<Plan {', '.join(f'{n}:{e.unit}' for n, e in sorted(self._columns.items()))}>"
