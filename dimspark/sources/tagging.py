"""Tags on columns: writing them, reading them back, and carrying them over after an engine lost them."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace
from functools import cache
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DecimalType, NumericType, StructField, StructType

from dimspark.errors import UnitError
from dimspark.functions.expr import check_interval
from dimspark.units.blob import Base, Metadata, Temporal
from dimspark.units.registry import Registry

#: The metadata keys of a field. Data that was tagged under another key is read by giving that key.
KEY = "dimspark.quantity.v1"
ELEMENT_KEY = "dimspark.element.v1"
PROVENANCE = "dimspark:provenance"
DISPLAY_NAME, DESCRIPTION = "dimspark:display_name", "dimspark:description"


@cache
def _metadata_class(jvm: Any) -> Any:
    return jvm.org.apache.spark.sql.types.Metadata


def named(column: Column, name: str, metadata: dict[str, Any]) -> Column:
    """A column under a name, with this metadata and no other; as Column.alias, with fewer calls of the JVM."""
    from pyspark import SparkContext

    return type(column)(getattr(column._jc, "as")(name, _metadata_class(SparkContext._active_spark_context._jvm).fromJson(json.dumps(metadata))))


def can_be_tagged(kind: DataType) -> bool:
    return isinstance(kind, (NumericType, DecimalType)) or (isinstance(kind, ArrayType) and isinstance(kind.elementType, NumericType)) or isinstance(kind, StructType)


def _field(field: StructField, blob: str, key: str, more: dict[str, Any]) -> StructField:
    if isinstance(field.dataType, ArrayType):
        key = ELEMENT_KEY if key == KEY else key
    return StructField(field.name, field.dataType, field.nullable, {**(field.metadata or {}), key: blob, **more})


def tag_schema(schema: StructType, units: dict[str, str], registry: Registry, quantities: dict[str, str] | None = None, *, bases: dict[str, Base] | None = None, temporals: dict[str, Temporal] | None = None, strict: bool = True, strict_storage: bool = False, provenance: str | None = None, key: str = KEY) -> StructType:
    """The schema with tags on the named columns, all of them or, on any error, none.

    Units are stored in their one spelling. Unknown columns are refused unless strict is off;
    types that no unit may annotate are refused where strict_storage is on.
    """
    missing = sorted(set(units) - set(schema.names))
    if missing and strict:
        raise ValueError(f"no such column: {', '.join(missing)}; there are {', '.join(sorted(schema.names))}")
    out = []
    for field in schema.fields:
        if field.name not in units:
            out.append(field)
            continue
        if strict_storage and not can_be_tagged(field.dataType):
            raise UnitError("E_BAD_PLACEMENT", f"{field.name} is {field.dataType.simpleString()}, which takes no unit")
        unit = registry.canonicalize(units[field.name])
        quantity = (quantities or {}).get(field.name)
        check_interval(registry, quantity, unit)
        base = (bases or {}).get(field.name)
        if base:
            base = replace(base, unit=registry.canonicalize(base.unit).text)
        meta = Metadata(unit.text, quantity=quantity, base=base, temporal=(temporals or {}).get(field.name))
        out.append(_field(field, meta.to_json(), key, {PROVENANCE: provenance} if provenance else {}))
    return StructType(out)


def with_schema_metadata(df: DataFrame, schema: StructType) -> DataFrame:
    """df with the metadata of a schema of the same names; one projection, no job."""
    old = {f.name: f.metadata or {} for f in df.schema.fields}
    new = {f.name: f.metadata or {} for f in schema.fields}
    if all(new.get(n, m) == m for n, m in old.items()):
        return df
    quoted = {n: "`" + n.replace("`", "``") + "`" for n in df.columns}
    return df.select(*[named(F.expr(c), n, new[n]) if new.get(n, old[n]) != old[n] else c for n, c in quoted.items()])


def tag(data: DataFrame | StructType, units: dict[str, str], registry: Registry, quantities: dict[str, str] | None = None, **options) -> Any:
    """A frame (batch or streaming) or a schema with tags; what came in as one comes out as one."""
    if isinstance(data, StructType):
        return tag_schema(data, units, registry, quantities, **options)
    if isinstance(data, DataFrame):
        return with_schema_metadata(data, tag_schema(data.schema, units, registry, quantities, **options))
    raise TypeError(f"a DataFrame or a StructType can be tagged, not {type(data).__name__}")


def blob_of(field: StructField, key: str = KEY) -> str | None:
    found = (field.metadata or {}).get(key)
    if found is None and key == KEY:
        found = (field.metadata or {}).get(ELEMENT_KEY)
    return found


def metadata_of(data: DataFrame | StructType, key: str = KEY) -> dict[str, Metadata]:
    schema = data if isinstance(data, StructType) else data.schema
    return {f.name: Metadata.from_json(b) for f in schema.fields if (b := blob_of(f, key)) is not None}


def units_of(data: DataFrame | StructType, key: str = KEY) -> dict[str, str]:
    """The unit of each tagged column; columns without a tag are absent."""
    return {name: m.unit for name, m in metadata_of(data, key).items()}


def untag(df: DataFrame, *names: str, key: str = KEY) -> DataFrame:
    for f in df.schema.fields:
        if f.name in names:
            df = df.withMetadata(f.name, {k: v for k, v in (f.metadata or {}).items() if k not in (key, ELEMENT_KEY)})
    return df


def describe(df: DataFrame, name: str, display_name: str | None = None, description: str | None = None) -> DataFrame:
    """Plain documentation of a column, next to its tag."""
    more = {k: v for k, v in ((DISPLAY_NAME, display_name), (DESCRIPTION, description)) if v is not None}
    return df.withMetadata(name, {**(df.schema[name].metadata or {}), **more})


def axis_label(df: DataFrame, name: str, registry: Registry) -> str:
    """What a chart's axis says: the display name and the unit's display form."""
    field = df.schema[name]
    meta = metadata_of(StructType([field])).get(name)
    shown = (field.metadata or {}).get(DISPLAY_NAME, name)
    if meta is None:
        return shown
    one = registry.resolve(meta.unit)
    return f"{shown} ({one.label if one else meta.unit})"


@dataclass(frozen=True)
class Retagged:
    """restored: columns that have their tag again; refused: column to why not."""

    restored: tuple[str, ...]
    refused: dict[str, str]


def retag(out: DataFrame, source: DataFrame | StructType, key: str = KEY) -> tuple[DataFrame, Retagged]:
    """Tags of source put back on columns of out whose name and type are unchanged; never on others."""
    schema = source if isinstance(source, StructType) else source.schema
    held = {f.name: f for f in out.schema.fields}
    restored, refused = [], {}
    for f in schema.fields:
        blob = blob_of(f, key)
        if blob is None:
            continue
        if f.name not in held:
            refused[f.name] = "no such column in the result"
        elif held[f.name].dataType != f.dataType:
            refused[f.name] = f"its type was {f.dataType.simpleString()} and is {held[f.name].dataType.simpleString()}"
        else:
            if blob_of(held[f.name], key) is None:
                out = out.withMetadata(f.name, {**(held[f.name].metadata or {}), key if not isinstance(f.dataType, ArrayType) else ELEMENT_KEY: blob})
            restored.append(f.name)
    return out, Retagged(tuple(restored), refused)


def sidecar(data: DataFrame | StructType, key: str = KEY) -> str:
    """All tags by column name as one JSON text, for formats that keep no field metadata."""
    return json.dumps({n: json.loads(m.to_json()) for n, m in metadata_of(data, key).items()}, ensure_ascii=False, separators=(",", ":"))


def apply_sidecar(df: DataFrame, text: str, key: str = KEY) -> DataFrame:
    for name, body in json.loads(text).items():
        if name in df.columns:
            meta = Metadata.from_json(json.dumps(body, ensure_ascii=False))
            df = df.withMetadata(name, {**(df.schema[name].metadata or {}), key: meta.to_json()})
    return df
