"""Where a table's units come from: one JSON text that every tagged column carries."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType

from dimspark.errors import UnitError
from dimspark.sources.tagging import PROVENANCE, metadata_of, with_schema_metadata
from dimspark.units import Registry
from dimspark.units.compose import Composed, verify_pin

MODES = ("strict", "permissive", "untracked")  # the weakest last


def provenance(registry: Registry | Composed, mode: str = "permissive", full: bool = True, vocabularies: list[dict] | None = None) -> str:
    """Registry (its text, or its pin alone), what it is composed of, and the mode of the writer."""
    if isinstance(registry, Composed):
        body = json.loads(registry.provenance_json(full))
    else:
        head = {"name": registry.name, "version": registry.version, "hash": registry.pin} | ({"source": registry.source} if full else {})
        body = {"registry": head, "composed_from": []}
    return _text({"mode": mode} | body | ({"vocabularies": vocabularies} if vocabularies else {}))


def _text(body: dict) -> str:
    return json.dumps(body, ensure_ascii=False, separators=(",", ":"))


def with_provenance(df: DataFrame, text: str) -> DataFrame:
    """df with the text on every tagged column."""
    tagged = metadata_of(df)
    fields = [StructField(f.name, f.dataType, f.nullable, {**(f.metadata or {}), PROVENANCE: text} if f.name in tagged else f.metadata) for f in df.schema.fields]
    return with_schema_metadata(df, StructType(fields))


def provenance_of(df: DataFrame) -> str | None:
    found = {f.metadata[PROVENANCE] for f in df.schema.fields if PROVENANCE in (f.metadata or {})}
    merged = None
    for text in sorted(found):
        merged = text if merged is None else merge_provenance(merged, text)
    return merged


def embedded_registry(text: str, fetch: Any = None) -> Registry:
    """The registry that a table was tagged against: from the text, or fetched by its pin and checked."""
    head = json.loads(text)["registry"]
    source = head.get("source") or (fetch(head["hash"]) if fetch else None)
    if source is None:
        raise UnitError("E_REGISTRY_INVALID", f"the registry {head['hash']} is not available here and not embedded")
    if not verify_pin(source, head["hash"]):
        raise UnitError("E_REGISTRY_INVALID", f"what was fetched is not the registry {head['hash']}")
    return Registry(source)


def merge_provenance(a: str, b: str) -> str:
    """For a join or union: the weaker mode, the first registry, and the union of what both came from."""
    x, y = json.loads(a), json.loads(b)

    def union(key: str) -> list[dict]:
        seen: dict[tuple, dict] = {}
        for one in [*x.get(key, []), *y.get(key, [])]:
            seen.setdefault((one.get("name"), one.get("version"), one.get("hash")), one)
        return list(seen.values())

    mode = max(x.get("mode", "permissive"), y.get("mode", "permissive"), key=MODES.index)
    inputs = union("composed_from")
    if x["registry"]["hash"] != y["registry"]["hash"]:
        other = {k: y["registry"][k] for k in ("name", "version", "hash")}
        inputs += [other] if other not in inputs else []
    merged = {"mode": mode, "registry": x["registry"], "composed_from": inputs}
    return _text(merged | ({"vocabularies": v} if (v := union("vocabularies")) else {}))
