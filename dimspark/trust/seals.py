"""Publishing with digests: a folder named by its content, a seal, and what verifying it can say.

Digests are of logical values, whatever files or batches hold them. Seals are keyed hashes,
since no signature library is at hand: they prove integrity to those who share the key.
"""

from __future__ import annotations

import hashlib
import hmac
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dimspark.errors import UnitError
from dimspark.operators.frame import UnitFrame
from dimspark.sources.tagging import metadata_of

SEVERITIES = ("note", "caution", "withdrawn")


def column_digests(df: DataFrame) -> dict[str, str]:
    """A digest of each column's values, in any order and any partitioning: one pass, partially summed.

    Each row's value is hashed to 256 bits, cut in eight, and each part summed; nulls hash as such.
    """
    sums = []
    for name in df.columns:
        h = F.sha2(F.coalesce(F.to_json(F.struct(F.col(f"`{name}`").alias("v"))), F.lit("null")), 256)
        sums += [F.sum(F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("decimal(38,0)")).cast("string").alias(f"{name}__{i}") for i in range(8)]
    row = df.agg(F.count(F.lit(1)).alias("__n"), *sums).first()
    return {n: hashlib.sha256(":".join([str(row["__n"]), *[str(row[f"{n}__{i}"]) for i in range(8)]]).encode()).hexdigest() for n in df.columns}


def seal_of(frame: UnitFrame, publisher: str, key: bytes) -> dict:
    body = {"publisher": publisher, "registry": frame.pin, "columns": column_digests(frame.df), "units": {n: json.loads(m.to_json()) for n, m in metadata_of(frame.df).items()}, "plan": frame.plan_hash()}
    text = json.dumps(body, sort_keys=True, separators=(",", ":"))
    return body | {"mac": hmac.new(key, text.encode(), "sha256").hexdigest()}


@dataclass(frozen=True)
class Verified:
    """state: intact, altered or unknown publisher."""

    state: str
    message: str
    changed: tuple[str, ...] = ()


def verify(df: DataFrame, seal: dict, keys: dict[str, bytes], strict: bool = False) -> Verified:
    body = {k: v for k, v in seal.items() if k != "mac"}
    key = keys.get(seal["publisher"])
    if key is None:
        return _said(Verified("unknown publisher", f"no key of {seal['publisher']!r} is at hand, so nothing is proved"), "E_PUBLISHER_UNKNOWN", strict)
    mac = hmac.new(key, json.dumps(body, sort_keys=True, separators=(",", ":")).encode(), "sha256").hexdigest()
    if not hmac.compare_digest(mac, seal["mac"]):
        return _said(Verified("altered", "the seal itself was changed"), "E_SEAL_BROKEN", strict)
    now, units = column_digests(df), {n: json.loads(m.to_json()) for n, m in metadata_of(df).items()}
    changed = tuple(sorted({n for n in {*now, *seal["columns"]} if now.get(n) != seal["columns"].get(n)} | {n for n in {*units, *seal["units"]} if units.get(n) != seal["units"].get(n)}))
    if changed:
        return _said(Verified("altered", f"changed since it was sealed: {', '.join(changed)}", changed), "E_TRANSIT_ALTERED", strict)
    return Verified("intact", f"values and units are as {seal['publisher']} sealed them")


def _said(v: Verified, code: str, strict: bool) -> Verified:
    if strict:
        raise UnitError(code, v.message)
    return v


def publish(frame: UnitFrame, root: str, publisher: str, key: bytes) -> tuple[str, dict]:
    """Writes the frame once to a folder named by its digests; the same content has the same place."""
    seal = seal_of(frame, publisher, key)
    digest = hashlib.sha256(json.dumps([seal["columns"], seal["units"]], sort_keys=True).encode()).hexdigest()
    path = f"{root.rstrip('/')}/{digest}"
    frame.df.write.mode("ignore").parquet(path)
    return path, seal


@dataclass(frozen=True)
class Advisory:
    """A warning about a registry pin, a symbol or an operation."""

    id: str
    severity: str
    matches: dict[str, str]
    text: str


def advisories_for(frame: UnitFrame, advisories: list[Advisory], refuse_at: str | None = None) -> list[Advisory]:
    """Those that match the frame: by pin, by a symbol in use, or by an operation of its plan."""
    symbols = {s for u in frame.units.values() for s, _ in frame.registry.canonicalize(u).terms}
    ops = {step["op"] for step in frame.log}
    held = {"pin": {frame.pin}, "symbol": symbols, "op": ops}
    found = [a for a in advisories if all(v in held.get(k, ()) for k, v in a.matches.items())]
    if refuse_at and any(SEVERITIES.index(a.severity) >= SEVERITIES.index(refuse_at) for a in found):
        raise UnitError("E_ADVISORY_MATCH", "; ".join(f"{a.id}: {a.text}" for a in found))
    return found
