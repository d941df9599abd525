"""How far a derivation can be repeated: three levels by what its inputs carry, and what its metadata weighs."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Node:
    """An input or a step: digest (None: not known), whether it can be fetched, and digests of its parameters.

    deterministic: whether running it again gives the same bytes; otherwise equivalence says by what
    measure results are held equal (None: nothing is declared).
    """

    name: str
    digest: str | None
    retrievable: bool = True
    parameters: dict[str, str | None] = field(default_factory=dict)
    deterministic: bool = True
    equivalence: str | None = None


def closure_level(nodes: list[Node], engine_pinned: bool) -> str:
    """reproducible, tol-reproducible, checkable or attested-only."""
    if any(n.digest is None or None in n.parameters.values() for n in nodes) or any(not n.deterministic and n.equivalence is None for n in nodes):
        return "attested-only"
    if not engine_pinned or any(not n.retrievable for n in nodes):
        return "checkable"
    return "tol-reproducible" if any(not n.deterministic for n in nodes) else "reproducible"


def metadata_weight(df: DataFrame) -> dict[str, int]:
    """Bytes of metadata of each column."""
    return {f.name: len(f.metadata and str(f.metadata).encode() or b"") for f in df.schema.fields}


def size_lint(df: DataFrame, data_bytes: int, share: float = 0.05) -> list[str]:
    """What to say where metadata weighs more than a share of the data: the heaviest columns first."""
    weight = metadata_weight(df)
    total = sum(weight.values())
    if total <= share * data_bytes:
        return []
    heavy = sorted(weight, key=lambda n: (-weight[n], n))[:3]
    return [f"metadata is {total} bytes beside {data_bytes} bytes of data; heaviest: {', '.join(f'{n} ({weight[n]})' for n in heavy if weight[n])}. Keep longer texts in one place, put several batches in one file, or embed the registry by its pin alone"]
