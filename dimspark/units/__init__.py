"""Units on the driver: the unit-string language, exact factors, registries and what is stored of them."""

from functools import cache
from pathlib import Path

from dimspark.units.registry import Registry

DATA = Path(__file__).parent.parent / "data"


def registry_text() -> str:
    """The text of the registry that comes with the package: its core, then customary and technical units."""
    return "\n".join((DATA / name).read_text(encoding="utf-8") for name in ("core.toml", "common.toml"))


@cache
def default_registry() -> Registry:
    """The registry that comes with the package."""
    return Registry(registry_text())
