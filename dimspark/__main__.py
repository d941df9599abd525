"""python -m dimspark canonicalize|describe|dimension|suggest UNIT, convert FROM TO [VALUE], pin REGISTRY, keygen FILE, retag TABLE SIDECAR OUT."""

from __future__ import annotations

import argparse
import json
import os
import secrets
import sys
from pathlib import Path

from dimspark.errors import UnitError
from dimspark.units import Registry, default_registry


def retag(table: str, sidecar: str, out: str) -> int:
    """Writes a Parquet table again with the tags of a sidecar text."""
    from pyspark.sql import SparkSession

    from dimspark.sources import tagging

    spark = SparkSession.builder.getOrCreate()
    tagged = tagging.apply_sidecar(spark.read.parquet(table), sidecar)
    tagged.write.parquet(out)
    print(*[f"{name}: {unit}" for name, unit in tagging.units_of(tagged).items()], sep="\n")
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="dimspark", description=__doc__)
    parser.add_argument("--registry", type=Path)
    parser.add_argument("command", choices=("canonicalize", "describe", "dimension", "suggest", "convert", "pin", "keygen", "retag"))
    parser.add_argument("args", nargs="+")
    asked = parser.parse_args(argv)
    try:
        registry = Registry.from_path(asked.registry) if asked.registry else default_registry()
        match asked.command, asked.args:
            case "canonicalize", [unit]:
                print(registry.canonicalize(unit))
            case "describe", [unit]:
                print(registry.describe(unit) or "")
            case "dimension", [unit]:
                print(json.dumps(registry.dimension(unit)))
            case "suggest", [text]:
                print(*registry.suggest(text), sep="\n")
            case "convert", [source, target]:
                print(registry.conversion(source, target).formula())
            case "convert", [source, target, value]:
                print(registry.conversion(source, target).apply(float(value)))
            case "pin", [path]:
                print(Registry.from_path(path).pin)
            case "keygen", [path]:
                with open(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "w") as out:
                    out.write(secrets.token_hex(32) + "\n")
                print(f"a key for seals is in {path}, for its owner alone to read")
            case "retag", [table, sidecar, out]:
                return retag(table, Path(sidecar).read_text(encoding="utf-8"), out)
            case _:
                parser.error("wrong number of arguments")
    except UnitError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
