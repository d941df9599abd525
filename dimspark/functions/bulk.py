"""Unit strings as data: a column of unit names, canonicalized, described or suggested for.

Distinct strings are few beside rows: they are looked up once each, on the executors, in Arrow
batches of the distinct strings alone, and joined back. Nothing runs before the result is asked
for, however many strings there are; adaptive execution broadcasts the looked-up table if its
measured size allows.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dimspark.errors import UnitError
from dimspark.units import dims
from dimspark.units.registry import Registry

INFO = "canonical string, dimension map<string,int>, description string, code string, message string"


def unit_facts(registry: Registry, text: str | None) -> tuple:
    if text is None:
        return None, None, None, None, None
    try:
        unit = registry.canonicalize(text)
    except UnitError as e:
        return None, None, None, e.code, e.message
    return unit.text, dims.to_map(unit.dimension), registry.describe(text), None, None


def _looked_up(df: DataFrame, column: str, schema: str, names: list[str], fn: Callable[[str], tuple]) -> DataFrame:
    """df with what fn says of the distinct strings of a column; null strings have nulls."""
    texts = df.select(F.col(column).alias("__unit")).where(F.col(column).isNotNull()).distinct()

    def look_up(parts):
        for part in parts:
            yield pd.DataFrame([(t, *fn(t)) for t in part["__unit"]], columns=["__unit", *names])

    known = texts.mapInPandas(look_up, f"__unit string, {schema}")
    return df.join(known, F.col(column) == F.col("__unit"), "left").drop("__unit")


def unit_info(df: DataFrame, column: str, registry: Registry) -> DataFrame:
    """df with canonical, dimension, description, code and message of the unit strings in a column."""
    return _looked_up(df, column, INFO, ["canonical", "dimension", "description", "code", "message"], lambda t: unit_facts(registry, t))


def convert_by_unit_column(df: DataFrame, value: str, unit: str, target: str, registry: Registry, result: str) -> DataFrame:
    """Values whose unit stands in another column, in one unit; null where the units don't fit."""
    registry.canonicalize(target)

    def line(text: str) -> tuple[float | None, float | None]:
        try:
            c = registry.conversion(text, target)
        except UnitError:
            return None, None
        return float(c.factor), float(c.offset)

    joined = _looked_up(df, unit, "__factor double, __offset double", ["__factor", "__offset"], line)
    return joined.withColumn(result, F.col(value) * F.col("__factor") + F.col("__offset")).drop("__factor", "__offset")


def suggest_units(df: DataFrame, column: str, registry: Registry, top: int = 4) -> DataFrame:
    """(column, suggestion, rank): spellings that may be meant by the distinct strings of a column.

    The candidates are the registry's own, a table of bounded size that is broadcast; distances
    are the engine's levenshtein with a bound.
    """
    texts = df.select(F.col(column).alias("text")).where(F.col(column).isNotNull()).distinct()
    candidates = F.broadcast(registry.candidates_df(df.sparkSession))
    budget = F.when(F.octet_length("text") <= 4, 1).otherwise(2)
    near = texts.join(candidates, (F.abs(F.length("text") - F.length("candidate")) <= budget) & (F.col("text") != F.col("candidate")))
    near = near.withColumn("distance", F.levenshtein(F.lower("text"), F.lower("candidate"), 2)).where((F.col("distance") >= 0) & (F.col("distance") <= budget))
    ranked = near.withColumn("rank", F.expr("row_number() over (partition by text order by distance, candidate)"))
    return ranked.where(F.col("rank") <= top).select(F.col("text").alias(column), F.col("candidate").alias("suggestion"), "rank")
