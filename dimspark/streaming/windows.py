"""Streams: the same typed operations on unbounded frames, with event-time windows and late data.

Tags are in the schema, so they cost a stream nothing; watermark metadata is merged with them.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dimspark.operators.aggregates import Aggregate
from dimspark.operators.frame import Grouped, UnitFrame
from dimspark.units.blob import period_seconds


def read_stream(spark: SparkSession, path: str, schema: StructType, kind: str = "parquet", **options: str) -> DataFrame:
    """A stream of files whose schema, tags and all, is given."""
    return spark.readStream.format(kind).options(**options).schema(schema).load(path)


def with_event_time(frame: UnitFrame, column: str, delay: str) -> UnitFrame:
    """A watermark on a column, which becomes a timestamp with a zone; tags stay."""
    if frame.df.schema[column].dataType.simpleString() != "timestamp":
        frame = replace(frame, raw=frame.df.withColumn(column, F.col(column).cast("timestamp")), pending={})
    return frame._next(frame.df.withWatermark(column, delay), "watermark", column=column, delay=delay)


def _windowed(frame: UnitFrame, window, keys: tuple[str, ...], op: str) -> Grouped:
    return Grouped(frame, ["window", *keys], frame.df.groupBy(window.alias("window"), *keys), op)


def tumbling(frame: UnitFrame, column: str, length: str, *keys: str) -> Grouped:
    return _windowed(frame, F.window(column, length), keys, "aggregate.window")


def sliding(frame: UnitFrame, column: str, length: str, step: str, *keys: str) -> Grouped:
    """Windows overlap, so their sums must not be summed again."""
    return _windowed(frame, F.window(column, length, step), keys, "aggregate.sliding")


def session(frame: UnitFrame, column: str, gap: str, *keys: str) -> Grouped:
    """Windows of no fixed length: what an aggregate says of time is dropped."""
    return _windowed(frame, F.session_window(column, gap), keys, "aggregate.session")


def without_period(a: Aggregate) -> Aggregate:
    return replace(a, result=replace(a.result, temporal=None)) if a.result is not None else a


def over_period(a: Aggregate, period: str) -> Aggregate:
    """An aggregate whose window's length the caller states as the period of the result."""
    period_seconds(period)
    t = a.result.temporal if a.result is not None else None
    return replace(a, result=replace(a.result, temporal=replace(t, period=period))) if t else a


def dedup_within_watermark(frame: UnitFrame, *keys: str) -> UnitFrame:
    return frame._next(frame.df.dropDuplicatesWithinWatermark(list(keys)), "distinct", names=list(keys))
