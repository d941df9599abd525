"""Custom state for each key of a stream, with an output whose units are declared beforehand.

`transform_with_state` is the way for new code: a processor has several states, lists, maps,
timers and expiry, and its schema can evolve. `apply_with_state` has one state for each key.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import StructType

from dimspark.operators.frame import UnitFrame
from dimspark.sources.tagging import tag_schema, with_schema_metadata


def apply_with_state(frame: UnitFrame, keys: list[str], fn: Callable, schema: str | StructType, units: dict[str, str], state: str | StructType, output_mode: str = "update", timeout: str = GroupStateTimeout.NoTimeout) -> UnitFrame:
    """fn(key, frames, state) in Arrow batches, as Spark's applyInPandasWithState; its output is tagged as declared.

    A tag can't be read off what fn does, so the units are the caller's claim, checked for
    spelling only, like any tag.
    """
    declared = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    held = StructType.fromDDL(state) if isinstance(state, str) else state
    tagged = tag_schema(declared, units, frame.registry)
    out = frame.df.groupBy(*keys).applyInPandasWithState(fn, declared, held, output_mode, timeout)
    return replace(frame, raw=with_schema_metadata(out, tagged), pending={}, log=(*frame.log, {"op": "state", "keys": keys, "units": units}))


#: The state store that processors need, a fixed value of Spark.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def transform_with_state(frame: UnitFrame, keys: list[str], processor: StatefulProcessor, schema: str | StructType, units: dict[str, str], output_mode: str = "Update", time_mode: str = "None") -> UnitFrame:
    """A processor of Spark's transformWithStateInPandas; its output is tagged as declared.

    The session's state store becomes RocksDB, which processors need and any other stream can use.
    """
    frame.raw.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    declared = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    tagged = tag_schema(declared, units, frame.registry)
    out = frame.df.groupBy(*keys).transformWithStateInPandas(processor, declared, output_mode, time_mode)
    return replace(frame, raw=with_schema_metadata(out, tagged), pending={}, log=(*frame.log, {"op": "state", "keys": keys, "units": units}))
