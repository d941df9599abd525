"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dimspark.sources.storage import shared_folder

#: A word, as every contract on words defines it.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of a batch that Python objects are made of at a time, about.
SLICE_BYTES = 4 << 20


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session, set from spark.checkpoint.dir where none is set yet."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(spark))
    return sc._jsc.sc().getCheckpointDir().get()


def settle(df: DataFrame) -> DataFrame:
    """Computes df once into the shared checkpoint folder, so that a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release_memory() -> None:
    """Gives what a Python worker no longer uses back to its machine; workers wait long for their next task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def map_rows(df: DataFrame, schema: StructType | str, fn: Callable[..., tuple], columns: list[str], slice_rows: int = 2000) -> DataFrame:
    """Applies fn(*values) to each row of the named columns and returns its tuples as rows of schema.

    Batches are cut into slices of slice_rows rows, or about SLICE_BYTES, so that the Python side holds few texts at a time.
    """
    spark_schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(spark_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, min(slice_rows, SLICE_BYTES * batch.num_rows // max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                out = [fn(*row) for row in zip(*(c.to_pylist() for c in part.columns))]
                arrays = [pa.array(list(v), type=f.type) for v, f in zip(zip(*out), arrow)]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)
        release_memory()

    return df.select(*columns).mapInArrow(run, spark_schema)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Identifies a row by its id and whole text; rows that agree in both share every per-document result."""
    return F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.lit(":"), F.coalesce(F.col(text), F.lit(""))))
