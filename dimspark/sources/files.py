"""Files and Arrow: readers and writers that keep tags where the format would lose them."""

from __future__ import annotations

import json
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from dimspark.sources import tagging
from dimspark.units.blob import Metadata

#: Keys that a foreign Arrow schema may use: the two-key form of an extension type.
EXTENSION_NAME, EXTENSION_METADATA = "ARROW:extension:name", "ARROW:extension:metadata"
SIDECAR = "dimspark:columns"
MARK = "_dimspark_columns"


def arrow_tags(schema: pa.Schema, key: str = tagging.KEY) -> dict[str, str]:
    """The tags in an Arrow schema, in either form."""
    found = {}
    for f in schema:
        meta = {k.decode(): v.decode("utf-8", "replace") for k, v in (f.metadata or {}).items()}
        blob = meta.get(key) or (meta.get(EXTENSION_METADATA) if meta.get(EXTENSION_NAME) == key else None)
        if blob:
            found[f.name] = blob
    side = {k.decode(): v.decode() for k, v in (schema.metadata or {}).items()}.get(SIDECAR)
    for name, body in json.loads(side).items() if side else ():
        found.setdefault(name, json.dumps(body, ensure_ascii=False, separators=(",", ":")))
    return found


def with_blobs(df: DataFrame, blobs: dict[str, str], key: str = tagging.KEY) -> DataFrame:
    for name, blob in blobs.items():
        if name in df.columns:
            Metadata.from_json(blob)
            df = df.withMetadata(name, {**(df.schema[name].metadata or {}), key: blob})
    return df


def to_arrow_schema(schema: StructType, style: str = "single", key: str = tagging.KEY) -> pa.Schema:
    """An Arrow schema with the tags. style: single (one key) or extension (an extension type's two)."""
    from pyspark.sql.pandas.types import to_arrow_schema as plain

    out = []
    for f, spark_field in zip(plain(schema), schema.fields):
        blob = tagging.blob_of(spark_field, key)
        meta = {k: v for k, v in (spark_field.metadata or {}).items() if isinstance(v, str) and k not in (key, tagging.ELEMENT_KEY)}
        if blob:
            meta |= {EXTENSION_NAME: key, EXTENSION_METADATA: blob} if style == "extension" else {key: blob}
        out.append(f.with_metadata(meta or None))
    return pa.schema(out, metadata={SIDECAR: tagging.sidecar(schema, key)} if tagging.metadata_of(schema, key) else None)


def to_arrow(df: DataFrame, style: str = "single") -> pa.Table:
    """The whole frame on the driver as a tagged Arrow table; for results that fit there."""
    return df.toArrow().cast(to_arrow_schema(df.schema, style))


def from_arrow(spark: SparkSession, table: pa.Table) -> DataFrame:
    return with_blobs(spark.createDataFrame(table), arrow_tags(table.schema))


def _footer_schema(spark: SparkSession, path: str) -> pa.Schema | None:
    """The Arrow schema in the first Parquet footer under a path, read through Spark's file systems; None without one."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    listed, where = root.getFileSystem(conf).listFiles(root, True), None  # folder by folder, as it is asked for
    while where is None and listed.hasNext():
        one = listed.next().getPath()
        if one.getName().endswith(".parquet") and not one.getName().startswith(("_", ".")):
            where = one
    if where is None:
        return None
    held = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(where, conf)
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(held)
    try:
        pairs = reader.getFooter().getFileMetaData().getKeyValueMetaData()
        text, side = pairs.get("ARROW:schema"), pairs.get(SIDECAR)
    finally:
        reader.close()
    if text is None:
        return pa.schema([], metadata={SIDECAR: side}) if side else None
    import base64

    return pa.ipc.read_schema(pa.BufferReader(base64.b64decode(text)))


def read_parquet(spark: SparkSession, path: str, key: str = tagging.KEY) -> DataFrame:
    """A Parquet table with the tags that Spark kept in its schema, or else those of its Arrow schema."""
    df = spark.read.parquet(path)
    if tagging.metadata_of(df.schema, key):
        return df
    schema = _footer_schema(spark, path)
    return with_blobs(df, arrow_tags(schema, key), key) if schema is not None else df


def write_parquet(df: DataFrame, path: str, mode: str = "error", **options: Any) -> None:
    """Spark keeps the tags of a Parquet table in its own schema entry."""
    df.write.mode(mode).options(**options).parquet(path)


def write_with_sidecar(df: DataFrame, path: str, kind: str, mode: str = "error", **options: Any) -> None:
    """CSV, JSON, ORC and others that keep no metadata: the tags go to a small JSON file beside the data."""
    df.write.mode(mode).options(**options).format(kind).save(path)
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{MARK}.json")
    out = where.getFileSystem(conf).create(where, True)
    try:
        out.write(bytearray(tagging.sidecar(df).encode()))
    finally:
        out.close()


def read_with_sidecar(spark: SparkSession, path: str, kind: str, schema: StructType | str | None = None, **options: Any) -> DataFrame:
    reader = spark.read.format(kind).options(**options)
    df = (reader.schema(schema) if schema is not None else reader).load(path)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{MARK}.json")
    fs = where.getFileSystem(conf)
    if not fs.exists(where):
        return df
    stream = fs.open(where)
    try:
        text = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    return tagging.apply_sidecar(df, text)
