"""Tables and streams that keep no metadata of ours: databases by JDBC, and messages such as Kafka's.

A database column's comment or a message's schema has no place for a tag, so tags come with
the call, or from a sidecar text as `tagging.sidecar` writes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dimspark.sources import tagging
from dimspark.units.registry import Registry


def _tagged(df: DataFrame, registry: Registry, units: dict[str, str] | None, sidecar: str | None) -> DataFrame:
    if sidecar is not None:
        df = tagging.apply_sidecar(df, sidecar)
    return tagging.tag(df, units, registry) if units else df


def read_jdbc(spark: SparkSession, url: str, table: str, registry: Registry, units: dict[str, str] | None = None, sidecar: str | None = None, partition: tuple[str, object, object, int] | None = None, **options: str) -> DataFrame:
    """A database table with tags.

    partition: a column, its least and greatest value and a number of parts, read side by side;
    without it one task reads the table. Filters and columns are pushed down by Spark's reader.
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if partition is not None:
        column, low, high, parts = partition
        reader = reader.option("partitionColumn", column).option("lowerBound", str(low)).option("upperBound", str(high)).option("numPartitions", str(parts))
    df = reader.load()
    low = {c.lower(): c for c in df.columns}  # databases fold names as they like
    return _tagged(df, registry, {low.get(n.lower(), n): u for n, u in (units or {}).items()}, sidecar)


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "error", **options: str) -> str:
    """Writes the rows; returns the sidecar text, for whoever reads the table to have the tags again."""
    df.write.format("jdbc").option("url", url).option("dbtable", table).options(**options).mode(mode).save()
    return tagging.sidecar(df)


def read_kafka(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """The messages of a topic as a stream; the session needs Spark's Kafka package."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).options(**options).load()


def from_messages(df: DataFrame, schema: StructType | str, registry: Registry, units: dict[str, str] | None = None, sidecar: str | None = None, value: str = "value", keep: tuple[str, ...] = ("timestamp",)) -> DataFrame:
    """Messages (batch or stream) whose value is JSON, as columns with tags.

    keep: columns of the messages that stay, where there are such. A value that is null or no
    JSON of the schema gives nulls.
    """
    kept = [c for c in keep if c in df.columns]
    parsed = df.select(*kept, F.from_json(F.col(value).cast("string"), schema).alias("__parsed")).select(*kept, "__parsed.*")
    return _tagged(parsed, registry, units, sidecar)


def to_messages(df: DataFrame, key: str | None = None) -> DataFrame:
    """Rows as messages: value is JSON, key a column's text; the tags go in a sidecar of their own."""
    made = [F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value")]
    return df.select(*([F.col(key).cast("string").alias("key")] if key else []), *made)
