"""Databases, messages, closure levels and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from dimspark.__main__ import main
from dimspark.operators.frame import UnitFrame
from dimspark.sources import external, tagging
from dimspark.trust.closure import Node, closure_level, size_lint
from dimspark.units import default_registry

R = default_registry()


def test_database_tables_have_tags(spark, tmp_path):
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    df = tagging.tag(spark.createDataFrame([(i, float(i)) for i in range(20)], "id int, power double"), {"power": "MW"}, R)
    text = external.write_jdbc(df, url, "loads", driver=driver)
    by_call = external.read_jdbc(spark, url, "loads", R, {"power": "MW"}, partition=("ID", 0, 20, 4), driver=driver)
    assert by_call.rdd.getNumPartitions() == 4
    u = UnitFrame.of(by_call)
    name = next(iter(u.units))
    assert u.units == {name: "MW"} and u.select(kw=u[name].to("kW")).df.agg(F.sum("kw")).first()[0] == 190_000.0
    by_sidecar = external.read_jdbc(spark, url, "loads", R, sidecar=text.replace('"power"', f'"{name}"'), driver=driver)
    assert tagging.units_of(by_sidecar) == {name: "MW"}


def test_messages_have_tags(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5), (2, None)], "id int, power double")
    sent = external.to_messages(df, "id").withColumn("timestamp", F.lit("2024-01-01").cast("timestamp")).withColumn("value", F.col("value").cast("binary"))
    odd = sent.unionByName(spark.createDataFrame([("9", bytearray(b"no json"), None), ("8", None, None)], "key string, value binary, timestamp timestamp"))
    made = external.from_messages(odd, "id int, power double", R, {"power": "MW"})
    assert tagging.units_of(made) == {"power": "MW"} and made.columns == ["timestamp", "id", "power"]
    assert sorted(map(str, made.select("id", "power").collect())) == sorted(map(str, [*df.collect(), *spark.createDataFrame([(None, None)] * 2, df.schema).collect()]))
    odd.write.parquet(str(tmp_path / "in"))  # the same as a stream
    stream = spark.readStream.schema(odd.schema).parquet(str(tmp_path / "in"))
    u = UnitFrame.of(external.from_messages(stream, "id int, power double", R, {"power": "MW"}))
    u.select("id", kw=u["power"].to("kW")).df.writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).format("parquet").option("path", str(tmp_path / "out")).start().awaitTermination()
    assert sorted(r.kw for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.kw is not None) == [2500.0]


def test_closure_levels():
    whole = Node("raw", "sha256:1", parameters={"options": "sha256:2"})
    assert closure_level([whole], True) == "reproducible" and closure_level([whole], False) == "checkable" and closure_level([], True) == "reproducible"
    assert closure_level([whole, Node("solver", "sha256:3", deterministic=False, equivalence="objective within 1e-6")], True) == "tol-reproducible"
    assert closure_level([whole, Node("own", "sha256:4", retrievable=False)], True) == "checkable"
    for lacking in (Node("x", None), Node("x", "sha256:5", parameters={"file": None}), Node("x", "sha256:6", deterministic=False)):
        assert closure_level([whole, lacking], True) == "attested-only"


def test_size_lint(spark):
    df = tagging.tag(spark.createDataFrame([(1.0, 2.0)], "a double, b double"), {"a": "MW"}, R)
    assert size_lint(df, 10**6) == [] and "heaviest: a" in size_lint(df, 100)[0]


def test_command_line(spark, tmp_path, capsys):
    assert main(["keygen", str(tmp_path / "key")]) == 0 and len((tmp_path / "key").read_text().strip()) == 64 and (tmp_path / "key").stat().st_mode & 0o077 == 0
    with pytest.raises(FileExistsError):
        main(["keygen", str(tmp_path / "key")])
    df = spark.createDataFrame([(1, 2.0)], "id int, power double")
    df.write.parquet(str(tmp_path / "bare"))
    (tmp_path / "tags.json").write_text(tagging.sidecar(tagging.tag(df, {"power": "MW"}, R)))
    assert json.loads((tmp_path / "tags.json").read_text())
    assert main(["retag", str(tmp_path / "bare"), str(tmp_path / "tags.json"), str(tmp_path / "tagged")]) == 0
    assert "power: MW" in capsys.readouterr().out and tagging.units_of(spark.read.parquet(str(tmp_path / "tagged"))) == {"power": "MW"}
