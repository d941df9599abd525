"""Typed expressions and frames: SQL text, tags in schemas, values and refusals."""

import warnings

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dimspark.errors import UnitError, UnitWarning
from dimspark.functions import bulk, scalar
from dimspark.functions.expr import q
from dimspark.operators import aggregates as A
from dimspark.operators.frame import UnitFrame
from dimspark.operators.plan import Plan
from dimspark.sources import files, tagging
from dimspark.sources.tagging import KEY, retag, tag, units_of
from dimspark.trust import seals
from dimspark.units import default_registry

R = default_registry()
PLAN = Plan(R, {"p_mw": "MW", "q_mvar": "Mvar", "hours": "h", "t_c": "degC", "theta_deg": "deg", "small": "kW", "q": "Btu", "odd name": "m"})


@pytest.mark.parametrize("e,sql,unit", [
    (lambda p: p["p_mw"].to("kW"), "(p_mw * 1000)", "kW"), (lambda p: p["q"].to("J"), "(q * 52752792631 / 50000000)", "J"),
    (lambda p: p["theta_deg"].to("rad"), "(theta_deg * pi() / 180)", "rad"), (lambda p: p["t_c"].to("K"), "(t_c + 5463.0 / 20)", "K"),
    (lambda p: p["p_mw"] * p["hours"], "(p_mw * hours)", "MW*h"), (lambda p: p["p_mw"] + p["small"], "(p_mw + (small / 1000))", "MW"),
    (lambda p: (p["p_mw"] * p["hours"]).to("kWh"), "((p_mw * hours) * 1000)", "kWh"), (lambda p: p["p_mw"].to("MW"), "p_mw", "MW"),
    (lambda p: p["odd name"] / p["hours"], "(`odd name` / hours)", "m*h^-1"), (lambda p: p["t_c"].to("degF"), "(t_c * 9 / 5 + 32)", "degF"),
    (lambda p: p["p_mw"] / p["p_mw"], "(p_mw / p_mw)", "1"), (lambda p: p["p_mw"] ** 2, "(p_mw * p_mw)", "MW^2"),
])
def test_text_and_unit(e, sql, unit):
    made = e(PLAN)
    assert made.sql == sql and made.unit == unit


def test_plan_errors():
    with pytest.raises(UnitError, match="cannot add MW to deg") as e:
        PLAN["p_mw"] + PLAN["theta_deg"]
    assert e.value.code == "E_DIM_MISMATCH"
    with pytest.raises(UnitError, match="E_AFFINE_COMPOUND"):
        PLAN["t_c"] * PLAN["hours"]
    with pytest.raises(UnitError, match="E_DIM_MISMATCH"):
        PLAN["p_mw"] + 5
    with pytest.raises(KeyError, match="p_mw"):
        PLAN["nothing"]
    assert "p_mw" in PLAN and "p_mw:MW" in repr(PLAN)


@pytest.fixture
def power(spark):
    return spark.createDataFrame([(10.0, 138.0, "A", 2), (12.0, 345.0, "B", None)], "p double, v double, bus string, n int")


def test_tags(spark, power):
    tagged = tag(power, {"p": "MW/h", "v": "kV"}, R)
    assert units_of(tagged) == {"p": "MW*h^-1", "v": "kV"} and units_of(power) == {}
    assert isinstance(tag(power.schema, {"p": "MW"}, R), StructType)
    with pytest.raises(ValueError, match="no such column"):
        tag(power, {"x": "MW"}, R)
    assert units_of(tag(power, {"x": "MW", "p": "W"}, R, strict=False)) == {"p": "W"}
    with pytest.raises(UnitError):
        tag(power, {"p": "MW", "v": "nothing"}, R)
    with pytest.raises(TypeError):
        tag([1], {}, R)
    with pytest.raises(UnitError, match="E_BAD_PLACEMENT"):
        tag(power, {"bus": "MW"}, R, strict_storage=True)
    kept = tag(power.withMetadata("p", {"vendor": "keep me"}), {"p": "MW"}, R)
    assert kept.schema["p"].metadata["vendor"] == "keep me" and kept.schema["p"].metadata[KEY] == '{"unit":"MW","grammar":1}'
    with pytest.raises(UnitError, match="E_INTERVAL_MISUSE"):
        tag(power, {"p": "degC"}, R, {"p": "core:temperature_delta"})
    with pytest.raises(UnitError, match="E_INTERVAL_MISUSE"):
        tag(power, {"p": "delta_degC"}, R, {"p": "core:temperature"})


def test_end_to_end(spark):
    df = spark.createDataFrame([(100.0, 1.0, 25.0, 0.0), (250.0, 1.0, 31.0, 180.0)], "p_mw double, hours double, t_c double, theta_deg double")
    u = UnitFrame.of(df).tag({"p_mw": "MW", "hours": "h", "t_c": "degC", "theta_deg": "deg"})
    out = u.select(e=(u["p_mw"] * u["hours"]).to("kWh"), k=u["t_c"].to("K"), r=u["theta_deg"].to("rad"))
    assert out.units == {"e": "kWh", "k": "K", "r": "rad"}
    rows = out.df.collect()
    assert [r.e for r in rows] == [100000.0, 250000.0] and [r.k for r in rows] == [298.15, 304.15] and rows[1].r == 3.141592653589793
    assert UnitFrame.of(df).plan_hash() != u.plan_hash() and "odd" not in u


def test_filter_pushes_down(spark, sf_dir):
    u = UnitFrame.of(spark.read.parquet(f"{sf_dir}/events.parquet")).tag({"value": "MW"})
    plan = u.filter(u["value"] > q(100_000, "kW")).df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(value,100.0)" in plan
    with pytest.raises(UnitError, match="E_DIM_MISMATCH"):
        u["value"] > q(1, "h")


def test_aggregates(spark, power):
    u = UnitFrame.of(power, mode="strict").tag({"p": "MW", "v": "degC"})
    out = u.agg(total=A.sum_(u["p"]), least=A.min_(u["v"]), spread=A.stddev(u["v"]), squares=A.variance(u["p"]), n=A.count(u["p"]), different=A.count_distinct(u["bus"]))
    assert out.units == {"total": "MW", "least": "degC", "spread": "delta_degC", "squares": "MW^2"}
    with pytest.raises(UnitError, match="E_AFFINE_COMPOUND"):
        A.sum_(u["v"])
    rate = u.tag({"p": "MW"}, {"p": "core:power"})
    with pytest.raises(UnitError, match="E_KIND_UNSUMMABLE"):
        A.sum_(rate["p"])
    with pytest.raises(UnitError, match="E_TEMPORAL_MISMATCH"):
        A.sum_(u.tag_temporal("p", "MW", "instant")["p"])
    hourly = u.tag_temporal("p", "MW", "interval", "mean", "PT15M", "core:power")
    energy = hourly["p"].integrate()
    assert energy.unit == "MW*h" and energy.quantity == "core:energy" and energy.temporal.statistic == "sum"
    assert hourly.select(e=energy).agg(t=A.sum_(hourly.select(e=energy)["e"])).df.first().t == 5.5
    assert energy.differentiate().to("MW").unit == "MW"
    with pytest.raises(UnitError, match="E_TEMPORAL_MISMATCH"):
        u["p"].integrate()


def test_windows(spark, power):
    u = UnitFrame.of(power).tag({"v": "degC"})
    w = Window.orderBy("p")
    out = u.select(d=A.change(u["v"], w), before=A.lag(u["v"]).over(w), r=A.RANKS["rank"]().over(w))
    assert out.units == {"d": "delta_degC", "before": "degC"} and out.df.collect()[1].d == 207.0


def test_per_unit(power):
    u = UnitFrame.of(power).tag_base("p", "pu", 100, "MVA")
    assert u["p"].physical().unit == "MVA" and u.select(x=u["p"].to("kVA")).df.first().x == 1_000_000
    with pytest.raises(UnitError, match="E_BASE_MISSING"):
        UnitFrame.of(power).tag({"p": "pu"})["p"].to("MW")
    v = u.tag_base("v", "pu", 50, "MVA")
    with pytest.raises(UnitError, match="E_BASE_MISMATCH"):
        v["p"] + v["v"]


def test_modes(power):
    strict, loose, silent = (UnitFrame.of(power, mode=m).tag({"p": "MW"}) for m in ("strict", "permissive", "untracked"))
    with pytest.raises(UnitError, match="without a unit"):
        strict["p"] + strict["v"]
    with pytest.warns(UnitWarning, match="W_TAINT_INTRODUCED"):
        assert (loose["p"] * loose["v"]).unit is None
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert (loose["p"] * loose["v"]).unit is None, "said once for a lineage"
        assert (silent["p"] * silent["v"]).unit is None
    assert "v" in loose.tainted()
    precise = UnitFrame.of(power, strict_affine=True).tag({"p": "degC", "v": "degC"})
    assert (precise["p"] - precise["v"]).unit == "delta_degC"
    with pytest.raises(UnitError, match="E_AFFINE_COMPOUND"):
        precise["p"] + precise["v"]


def test_cast_policies(power):
    u = UnitFrame.of(power).tag({"n": "m"})
    assert u.select(x=u["n"].to("cm", policy="preserve")).df.schema["x"].dataType.simpleString() == "int"
    assert u.select(x=u["n"].to("ft")).df.schema["x"].dataType.simpleString() == "double"
    with pytest.raises(UnitError, match="E_CAST_LOSSY"):
        u["n"].to("ft", policy="preserve")
    with pytest.warns(UnitWarning, match="W_CAST_LOSSY"):
        assert u.select(x=u["n"].to("ft", policy="preserve", tolerance=0.1)).df.first().x == 7


def test_unions_and_keys(spark, power):
    mega, kilo = UnitFrame.of(power).tag({"p": "MW"}), UnitFrame.of(power).tag({"p": "kW"})
    with pytest.warns(UnitWarning, match="W_COERCED"):
        both = mega.union(kilo)
    assert both.units == {"p": "MW"} and sorted(r.p for r in both.df.collect()) == [0.01, 0.012, 10.0, 12.0]
    with pytest.raises(UnitError, match="E_DIM_MISMATCH"):
        mega.union(UnitFrame.of(power).tag({"p": "h"}))
    with pytest.raises(UnitError, match="E_UNIT_MISMATCH"):
        UnitFrame.of(power, mode="strict").tag({"p": "MW"}).union(kilo)
    with pytest.warns(UnitWarning, match="W_TAINT"):
        assert mega.union(UnitFrame.of(power)).units == {}
    with pytest.raises(UnitError, match="E_UNIT_MISMATCH"):
        mega.join(kilo, "p")
    with pytest.raises(UnitError, match="E_UNIT_MISMATCH"):
        mega.intersect(kilo)
    assert mega.join(mega.select("p", "bus").rename({"bus": "other"}), "p", "full").units == {"p": "MW"}
    assert mega.except_all(mega.limit(0)).df.count() == 2 and mega.intersect_all(mega).df.count() == 2


def test_joins(spark):
    values = UnitFrame.of(spark.createDataFrame([(1, 1500.0), (2, 10.0), (3, None)], "id int, x double")).tag({"x": "m"})
    spans = UnitFrame.of(spark.createDataFrame([("a", 1.0, 2.0), ("b", 0.0, 100.0), ("c", 5.0, 5.0)], "name string, low double, high double")).tag({"low": "km", "high": "km"})
    found = values.range_join(spans, "x", "low", "high", 0.5, "km").df.select("id", "name").collect()
    assert sorted(map(tuple, found)) == [(1, "a"), (1, "b"), (2, "b")]
    theta = values.join_where(spans, lambda a, b: (a["x"] >= b["low"]) & (a["x"] < b["high"]), nested=True).df.select("id", "name").collect()
    assert sorted(map(tuple, theta)) == sorted(map(tuple, found))
    left = UnitFrame.of(spark.createDataFrame([("k", 5), ("k", 1), ("j", 9)], "k string, t int"))
    right = UnitFrame.of(spark.createDataFrame([("k", 2, 7.0), ("k", 5, 8.0)], "k string, t int, v double")).tag({"v": "MW"})
    out = left.asof_join(right, ["k"], "t", "t", ["v"])
    assert out.units == {"v": "MW"} and sorted(map(tuple, out.df.collect())) == [("j", 9, None), ("k", 1, None), ("k", 5, 8.0)]
    import random

    rng = random.Random(1)
    times = lambda n: [(rng.choice("kj"), rng.randrange(1000), float(i)) for i in range(n)]
    many = [UnitFrame.of(spark.createDataFrame(times(200), "k string, t int, v double").dropDuplicates(["k", "t"])) for _ in range(2)]
    a, b = many[0].rename({"v": "x"}), many[1]
    plain, binned = (sorted(map(tuple, a.asof_join(b, ["k"], "t", "t", ["v"], w).df.collect())) for w in (None, 7.0))
    assert plain == binned


def test_rename_drops_descriptions(power):
    u = UnitFrame.of(tagging.describe(power, "p", "Power", "at the busbar")).tag({"p": "MW"})
    assert tagging.axis_label(u.df, "p", R) == "Power (MW)"
    named = u.rename({"p": "power"})
    assert tagging.DESCRIPTION not in named.schema["power"].metadata and named.units == {"power": "MW"}
    assert tagging.DESCRIPTION in u.convert({"p": "kW"}, keep_description=True).schema["p"].metadata
    assert tagging.DESCRIPTION not in u.convert({"p": "kW"}).schema["p"].metadata


def test_retag_and_sql(spark, power):
    tagged = tag(power, {"p": "MW", "v": "kV"}, R)
    lost = spark.createDataFrame(tagged.toPandas()[["p", "bus"]]).withColumn("v", F.lit("x"))
    out, report = retag(lost, tagged)
    assert units_of(out) == {"p": "MW"} and report.restored == ("p",) and "v" in report.refused
    out, report = UnitFrame.of(tagged).sql("SELECT p, v * 2 AS v2 FROM {frame}")
    assert out.units == {"p": "MW"} and "v" in report.refused


def test_files(spark, power, tmp_path):
    tagged = tag(power, {"p": "MW", "v": "kV"}, R)
    files.write_parquet(tagged, str(tmp_path / "own"))
    assert units_of(files.read_parquet(spark, str(tmp_path / "own"))) == {"p": "MW", "v": "kV"}
    import pyarrow.parquet as pq

    for style in ("single", "extension"):
        table = files.to_arrow(tagged, style)
        pq.write_table(table, tmp_path / f"{style}.parquet")
        assert units_of(files.read_parquet(spark, str(tmp_path / f"{style}.parquet"))) == {"p": "MW", "v": "kV"}
        assert units_of(files.from_arrow(spark, table)) == {"p": "MW", "v": "kV"}
    for kind in ("json", "orc", "csv"):
        files.write_with_sidecar(tagged, str(tmp_path / kind), kind)
        assert units_of(files.read_with_sidecar(spark, str(tmp_path / kind), kind, tagged.schema if kind == "csv" else None)) == {"p": "MW", "v": "kV"}


def test_scalar_rules(power):
    u = UnitFrame.of(power).tag({"p": "m", "v": "m"})
    p, v = u["p"], u["v"]
    assert u.select(x=scalar.round_(v / 10, 1)).df.first().x == 13.8
    assert scalar.sqrt(p * v).unit == "m" and scalar.greatest(p, q(1, "km")).unit == "m" and scalar.sin(u.tag({"p": "deg"})["p"]).unit == "1"
    assert scalar.atan2(p, v).unit == "rad" and scalar.coalesce(p, v).unit == "m" and scalar.log(p / v).unit == "1" and scalar.abs_(-p).unit == "m"
    with pytest.raises(UnitError, match="E_EXP_RANGE"):
        scalar.sqrt(p)
    with pytest.raises(UnitError, match="E_DIM_MISMATCH"):
        scalar.exp(p)


def test_unit_strings_as_data(spark):
    df = spark.createDataFrame([(1.0, "km"), (2.0, "m"), (3.0, "s"), (4.0, None), (5.0, "nope")], "x double, u string")
    told = {r.u: r for r in bulk.unit_info(df, "u", R).collect()}
    assert told["km"].canonical == "km" and told["km"].dimension == {"length": 1} and told["nope"].code == "E_UNKNOWN_UNIT" and told[None].code is None
    many = spark.range(12_000).select(F.col("id").cast("double").alias("x"), F.when(F.col("id") % 2 == 0, "km").otherwise(F.concat(F.lit("no"), F.col("id"))).alias("u"))
    assert bulk.convert_by_unit_column(many, "x", "u", "m", R, "m").where("m = x * 1000").count() == 6_000, "any number of different strings"
    assert [r.m for r in bulk.convert_by_unit_column(df, "x", "u", "m", R, "m").orderBy("x").collect()] == [1000.0, 2.0, None, None, None]
    near = spark.createDataFrame([("metr",), (None,)], "u string")
    assert [r.suggestion for r in bulk.suggest_units(near, "u", R).orderBy("rank").collect()] == R.suggest("metr")


def test_seals(spark, power, tmp_path):
    u = UnitFrame.of(power).tag({"p": "MW"})
    path, seal = seals.publish(u, str(tmp_path), "us", b"key")
    assert seals.publish(u, str(tmp_path), "us", b"key")[0] == path
    back = spark.read.parquet(path)
    assert seals.verify(back.repartition(3), seal, {"us": b"key"}).state == "intact"
    assert seals.verify(back, seal, {}).state == "unknown publisher"
    changed = seals.verify(tag(back.withColumn("v", F.col("v") + 1), {"p": "MW"}, R), seal, {"us": b"key"})
    assert changed.state == "altered" and changed.changed == ("v",)
    with pytest.raises(UnitError, match="E_SEAL_BROKEN"):
        seals.verify(back, seal | {"publisher": "us", "plan": "x"}, {"us": b"key"}, strict=True)
    notice = seals.Advisory("A1", "withdrawn", {"symbol": "MW"}, "wrong factor")
    assert seals.advisories_for(u, [notice]) == [notice]
    with pytest.raises(UnitError, match="E_ADVISORY_MATCH"):
        seals.advisories_for(u, [notice], refuse_at="caution")


def test_streams_keep_tags(spark, sf_dir):
    from dimspark.streaming import windows

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    u = UnitFrame.of(windows.read_stream(spark, f"{sf_dir}/events*.parquet", schema)).tag({"value": "MW"})
    u = windows.with_event_time(u, "ts", "1 hour")
    assert u.df.isStreaming and u.units == {"value": "MW"}
    made = windows.tumbling(u, "ts", "1 day").agg(most=A.max_(u["value"]))
    assert made.units == {"most": "MW"} and made.df.isStreaming
    assert windows.dedup_within_watermark(u, "event_id").units == {"value": "MW"}
    hourly = u.tag_temporal("value", "MW", "interval", "mean", "PT1H")
    stated = windows.over_period(A.mean(hourly["value"]), "P1D")
    assert stated.result.temporal.period == "P1D" and windows.without_period(stated).result.temporal is None


def test_provenance(power):
    import json

    from dimspark.sources.provenance import embedded_registry, merge_provenance, provenance, provenance_of, with_provenance
    from dimspark.units import Registry

    other = Registry('[registry]\nschema_version = 1\nname = "other"\nversion = "1"\n')
    full, pin, foreign = provenance(R, "strict"), provenance(R, full=False), provenance(other)
    df = with_provenance(tag(power, {"p": "MW"}, R), full)
    assert provenance_of(df.filter("p > 0")) == full and embedded_registry(full).pin == R.pin and embedded_registry(pin, lambda _: R.source).pin == R.pin
    with pytest.raises(UnitError, match="not available here"):
        embedded_registry(pin)
    with pytest.raises(UnitError, match="is not the registry"):
        embedded_registry(pin, lambda _: other.source)
    merged = json.loads(merge_provenance(full, foreign))
    assert merged["mode"] == "permissive" and [c["name"] for c in merged["composed_from"]] == ["other"]


def test_provenance_of_both_sides(spark):
    """A join and a union tell where the units of both come from, and keep the weaker mode."""
    import json
    from dataclasses import replace

    from dimspark.sources import provenance

    head = '[registry]\nschema_version = 1\nname = "{}"\nversion = "1"\n[unit.m]\ndimension = "length"\nfactor = [1, 1]\n'
    sides = []
    for name, mode in (("a", "strict"), ("b", "permissive")):
        u = UnitFrame.of(spark.createDataFrame([(1, 2.0)], "k int, x double"), R).tag({"x": "m"})
        from dimspark.units import Registry

        sides.append(replace(u, raw=provenance.with_provenance(u.df, provenance.provenance(Registry(head.format(name)), mode)), pending={}))
    for made in (sides[0].join(sides[1].rename({"x": "y"}), "k"), sides[0].union(sides[1])):
        told = json.loads(provenance.provenance_of(made.df))
        assert told["mode"] == "permissive" and told["registry"]["name"] == "a" and [x["name"] for x in told["composed_from"]] == ["b"]


def test_tags_wait_for_the_next_projection(spark):
    """A tag alone plans nothing; filters, groups and projections carry it, and a frame that was handed out is kept."""
    df = spark.createDataFrame([(1, 2.0, 3.0)], "k int, x double, y double")
    u = UnitFrame.of(df).tag({"x": "m"}).tag({"y": "s"})
    assert u.raw is df and u.units == {"x": "m", "y": "s"} and tag(df, {"x": "m"}, R).schema["x"] == u.schema["x"]
    assert u.filter(F.col("k") > 0).select("x", "k").df.schema["x"].metadata == u.df.schema["x"].metadata
    assert u.filter(u.df["x"] > 0).df.count() == 1
    assert u.group_by("x").agg(n=A.count()).units == {"x": "m"} and u.with_columns(z=u["x"] / u["y"]).units == {"x": "m", "y": "s", "z": "m*s^-1"}
    assert u.convert({"x": "km"}).units == {"x": "km", "y": "s"}


def test_range_join_of_wide_intervals(spark):
    """Intervals of any width touch few bins; the rows are those of all pairs."""
    inf = float("inf")
    values = [-1e18, -3.0, -0.0, 0.0, 1.5, 7.25, 1e3, 1e12, 5e17, None]
    ranges = [(0.0, 1.0), (-3.0, 1e15), (1.5, 1.5), (2.0, 1.0), (0.0, inf), (-inf, 0.0), (-inf, inf), (7.0, 8.0), (None, 3.0), (1e12, 1e12 + 1)]
    left = UnitFrame.of(spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")).tag({"v": "m"})
    right = UnitFrame.of(spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(ranges)], "k int, a double, b double")).tag({"a": "m", "b": "m"})
    made = left.range_join(right, "v", "a", "b", 1.0).df.select("i", "k")
    want = sorted((i, k) for i, v in enumerate(values) for k, (a, b) in enumerate(ranges) if None not in (v, a, b) and a <= v < b)
    assert sorted(map(tuple, made.collect())) == want
    with pytest.raises(ValueError, match="all pairs"):
        left.join_where(right, lambda x, y: x["v"] < y["b"])
