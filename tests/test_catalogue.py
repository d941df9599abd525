"""Every registered query of the unit layer, against DuckDB on the same tables."""

import os
import tomllib
import warnings
from fractions import Fraction
from math import isnan

import duckdb
import pytest

from dimspark.functions import scalar
from dimspark.operators.frame import UnitFrame
from dimspark.plans.catalogue import ORACLES, QUERIES
from dimspark.units import registry_text


def rows(names, table):
    return sorted(repr([None if v is None else float(v) if isinstance(v, float) else str(v) for v in (r[names.index(n)] for n in sorted(names))]) for r in table)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir("/root/testdata/sf0.001"):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS FROM '/root/testdata/sf0.001/{name}'")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sf_dir, duck, name):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        made = QUERIES[name](spark, sf_dir)
        got = made.collect()
    if name not in ORACLES:
        assert got
        return
    want = duck.sql(ORACLES[name])
    assert sorted(made.columns) == sorted(want.columns)
    assert rows(made.columns, got) == rows(want.columns, want.fetchall())


def test_logarithms_at_and_below_zero(spark, tmp_path):
    values = [0.0, -50.0, 50.0, 100.0, float("nan"), float("inf"), float("-inf"), None]
    df = spark.createDataFrame(list(enumerate(values)), "event_id long, value double")
    df.write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet/*.parquet'")
    made, want = QUERIES["transcendental_functions"](spark, str(tmp_path)), con.sql(ORACLES["transcendental_functions"])
    assert rows(made.columns, made.collect()) == rows(want.columns, want.fetchall())
    u = UnitFrame.of(df).tag({"value": "1"})
    logs = {r.event_id: r.x for r in u.select("event_id", x=scalar.log10(u["value"])).df.collect()}
    assert logs[0] == float("-inf") and isnan(logs[1]) and logs[3] == 2 and isnan(logs[4]) and logs[7] is None


def test_whole_registry_is_the_data_file(spark, sf_dir):
    data = tomllib.loads(registry_text())
    prefixes = dict(zip("Q R Y Z E P T G M k h da d c m u µ μ n p f a z y r q".split(), (30, 27, 24, 21, 18, 15, 12, 9, 6, 3, 2, 1, -1, -2, -3, -6, -6, -6, -9, -12, -15, -18, -21, -24, -27, -30)))
    made = {r.symbol: r for r in QUERIES["registry_units_all"](spark, sf_dir).collect()}
    got = {k: (Fraction(int(r.numerator), int(r.denominator)), r.pi) for k, r in made.items()}
    authored = {k: (Fraction(*u["factor"]), u.get("pi", 0)) for k, u in data["unit"].items()}
    assert {k: v for k, v in got.items() if made[k].prefixed_from is None} == authored
    for k, r in made.items():
        if r.prefixed_from is not None:
            factor, pi = authored[r.prefixed_from]
            assert k.endswith(r.prefixed_from) and got[k] == (factor * Fraction(10) ** prefixes[k.removesuffix(r.prefixed_from)], pi)


def test_entry(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.columns == ["event_type", "energy_kwh"] and out.count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
