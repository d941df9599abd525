"""The registered queries of the unit layer and the SQL that states each of them.

Sums that are compared exactly are sums of decimals: doubles would depend on the partitioning.
"""

from __future__ import annotations

import json
import tomllib
import uuid
import warnings
from collections.abc import Callable
from dataclasses import replace
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dimspark.errors import UnitError
from dimspark.functions import bulk, scalar
from dimspark.functions.expr import q
from dimspark.operators import aggregates as A
from dimspark.operators.frame import UnitFrame
from dimspark.sources import files, provenance, tagging
from dimspark.sources.storage import shared_folder
from dimspark.streaming import windows
from dimspark.streaming.stateful import apply_with_state, transform_with_state
from dimspark.units import compose, default_registry, dims, registry_text
from dimspark.units.boundary import check_boundary
from dimspark.units.registry import Registry

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def frame(spark: SparkSession, sf_dir: str, table: str, mode: str = "permissive", **units: str) -> UnitFrame:
    return UnitFrame.of(spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet"), mode=mode).tag(units)


def events(spark: SparkSession, sf_dir: str, unit: str) -> UnitFrame:
    return frame(spark, sf_dir, "events", value=unit)


def lines(spark: SparkSession, sf_dir: str) -> UnitFrame:
    return frame(spark, sf_dir, "lineitem", l_quantity="lb", l_extendedprice="USD", l_discount="1", l_tax="1")


def hourly_power(spark: SparkSession, sf_dir: str) -> UnitFrame:
    return frame(spark, sf_dir, "events").tag_temporal("value", "MW", "interval", "mean", "PT1H", "core:power")


# --- conversion ---------------------------------------------------------------


def _conversion(name: str, source: str, target: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        u = events(spark, sf_dir, source)
        return u.select("event_id", converted=u["value"].to(target)).df

    run.__name__ = name
    query(f"SELECT event_id, {sql} AS converted FROM events")(run)


_conversion("convert_integer_factor", "MW", "kW", "value * 1000")
_conversion("convert_divisor", "kW", "MW", "value / 1000")
_conversion("convert_rational", "Btu", "J", "value * 52752792631 / 50000000")
_conversion("convert_affine_fahrenheit", "degC", "degF", "(value * 9 / 5) + 32")
_conversion("convert_affine_kelvin", "degC", "K", "value + 5463.0 / 20")
_conversion("convert_delta", "delta_degC", "delta_degF", "value * 9 / 5")
_conversion("convert_pi", "deg", "rad", "value * pi() / 180")
_conversion("convert_compound", "MW*h", "Btu", "value * 180000000000000000 / 52752792631")
_conversion("convert_speed", "mi/h", "m/s", "value * 1397 / 3125")
_conversion("convert_identity", "MW", "MW", "value")


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) * 381 / 1250 AS size_m FROM part")
def int_promote(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = frame(spark, sf_dir, "part", p_size="ft")
    return u.select("p_partkey", size_m=u["p_size"].to("m")).df


@query("SELECT p_partkey, CAST(p_size * 100 AS INTEGER) AS size_cm FROM part")
def int_preserve(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = frame(spark, sf_dir, "part", p_size="m")
    return u.select("p_partkey", size_cm=u["p_size"].to("cm", policy="preserve")).df


@query("SELECT vec_id, unnest(range(0, len(embedding))) AS place, unnest(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 1000)) AS mm FROM embeddings")
def array_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = frame(spark, sf_dir, "embeddings", embedding="m")
    made = u.select("vec_id", mm=scalar.elements(u["embedding"], "mm"))
    return made.df.select("vec_id", F.posexplode("mm").alias("place", "mm")).withColumn("place", F.col("place").cast("long"))


# --- arithmetic -----------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
def mul_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = lines(spark, sf_dir)
    return u.select("l_orderkey", "l_linenumber", net=u["l_extendedprice"] * (1 - u["l_discount"])).df


@query("SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity AS price_per_lb FROM lineitem")
def div_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = lines(spark, sf_dir)
    return u.select("l_orderkey", "l_linenumber", price_per_lb=u["l_extendedprice"] / u["l_quantity"]).df


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN NULL ELSE l_tax / l_discount END AS ratio FROM lineitem")
def try_div_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = lines(spark, sf_dir)
    return u.select("l_orderkey", "l_linenumber", ratio=u["l_tax"].try_divide(u["l_discount"])).df


@query("SELECT event_id, value + (value * 2) / 1000 AS total FROM events")
def add_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = events(spark, sf_dir, "MW")
    u = u.with_columns(small=u.tag({"value": "kW"})["value"] * 2)
    return u.select("event_id", total=u["value"] + u["small"]).df


@query("SELECT event_id, value - (value * 2) / 1000 AS total FROM events")
def sub_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = events(spark, sf_dir, "MW")
    u = u.with_columns(small=u.tag({"value": "kW"})["value"] * 2)
    return u.select("event_id", total=u["value"] - u["small"]).df


@query("SELECT event_id, value FROM events WHERE value > 100")
def compare_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = events(spark, sf_dir, "MW")
    return u.filter(u["value"] > q(100_000, "kW")).select("event_id", "value").df


@query("SELECT event_id, value FROM events WHERE value >= 50 AND value <= 60")
def compare_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = events(spark, sf_dir, "degC")
    return u.filter(u["value"].between(q(122, "degF"), q(140, "degF"))).select("event_id", "value").df


@query("SELECT l_orderkey, l_linenumber, l_discount * 100 AS discount_mva FROM lineitem")
def pu_physical(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = frame(spark, sf_dir, "lineitem").tag_base("l_discount", "pu", 100, "MVA")
    return u.select("l_orderkey", "l_linenumber", discount_mva=u["l_discount"].physical()).df


@query("SELECT event_id, sqrt(value * value) AS root, value * value AS square, abs(value - 100) AS off, greatest(value, 50) AS top FROM events")
def math_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = events(spark, sf_dir, "m")
    v = u["value"]
    return u.select("event_id", root=scalar.sqrt(v * v), square=v**2, off=scalar.abs_(v - q(100, "m")), top=scalar.greatest(v, q(50, "m"))).df


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN value ELSE value * 1000 END AS power FROM events")
def conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = events(spark, sf_dir, "kW")
    megawatts = u.tag({"value": "MW"})["value"]
    return u.select("event_id", power=scalar.when(F.col("event_type") == "error", u["value"], megawatts)).df


@query("SELECT event_id, round(sin(value * pi() / 180), 9) AS height, round(ln(value / 100), 9) AS logged, round(exp(value / 1000), 9) AS grown, round(atan2(value, 100.0), 9) AS angle FROM events")
def transcendental_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of angles and of pure numbers; rounded, since libraries differ in the last digit."""
    u = events(spark, sf_dir, "m")
    v, angle = u["value"], u.tag({"value": "deg"})["value"]
    made = u.select("event_id", height=scalar.sin(angle.to("rad")), logged=scalar.log(v / q(100, "m")), grown=scalar.exp(v / q(1, "km")), angle=scalar.atan2(v, scalar.constant(v, 100, "m")))
    return made.df.select("event_id", *[F.round(c, 9).alias(c) for c in ("height", "logged", "grown", "angle")])


@query("SELECT event_id, coalesce(CASE WHEN event_type = 'error' THEN NULL ELSE value END, value * 2 / 1000) AS power FROM events")
def coalesced(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = events(spark, sf_dir, "MW")
    small = u.tag({"value": "kW"})["value"] * 2
    return u.select("event_id", power=scalar.coalesce(scalar.when(F.col("event_type") != "error", u["value"]), small)).df


@query("SELECT l_orderkey, l_linenumber, l_quantity AS weight_lb FROM lineitem WHERE l_quantity < 10")
def project_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = lines(spark, sf_dir)
    return u.filter(u["l_quantity"] < q(160, "oz")).rename({"l_quantity": "weight_lb"}).select("l_orderkey", "l_linenumber", "weight_lb").df


# --- time -------------------------------------------------------------------------


@query("SELECT event_type, CAST(sum(CAST(value AS DECIMAL(18,2)) * 1000) AS DOUBLE) AS energy_kwh FROM events GROUP BY event_type")
def integrate_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = hourly_power(spark, sf_dir)
    u = u.select("event_type", energy=u["value"].integrate().to("kWh"))
    return u.group_by("event_type").agg(energy_kwh=A.sum_(u["energy"], exact_scale=2)).df


@query("SELECT event_id, value * 4 AS mean_mw FROM events")
def differentiate(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = frame(spark, sf_dir, "events").tag_temporal("value", "MWh", "interval", "sum", "PT15M", "core:energy")
    return u.select("event_id", mean_mw=u["value"].differentiate().to("MW")).df


# --- aggregates -----------------------------------------------------------------------

_SUM = "CAST(sum(CAST({} AS DECIMAL(28,2))) AS DOUBLE)"


@query(f"SELECT l_returnflag, l_linestatus, {_SUM.format('l_quantity')} AS sum_lb, {_SUM.format('l_extendedprice')} AS sum_usd, min(l_quantity) AS least_lb, max(l_extendedprice) AS most_usd, {_SUM.format('l_quantity')} / count(l_quantity) AS mean_lb, count(*) AS n FROM lineitem GROUP BY ALL")
def agg_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = lines(spark, sf_dir)
    return u.group_by("l_returnflag", "l_linestatus").agg(sum_lb=A.sum_(u["l_quantity"], 2), sum_usd=A.sum_(u["l_extendedprice"], 2), least_lb=A.min_(u["l_quantity"]), most_usd=A.max_(u["l_extendedprice"]), mean_lb=A.exact_mean(u["l_quantity"], 2), n=A.count(u["l_quantity"])).df


@query("SELECT l_returnflag, count(DISTINCT l_quantity) AS different FROM lineitem GROUP BY l_returnflag")
def agg_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = lines(spark, sf_dir)
    return u.group_by("l_returnflag").agg(different=A.count_distinct(u["l_quantity"])).df


@query("SELECT event_type, median(value) AS middle, quantile_cont(value, 0.5) AS half FROM events GROUP BY event_type")
def agg_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = events(spark, sf_dir, "degC")
    return u.group_by("event_type").agg(middle=A.median(u["value"]), half=A.percentile(u["value"], 0.5)).df


@query(f"SELECT l_returnflag, l_linestatus, {_SUM.format('l_quantity')} AS sum_lb FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def agg_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = lines(spark, sf_dir)
    return u.rollup("l_returnflag", "l_linestatus").agg(sum_lb=A.sum_(u["l_quantity"], 2)).df


@query(f"SELECT l_returnflag, l_linestatus, {_SUM.format('l_quantity')} AS sum_lb FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def agg_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = lines(spark, sf_dir)
    return u.cube("l_returnflag", "l_linestatus").agg(sum_lb=A.sum_(u["l_quantity"], 2)).df


@query(f"SELECT l_returnflag, l_linestatus, {_SUM.format('l_quantity')} AS sum_lb FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus))")
def agg_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = lines(spark, sf_dir)
    return u.grouping_sets([["l_returnflag"], ["l_linestatus"]], "l_returnflag", "l_linestatus").agg(sum_lb=A.sum_(u["l_quantity"], 2)).df


@query("SELECT event_type, max(value) * 9 / 5 + 32 AS hottest FROM events GROUP BY event_type")
def agg_then_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A maximum needs one conversion for each group, not for each row."""
    u = events(spark, sf_dir, "degC")
    u = u.group_by("event_type").agg(hottest=A.max_(u["value"]))
    return u.convert({"hottest": "degF"}).df


@query("SELECT event_type, round(stddev_samp(value), 6) AS spread, round(var_samp(value), 4) AS squared FROM events GROUP BY event_type")
def agg_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A spread of temperatures is a difference; its square has the squared unit. Rounded, since sums of doubles depend on their order."""
    u = events(spark, sf_dir, "K")
    made = u.group_by("event_type").agg(spread=A.stddev(u["value"]), squared=A.variance(u["value"])).df
    return made.select("event_type", F.round("spread", 6).alias("spread"), F.round("squared", 4).alias("squared"))


@query("SELECT event_type, TRUE AS distinct_is_near, TRUE AS middle_is_near FROM events GROUP BY event_type")
def agg_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches against the exact figures: distinct values within four standard errors, the median's share of rows within 2 %."""
    u = events(spark, sf_dir, "MW")
    made = u.group_by("event_type").agg(near=A.approx_count_distinct(u["value"], 0.02), exact=A.count_distinct(u["value"]), middle=A.approx_percentile(u["value"], 0.5)).df
    below = u.df.join(made, "event_type").groupBy("event_type").agg(F.avg((F.col("value") <= F.col("middle")).cast("double")).alias("share"))
    return made.join(below, "event_type").select("event_type", (F.abs(F.col("near") - F.col("exact")) <= 0.08 * F.col("exact") + 1).alias("distinct_is_near"), (F.abs(F.col("share") - 0.5) <= 0.02).alias("middle_is_near"))


@query("SELECT event_type, round(avg(value) * 9 / 5 + 32, 6) AS mean_f, max(value) AS most_c FROM events GROUP BY event_type")
def agg_affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means and maxima of positions on an affine scale, converted after the aggregation."""
    u = events(spark, sf_dir, "degC")
    u = u.group_by("event_type").agg(mean_f=A.mean(u["value"]), most_c=A.max_(u["value"]))
    return u.convert({"mean_f": "degF"}).df.withColumn("mean_f", F.round("mean_f", 6))


# --- windows and order ----------------------------------------------------------------


@query("SELECT event_id, CAST(sum(CAST(value AS DECIMAL(28,2))) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS running FROM events")
def window_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = events(spark, sf_dir, "USD")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    running = A.Aggregate("sum", u["value"], lambda: F.sum(F.col("value").cast("decimal(28,2)")), u["value"]).over(w)
    return u.select("event_id", running=running).df.withColumn("running", F.col("running").cast("double"))


@query("SELECT event_id, (value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) * 9 / 5 AS change_f FROM events")
def window_lag_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = events(spark, sf_dir, "degC")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return u.select("event_id", change_f=A.change(u["value"], w).to("delta_degF")).df


@query("SELECT event_id, CAST(rank() OVER (PARTITION BY event_type ORDER BY value DESC) AS INTEGER) AS place FROM events")
def window_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = events(spark, sf_dir, "MW")
    return u.select("event_id", place=A.RANKS["rank"]().over(Window.partitionBy("event_type").orderBy(F.col("value").desc()))).df


@query("SELECT event_id, lead(value) OVER w * 1000 AS next_kw, nth_value(value, 3) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS third_mw FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def window_lead_nth(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = events(spark, sf_dir, "MW")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return u.select("event_id", next_kw=A.lead(u["value"]).over(w).to("kW"), third_mw=A.nth_value(u["value"], 3).over(whole)).df


@query("""SELECT event_id, CAST(ntile(4) OVER w AS INTEGER) AS quarter, percent_rank() OVER w AS share, cume_dist() OVER w AS reached, CAST(dense_rank() OVER w AS INTEGER) AS step, CAST(row_number() OVER w AS INTEGER) AS number
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY value, event_id)""")
def window_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = events(spark, sf_dir, "MW")
    w = Window.partitionBy("event_type").orderBy(u["value"].column, "event_id")
    ranks = {k: A.RANKS[n]().over(w) for k, n in (("share", "percent_rank"), ("reached", "cume_dist"), ("step", "dense_rank"), ("number", "row_number"))}
    return u.select("event_id", quarter=A.RANKS["ntile"](4).over(w), **ranks).df


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 10")
def topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_extendedprice")
    return u.order_by(F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber").limit(10).df


# --- two frames ------------------------------------------------------------------------


def _orders(spark: SparkSession, sf_dir: str) -> UnitFrame:
    return frame(spark, sf_dir, "orders", o_totalprice="USD")


def _customers(spark: SparkSession, sf_dir: str) -> UnitFrame:
    return frame(spark, sf_dir, "customer", c_acctbal="USD")


def _join(name: str, how: str, select: list[str], sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        left, right = _customers(spark, sf_dir), _orders(spark, sf_dir).filter(F.col("o_orderstatus") == "F")
        made = left.join(right, [("c_custkey", "o_custkey")], how).select(*select).df
        return made.withColumn("o_orderkey", F.col("o_orderkey").cast("string")) if "o_orderkey" in select else made

    run.__name__ = name
    query(sql)(run)


_ORDERS_F = "(SELECT * FROM orders WHERE o_orderstatus = 'F')"
_join("join_inner", "inner", ["c_custkey", "o_orderkey", "c_acctbal", "o_totalprice"], f"SELECT c_custkey, CAST(o_orderkey AS VARCHAR) AS o_orderkey, c_acctbal, o_totalprice FROM customer JOIN {_ORDERS_F} ON c_custkey = o_custkey")
_join("join_left", "left", ["c_custkey", "o_orderkey", "o_totalprice"], f"SELECT c_custkey, CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_totalprice FROM customer LEFT JOIN {_ORDERS_F} ON c_custkey = o_custkey")
_join("join_full", "full", ["c_mktsegment", "o_orderkey"], f"SELECT c_mktsegment, CAST(o_orderkey AS VARCHAR) AS o_orderkey FROM customer FULL JOIN {_ORDERS_F} ON c_custkey = o_custkey")
_join("join_semi", "left_semi", ["c_custkey", "c_acctbal"], f"SELECT c_custkey, c_acctbal FROM customer SEMI JOIN {_ORDERS_F} ON c_custkey = o_custkey")
_join("join_anti", "left_anti", ["c_custkey", "c_acctbal"], f"SELECT c_custkey, c_acctbal FROM customer ANTI JOIN {_ORDERS_F} ON c_custkey = o_custkey")


@query("SELECT n_name, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(28,2))) AS DOUBLE) * 45359237 / 100000000 AS kilograms FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def join_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight shipped to each nation: summed in pounds, converted once for each group."""
    u = lines(spark, sf_dir).join(_orders(spark, sf_dir), [("l_orderkey", "o_orderkey")]).join(_customers(spark, sf_dir), [("o_custkey", "c_custkey")]).join(frame(spark, sf_dir, "nation"), [("c_nationkey", "n_nationkey")])
    return u.group_by("n_name").agg(n=A.count(), kilograms=A.sum_(u["l_quantity"], 2)).convert({"kilograms": "kg"}).df


@query("SELECT event_id, s_suppkey FROM events JOIN supplier ON value * 1000 >= s_acctbal AND value * 1000 < s_acctbal + 500")
def range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with the suppliers whose range holds its value."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    left = UnitFrame.of(rows.select("event_id", F.col("value"))).tag({"value": "km"})
    right = UnitFrame.of(spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", F.col("s_acctbal").alias("low"), (F.col("s_acctbal") + 500).alias("high"))).tag({"low": "m", "high": "m"})
    return left.convert({"value": "m"}).range_join(right, "value", "low", "high", 1000.0).select("event_id", "s_suppkey").df


@query("""WITH e AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'purchase'), c AS (SELECT user_id, ts AS c_ts, value AS c_value, event_id AS c_id FROM events WHERE event_type = 'click')
SELECT event_id, (SELECT max(c_ts) FROM c WHERE c.user_id = e.user_id AND c_ts <= e.ts) AS click_ts FROM e""")
def asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = events(spark, sf_dir, "USD")
    left = u.filter(F.col("event_type") == "purchase").select("event_id", "user_id", "ts", "value")
    right = u.filter(F.col("event_type") == "click").rename({"ts": "click_ts", "value": "click_value"}).select("user_id", "click_ts", "click_value")
    return left.asof_join(right, ["user_id"], "ts", "click_ts", ["click_ts"], bin_width=86_400).select("event_id", "click_ts").df


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def cross_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "region").select("r_name").cross_join(frame(spark, sf_dir, "nation").select("n_name")).df


@query("SELECT c_custkey AS id, c_acctbal AS balance FROM customer UNION ALL SELECT s_suppkey, s_acctbal / 100 FROM supplier")
def union_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = frame(spark, sf_dir, "customer", c_acctbal="USD").rename({"c_custkey": "id", "c_acctbal": "balance"}).select("id", "balance")
    right = frame(spark, sf_dir, "supplier", s_acctbal="cent_us").rename({"s_suppkey": "id", "s_acctbal": "balance"}).select("id", "balance")
    return left.union(right).df


@query("SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "customer").rename({"c_nationkey": "nation"}).select("nation").intersect(frame(spark, sf_dir, "supplier").rename({"s_nationkey": "nation"}).select("nation")).df


@query("SELECT l_extendedprice AS price FROM lineitem EXCEPT SELECT l_extendedprice FROM lineitem WHERE l_returnflag = 'R'")
def except_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = lines(spark, sf_dir).rename({"l_extendedprice": "price"})
    return u.select("price").except_(u.filter(F.col("l_returnflag") == "R").select("price")).df


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n, max(value) AS most FROM events GROUP BY event_type")
def sql_passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = events(spark, sf_dir, "MW").sql("SELECT event_type, count(*) AS n, max(value) AS most FROM {frame} GROUP BY event_type")
    return out.df


@query(f"SELECT c_custkey, CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_totalprice FROM (SELECT * FROM customer WHERE c_acctbal > 0) RIGHT JOIN {_ORDERS_F} ON c_custkey = o_custkey WHERE c_custkey IS NOT NULL")
def join_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _customers(spark, sf_dir), _orders(spark, sf_dir).filter(F.col("o_orderstatus") == "F")
    made = left.filter(left["c_acctbal"] > q(0, "USD")).join(right, [("c_custkey", "o_custkey")], "right").filter(F.col("c_custkey").isNotNull())
    return made.select("c_custkey", "o_orderkey", "o_totalprice").df.withColumn("o_orderkey", F.col("o_orderkey").cast("string"))


def _nations(spark: SparkSession, sf_dir: str) -> tuple[UnitFrame, UnitFrame]:
    return tuple(frame(spark, sf_dir, t).rename({f"{p}_nationkey": "nation"}).select("nation") for t, p in (("customer", "c"), ("supplier", "s")))


@query("SELECT c_nationkey AS nation FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
def intersect_all_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, suppliers = _nations(spark, sf_dir)
    return customers.intersect_all(suppliers).df


@query("SELECT c_nationkey AS nation FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def except_all_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, suppliers = _nations(spark, sf_dir)
    return customers.except_all(suppliers).df


# --- units as data ------------------------------------------------------------------------

_NAMES = ("MW*hr", "kilowatts", "W/m^2/K", "degC", "Zorkmid", "m s", "degC*h", "MW*h/MWh", "MBtu")


@query("""SELECT * FROM (VALUES ('MW*hr', 'MW*h', NULL), ('kilowatts', 'kW', NULL), ('W/m^2/K', 'W*K^-1*m^-2', NULL), ('degC', 'degC', NULL), ('Zorkmid', NULL, 'E_UNKNOWN_UNIT'),
('m s', NULL, 'E_UNIT_SYNTAX'), ('degC*h', NULL, 'E_AFFINE_COMPOUND'), ('MW*h/MWh', 'MW*h*MWh^-1', NULL), ('MBtu', NULL, 'E_UNKNOWN_UNIT')) t(unit, canonical, code)""")
def unit_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = spark.createDataFrame([(n,) for n in _NAMES], "unit string")
    return bulk.unit_info(texts, "unit", default_registry()).select("unit", "canonical", "code")


@query("""SELECT * FROM (VALUES ('MEGAWATT', 'megawatt', 1), ('MEGAWATT', 'megawatts', 2), ('MEGAWATT', 'megabar', 3)) t(unit, suggestion, rank) WHERE rank <= 2""")
def suggest_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = spark.createDataFrame([("MEGAWATT",)], "unit string")
    return bulk.suggest_units(texts, "unit", default_registry(), top=2).select("unit", "suggestion", "rank")


@query("SELECT event_id, value * CASE event_type WHEN 'click' THEN 1000.0 WHEN 'error' THEN 1.0 WHEN 'view' THEN 1000000.0 END AS watts FROM events")
def convert_by_unit_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.create_map(*[F.lit(x) for x in ("click", "kW", "error", "W", "view", "MW", "purchase", "degC", "signup", "m")])[F.col("event_type")]
    df = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("unit", unit)
    return bulk.convert_by_unit_column(df, "value", "unit", "W", default_registry(), "watts").select("event_id", "watts")


def _data_file() -> dict:
    return tomllib.loads(registry_text())


def _dimensions_sql() -> str:
    """Every dimension of the data file, from the file alone."""
    order = "length mass time current temperature amount luminosity count currency angle".split()
    texts = {name: "·".join(n if e == 1 else f"{n}^{e}" for n, e in sorted(d["vector"].items(), key=lambda x: order.index(x[0]))) or "dimensionless" for name, d in _data_file()["dimension"].items()}
    return f"SELECT * FROM (VALUES {', '.join(f"('{n}', '{t}')" for n, t in texts.items())}) t(name, text)"


def _units_sql() -> str:
    """Every authored unit of the data file with its ratio in lowest terms, from the file alone."""
    rows = []
    for symbol, unit in _data_file()["unit"].items():
        ratio = Fraction(*unit["factor"])
        rows.append(f"('{symbol}', '{ratio.numerator}', '{ratio.denominator}', {unit.get('pi', 0)})")
    return f"SELECT * FROM (VALUES {', '.join(rows)}) t(symbol, numerator, denominator, pi)"


@query(_dimensions_sql())
def registry_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dimension that the registry defines."""
    return default_registry().dimensions_df(spark).where(~F.col("name").isin(*dims.BASES)).select("name", "text")


@query(_units_sql())
def registry_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every authored unit."""
    return default_registry().units_df(spark).where("prefixed_from is null").select("symbol", "numerator", "denominator", "pi")


@query()
def registry_units_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every unit that resolves, prefixed ones included; a test holds it against the data file."""
    return default_registry().units_df(spark).select("symbol", "numerator", "denominator", "pi", "prefixed_from")


# --- tags that leave and come back -----------------------------------------------------------


def _new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT event_id, value * 1000 AS kw FROM events")
def roundtrip_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags written with a Parquet table are those that its reader converts by."""
    where = _new_folder(spark, "parquet")
    files.write_parquet(events(spark, sf_dir, "MW").df, where)
    back = UnitFrame.of(files.read_parquet(spark, where))
    return back.select("event_id", kw=back["value"].to("kW")).df


def _sidecar(kind: str, **options: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        u = frame(spark, sf_dir, "supplier", s_acctbal="USD").select("s_suppkey", "s_acctbal")
        where = _new_folder(spark, kind)
        files.write_with_sidecar(u.df, where, kind, **options)
        back = UnitFrame.of(files.read_with_sidecar(spark, where, kind, "s_suppkey long, s_acctbal double", **options))
        return back.select("s_suppkey", cents=back["s_acctbal"].to("cent_us")).df

    run.__name__ = f"roundtrip_{kind}"
    query("SELECT s_suppkey, s_acctbal * 100 AS cents FROM supplier")(run)


_sidecar("csv", header="true")
_sidecar("json")
_sidecar("orc")


@query("SELECT s_suppkey, s_acctbal * 100 AS cents FROM supplier")
def roundtrip_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through an Arrow table, which the driver holds: for tables of that size."""
    back = UnitFrame.of(files.from_arrow(spark, files.to_arrow(frame(spark, sf_dir, "supplier", s_acctbal="USD").df)))
    return back.select("s_suppkey", cents=back["s_acctbal"].to("cent_us")).df


@query("SELECT event_id, value * 1000 AS kw FROM events WHERE event_type = 'click'")
def retag_lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags that an engine dropped are put back by the source's schema."""
    source = events(spark, sf_dir, "MW").df
    bare = source.select(*[F.col(c).alias(c, metadata={}) for c in source.columns]).where("event_type = 'click'")
    again, _ = tagging.retag(bare, source)
    u = UnitFrame.of(again)
    return u.select("event_id", kw=u["value"].to("kW")).df


@query("""SELECT * FROM (VALUES ('l_quantity', 'lb', NULL, NULL), ('value', 'MW', 'core:power', 'PT1H'), ('energy', 'MW*h', 'core:energy', 'PT1H')) t(name, unit, quantity, period)""")
def stored_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stored tags of three columns say, read back from their schemas."""
    u = hourly_power(spark, sf_dir)
    found = {**tagging.metadata_of(u.select("value", energy=u["value"].integrate()).df), **{"l_quantity": tagging.metadata_of(lines(spark, sf_dir).df)["l_quantity"]}}
    return spark.createDataFrame([(n, m.unit, m.quantity, m.temporal.period if m.temporal else None) for n, m in found.items()], "name string, unit string, quantity string, period string")


# --- registries that meet, and modes -----------------------------------------------------------

_HEAD = '[registry]\nschema_version = 1\nname = "{}"\nversion = "1"\n[dimension]\nvolume = {{ vector = {{ length = 3 }} }}\n[unit]\nm = {{ dimension = "length", factor = [1, 1] }}\n'
_OIL = _HEAD.format("oil") + 'bbl = { dimension = "volume", factor = [9938205933, 62500000000] }\nkeg = { dimension = "volume", factor = [1, 17] }\n'
_WATER = _HEAD.format("water") + 'bbl = { dimension = "volume", factor = [29810117799, 250000000000] }\nkeg = { dimension = "length", factor = [1, 2] }\npail = { dimension = "volume", factor = [1, 100] }\n'


@query("""SELECT * FROM (VALUES ('m', 'compatible', NULL), ('bbl', 'incompatible', 'factor'), ('keg', 'incompatible', 'dimension'), ('pail', 'incompatible', 'unknown here'), ('(same)', 'same_pin', NULL), ('(absent)', 'unverifiable', NULL)) t(symbol, verdict, difference)""")
def boundary_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one registry makes of the symbols of another."""
    here, there = Registry(_OIL), Registry(_WATER)
    found = [(s, check_boundary(here, there, [s])) for s in ("m", "bbl", "keg", "pail")] + [("(same)", check_boundary(here, here, ["m"])), ("(absent)", check_boundary(here, None, ["m"], there_pin="sha256:0"))]
    return spark.createDataFrame([(s, v.kind, v.conflicts[0].kind if v.conflicts else None) for s, v in found], "symbol string, verdict string, difference string")


@query("""SELECT * FROM (VALUES ('bbl contested', 'unit'), ('keg contested', 'unit'), ('no ruling', 'E_REGISTRY_INVALID'), ('two rulings', '29810117799/250000000000'), ('idle ruling', 'E_REGISTRY_INVALID'), ('pin verified', 'true'), ('sources', 'oil,water')) t(what, outcome)""")
def composed_registries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources composed: what they contest, what rulings settle, and the pin of the result."""
    sources = [compose.Source("oil", "1", _OIL), compose.Source("water", "1", _WATER)]
    rulings = [compose.Ruling("bbl", "water", "no oil is sold"), compose.Ruling("keg", "oil", "a keg holds beer")]

    def tried(*more: compose.Ruling) -> str:
        try:
            unit = compose.compose("both", "1", sources, more).registry.resolve("bbl")
            return f"{unit.factor.ratio.numerator}/{unit.factor.ratio.denominator}"
        except UnitError as e:
            return e.code

    both = compose.compose("both", "1", sources, rulings)
    rows = [(f"{c.symbol} contested", c.section) for c in compose.contested(sources)]
    rows += [("no ruling", tried()), ("two rulings", tried(*rulings)), ("idle ruling", tried(*rulings, compose.Ruling("m", "oil", "why not")))]
    rows += [("pin verified", str(compose.verify_pin(both.toml, both.pin)).lower()), ("sources", ",".join(n for n, _, _ in both.inputs))]
    return spark.createDataFrame(rows, "what string, outcome string")


@query("""SELECT * FROM (VALUES ('strict', 'add untagged', 'E_UNIT_MISMATCH'), ('permissive', 'add untagged', 'untagged'), ('untracked', 'add untagged', 'untagged'), ('strict', 'add MW and deg', 'E_DIM_MISMATCH'), ('permissive', 'add MW and deg', 'E_DIM_MISMATCH'),
('strict', 'add MW and kW', 'MW'), ('permissive', 'add MW and kW', 'MW'), ('permissive', 'sum of a rate', 'E_KIND_UNSUMMABLE'), ('permissive', 'unknown symbol', 'E_UNKNOWN_UNIT'), ('permissive', 'degC times h', 'E_AFFINE_COMPOUND'), ('permissive', 'concat MW and deg', 'E_DIM_MISMATCH')) t(mode, operation, outcome)""")
def modes_and_taint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each mode refuses, converts or lets go without a unit; nothing of it runs a job."""
    path = f"{sf_dir.rstrip('/')}/lineitem.parquet"

    def tried(mode: str, operation: str) -> tuple[str, str, str]:
        u = UnitFrame.of(spark.read.parquet(path), mode=mode).tag({"l_quantity": "MW", "l_discount": "kW", "l_tax": "deg"})
        try:
            match operation:
                case "add untagged":
                    made = u["l_quantity"] + u["l_extendedprice"]
                case "add MW and deg":
                    made = u["l_quantity"] + u["l_tax"]
                case "add MW and kW":
                    made = u["l_quantity"] + u["l_discount"]
                case "sum of a rate":
                    made = A.sum_(u.tag({"l_quantity": "MW"}, {"l_quantity": "core:power"})["l_quantity"]).result
                case "unknown symbol":
                    made = u["l_quantity"].to("Zorkmid")
                case "degC times h":
                    made = u.tag({"l_tax": "degC", "l_discount": "h"})["l_tax"] * u.tag({"l_discount": "h"})["l_discount"]
                case _:
                    made = u.union(u.tag({"l_quantity": "deg"}))["l_quantity"]
        except UnitError as e:
            return mode, operation, e.code
        return mode, operation, made.unit or "untagged"

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        rows = [tried(m, "add untagged") for m in ("strict", "permissive", "untracked")]
        rows += [tried(m, o) for o in ("add MW and deg", "add MW and kW") for m in ("strict", "permissive")]
        rows += [tried("permissive", o) for o in ("sum of a rate", "unknown symbol", "degC times h", "concat MW and deg")]
    return spark.createDataFrame(rows, "mode string, operation string, outcome string")


@query("""SELECT * FROM (VALUES ('join', 'permissive', 'oil,water'), ('union', 'permissive', 'oil,water'), ('alone', 'strict', '')) t(operation, mode, sources)""")
def provenance_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where units come from, told by the tags of what two tables made."""

    def told(toml: str, mode: str, df: DataFrame) -> UnitFrame:
        registry = Registry(toml)
        u = UnitFrame.of(df, registry, mode).tag({"x": "m"})
        composed = compose.compose(registry.name + "-own", "1", [compose.Source(registry.name, "1", toml)])
        return replace(u, raw=provenance.with_provenance(u.df, provenance.provenance(composed, mode)), pending={})

    rows = spark.read.parquet(f"{sf_dir.rstrip('/')}/nation.parquet")
    left = told(_OIL, "strict", rows.select("n_nationkey", F.col("n_regionkey").cast("double").alias("x")))
    right = told(_WATER, "permissive", rows.select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").cast("double").alias("x")))
    made = {"alone": left, "join": left.join(right.rename({"x": "y"}), [("n_nationkey", "k")]), "union": left.union(right.rename({"k": "n_nationkey"}))}
    told_of = lambda u: json.loads(provenance.provenance_of(u.df))
    names = lambda t: ",".join(x["name"] for x in t["composed_from"] if not x["name"].endswith("-own"))
    return spark.createDataFrame([(k, told_of(u)["mode"], names(told_of(u)) if k != "alone" else "") for k, u in made.items()], "operation string, mode string, sources string")


# --- streams -------------------------------------------------------------------------------


def _streamed(spark: SparkSession, sf_dir: str, windowed: Callable[[UnitFrame], DataFrame], mode: str = "append") -> DataFrame:
    """The result of a query over the events as a stream of files, read to its end.

    The query writes Parquet under the shared checkpoint folder: nothing stays on one machine.
    """
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    stream = windows.read_stream(spark, f"{sf_dir}/events*.parquet", schema)
    u = UnitFrame.of(stream).tag_temporal("value", "MW", "interval", "mean", "PT1H")
    made = windowed(windows.with_event_time(u, "ts", "1 hour"))
    writer = made.writeStream.option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", f"{folder}/out")
    else:
        writer = writer.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={n}"))  # a replayed batch takes its own place again
    writer.start().awaitTermination()
    out = spark.read.schema(made.schema).parquet(f"{folder}/out")
    return out.select(*made.columns)


_CLOSED = "(SELECT max(ts) FROM events) - INTERVAL 1 HOUR"


@query(f"SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, max(value) AS most, count(*) AS n FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= {_CLOSED} GROUP BY ALL")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    def windowed(u: UnitFrame) -> DataFrame:
        made = windows.tumbling(u, "ts", "1 day", "event_type").agg(most=A.max_(u["value"]), n=A.count())
        return made.df.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "most", "n")

    return _streamed(spark, sf_dir, windowed)


@query(f"""WITH w AS (SELECT event_type, value, time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 12 HOUR AS b FROM events, (VALUES (0), (1)) t(k))
SELECT strftime(b, '%Y-%m-%d %H') AS begins, event_type, max(value) AS most FROM w WHERE b + INTERVAL 1 DAY <= {_CLOSED} GROUP BY ALL""")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    def windowed(u: UnitFrame) -> DataFrame:
        made = windows.sliding(u, "ts", "1 day", "12 hours", "event_type").agg(most=A.max_(u["value"]))
        return made.df.select(F.date_format("window.start", "yyyy-MM-dd HH").alias("begins"), "event_type", "most")

    return _streamed(spark, sf_dir, windowed)


@query(f"""WITH o AS (SELECT event_type, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT event_type, ts, sum(fresh) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS begins, event_type, count(*) AS n FROM s GROUP BY event_type, k HAVING max(ts) + INTERVAL 1 HOUR <= {_CLOSED}""")
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    def windowed(u: UnitFrame) -> DataFrame:
        made = windows.session(u, "ts", "1 hour", "event_type").agg(n=A.count(u["value"]))
        return made.df.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("begins"), "event_type", "n")

    return _streamed(spark, sf_dir, windowed)


@query("SELECT event_type, max(value) * 1000 AS most_kw, count(*) AS n FROM events GROUP BY event_type")
def stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest power seen so far of each type, kept as state of our own."""
    import pandas as pd

    def greatest(key: tuple, parts, state):
        most, n = state.get if state.exists else (float("-inf"), 0)
        for part in parts:
            most, n = max(most, float(part["value"].max())), n + len(part)
        state.update((most, n))
        yield pd.DataFrame({"event_type": [key[0]], "most_kw": [most], "n": [n]})

    def windowed(u: UnitFrame) -> DataFrame:
        made = apply_with_state(u, ["event_type"], greatest, "event_type string, most_kw double, n long", {"most_kw": "MW"}, "most double, n long")
        return made.convert({"most_kw": "kW"}).df

    return _streamed(spark, sf_dir, windowed, "update").groupBy("event_type").agg(F.max("most_kw").alias("most_kw"), F.max("n").alias("n"))


@query("SELECT event_type, max(value) * 1000 AS most_kw, count(*) AS n FROM events GROUP BY event_type")
def stream_processor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a processor with two states of its own."""
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    class Greatest(StatefulProcessor):
        def init(self, handle):
            self.most, self.n = handle.getValueState("most", "value double"), handle.getValueState("n", "value long")

        def handleInputRows(self, key, rows, timers):
            most, n = (self.most.get()[0], self.n.get()[0]) if self.most.exists() else (float("-inf"), 0)
            for part in rows:
                most, n = max(most, float(part["value"].max())), n + len(part)
            self.most.update((most,))
            self.n.update((n,))
            yield pd.DataFrame({"event_type": [key[0]], "most_kw": [most], "n": [n]})

        def close(self):
            pass

    def windowed(u: UnitFrame) -> DataFrame:
        made = transform_with_state(u, ["event_type"], Greatest(), "event_type string, most_kw double, n long", {"most_kw": "MW"})
        return made.convert({"most_kw": "kW"}).df

    return _streamed(spark, sf_dir, windowed, "update").groupBy("event_type").agg(F.max("most_kw").alias("most_kw"), F.max("n").alias("n"))


@query("SELECT event_id, event_type, value FROM events JOIN (SELECT DISTINCT event_type FROM events WHERE value > 300) USING (event_type)")
def stream_static_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    def windowed(u: UnitFrame) -> DataFrame:
        static = events(spark, sf_dir, "MW").filter(F.col("value") > 300).select("event_type").distinct()
        return u.join(static, "event_type").df.select("event_id", "event_type", "value")

    return _streamed(spark, sf_dir, windowed)


@query("""SELECT c.event_id AS click_id, p.event_id AS purchase_id, p.value * 1000 AS kw FROM events c JOIN events p ON c.user_id = p.user_id AND p.ts >= c.ts AND p.ts <= c.ts + INTERVAL 6 HOUR WHERE c.event_type = 'click' AND p.event_type = 'purchase'""")
def stream_stream_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases in the six hours after a click of the same user: both sides are streams, bounded by their watermarks."""

    def windowed(u: UnitFrame) -> DataFrame:
        side = lambda kind, p: u.filter(F.col("event_type") == kind).rename({"event_id": f"{p}_id", "user_id": f"{p}_user", "ts": f"{p}_ts", "value": f"{p}_value"}).select(f"{p}_id", f"{p}_user", f"{p}_ts", f"{p}_value")
        made = side("click", "click").join_where(side("purchase", "purchase"), lambda a, b: F.expr("purchase_ts >= click_ts AND purchase_ts <= click_ts + INTERVAL 6 HOURS"), [("click_user", "purchase_user")])
        return made.select("click_id", "purchase_id", kw=made["purchase_value"].to("kW")).df

    return _streamed(spark, sf_dir, windowed)


@query("SELECT event_id, value * 1000 AS kw FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream in which each event comes twice, each passed on once."""

    def windowed(u: UnitFrame) -> DataFrame:
        once = windows.dedup_within_watermark(u.union(u), "event_id")
        return once.select("event_id", kw=once["value"].to("kW")).df

    return _streamed(spark, sf_dir, windowed)


@query("""WITH t AS (SELECT max(ts) AS most FROM events), recent AS (SELECT * FROM events, t WHERE ts >= most - INTERVAL 3 DAY)
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM recent WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= most - INTERVAL 1 HOUR GROUP BY ALL""")
def stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last days come first, then all that is older: later than the watermark allows, so left out.

    A watermark judges late rows from the second batch on after the one that set it; an empty file between makes that batch.
    """
    folder = _new_folder(spark, "late")
    rows = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")
    edge = rows.agg(F.max("ts") - F.expr("INTERVAL 3 DAYS")).first()[0]
    rows.where(F.col("ts") >= F.lit(edge)).coalesce(1).write.parquet(f"{folder}/in/1")
    rows.limit(0).coalesce(1).write.parquet(f"{folder}/in/2")
    rows.where(F.col("ts") < F.lit(edge)).coalesce(1).write.parquet(f"{folder}/in/3")
    stream = windows.read_stream(spark, f"{folder}/in/*", rows.schema, maxFilesPerTrigger="1")
    u = windows.with_event_time(UnitFrame.of(stream).tag({"value": "MW"}), "ts", "1 hour")
    made = windows.tumbling(u, "ts", "1 day", "event_type").agg(n=A.count()).df.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")
    made.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).format("parquet").option("path", f"{folder}/out").start().awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{folder}/out")


from dimspark.plans import answers  # noqa: E402, F401 - registers its queries here
