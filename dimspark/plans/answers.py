"""Queries over small tables of questions: what the unit language, registries, plans, tags and seals answer.

Each is a table of cases and answers, stated in its SQL; none reads more than a table's schema or a small table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dimspark.errors import UnitError
from dimspark.functions import bulk
from dimspark.functions.expr import check_interval
from dimspark.operators import aggregates as A
from dimspark.operators.frame import UnitFrame
from dimspark.operators.plan import Plan
from dimspark.plans.catalogue import frame, query
from dimspark.sources import tagging
from dimspark.trust import seals
from dimspark.trust.closure import Node, closure_level
from dimspark.units import Registry, default_registry
from dimspark.units.blob import Base, Metadata, Temporal

_PARSED = {
    "hr": "h", "MW*hr": "MW*h", "MW^1": "MW", "m^0": "1", "mW": "mW", "MWh": "MWh", "MW * h": "MW*h", "  MW  ": "MW", " 1 / s": "s^-1", "h*MW": "MW*h",
    "mW*MW": "MW*mW", "s^-1*MW": "MW*s^-1", "W/m^2/K": "W*K^-1*m^-2", "USD/MWh": "USD*MWh^-1", "m*m": "m^2", "m^2*m^-2": "1", "s/s": "1", "m^3*m^-1": "m^2",
    "MW*h*MW": "MW^2*h", "MW/h/K": "MW*K^-1*h^-1", "W/K*m^2": "W*m^2*K^-1", "1/K/m^2": "K^-1*m^-2", "degC": "degC", "delta_degC/h": "delta_degC*h^-1", "1": "1", "pu": "pu", "rad*rad^-1": "1",
    "MW/s^-1": "E_UNIT_SYNTAX", "degC*h": "E_AFFINE_COMPOUND", "degC^2": "E_AFFINE_COMPOUND", "pu*MW": "E_AFFINE_COMPOUND", "": "E_UNIT_SYNTAX", "1*MW": "E_UNIT_SYNTAX", "Zorkmid": "E_UNKNOWN_UNIT",
    "MW**h": "E_UNIT_SYNTAX", "MW^": "E_UNIT_SYNTAX", "(m*s)": "E_UNIT_SYNTAX", "m s": "E_UNIT_SYNTAX", "0.5*MW": "E_UNIT_SYNTAX", "MW^+2": "E_UNIT_SYNTAX", "m^1/2": "E_UNIT_SYNTAX", "m^200": "E_EXP_RANGE", "m^100*m^100": "E_EXP_RANGE",
}


def _values(rows, columns: str) -> str:
    def text(v) -> str:
        return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) t({columns})"


@query(_values(_PARSED.items(), "unit, answer"))
def unit_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings and the one spelling of each, or the code of the refusal."""
    texts = spark.createDataFrame([(t,) for t in _PARSED], "unit string")
    return bulk.unit_info(texts, "unit", default_registry()).selectExpr("unit", "coalesce(canonical, code) as answer")


_PAIRS = [("MW*h", "h*MW", True, True), ("MWh", "MW*h", False, True), ("mW", "MW", False, True), ("rad/s", "Hz", False, False), ("W/m^2/K", "W*K^-1*m^-2", True, True), ("1", "MW/MW", True, True), ("m*m/m", "m", True, True), ("lbf", "kg*m/s^2", False, True)]


@query(_values(_PAIRS, "a, b, equal, commensurable"))
def unit_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = default_registry()
    return spark.createDataFrame([(a, b, r.units_equal(a, b), r.commensurable(a, b)) for a, b, _, _ in _PAIRS], "a string, b string, equal boolean, commensurable boolean")


@query(_values([("describe", "kW", "kilowatt"), ("describe", "Zorkmid", None), ("symbol", "hr", "h"), ("symbol", "kilowatts", "kW"), ("display", "°C", "degC"), ("delta", "degC", "delta_degC"), ("delta", "K", "K"), ("delta", "MW", "MW"), ("dimension", "N*m", "length^2·mass·time^-2"), ("formula exact", "ft to m", "381/1250"), ("formula exact", "degF to K", "5/9")], "what, asked, answer"))
def registry_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = default_registry()
    from dimspark.units import dims

    rows = [("describe", "kW", r.describe("kW")), ("describe", "Zorkmid", r.describe("Zorkmid")), ("symbol", "hr", r.canonical_symbol("hr")), ("symbol", "kilowatts", r.canonicalize("kilowatts").text), ("display", "°C", r.by_display("°C"))]
    rows += [("delta", s, r.delta_of(s)) for s in ("degC", "K", "MW")] + [("dimension", "N*m", dims.text(r.canonicalize("N*m").dimension))]
    rows += [("formula exact", f"{a} to {b}", f"{c.numerator}/{c.denominator}") for a, b in (("ft", "m"), ("degF", "K")) for c in [r.conversion(a, b)]]
    return spark.createDataFrame(rows, "what string, asked string, answer string")


_COLUMNS = {"p_mw": "MW", "small": "kW", "hours": "h", "t_c": "degC", "theta_deg": "deg", "q": "Btu"}
_TEXTS = [
    ("MW to kW", "(p_mw * 1000)", "kW"), ("Btu to J", "(q * 52752792631 / 50000000)", "J"), ("deg to rad", "(theta_deg * pi() / 180)", "rad"), ("degC to K", "(t_c + 5463.0 / 20)", "K"),
    ("MW times h", "(p_mw * hours)", "MW*h"), ("MW plus kW", "(p_mw + (small / 1000))", "MW"), ("MW times h to kWh", "((p_mw * hours) * 1000)", "kWh"), ("MW plus deg", "E_DIM_MISMATCH", None),
]


@query(_values(_TEXTS, "expression, text, unit"))
def emitted_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL that typed expressions stand for, without a session."""
    import warnings

    p = Plan(default_registry(), _COLUMNS)
    made = {"MW to kW": lambda: p["p_mw"].to("kW"), "Btu to J": lambda: p["q"].to("J"), "deg to rad": lambda: p["theta_deg"].to("rad"), "degC to K": lambda: p["t_c"].to("K"), "MW times h": lambda: p["p_mw"] * p["hours"], "MW plus kW": lambda: p["p_mw"] + p["small"], "MW times h to kWh": lambda: (p["p_mw"] * p["hours"]).to("kWh"), "MW plus deg": lambda: p["p_mw"] + p["theta_deg"]}
    rows = []
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for name, make in made.items():
            try:
                e = make()
                rows.append((name, e.text(), e.unit))
            except UnitError as refused:
                rows.append((name, refused.code, None))
    return spark.createDataFrame(rows, "expression string, text string, unit string")


_REGISTRY = '[registry]\nschema_version = 1\nname = "r"\nversion = "1"\n{}[unit.m]\ndimension = "length"\nfactor = [1, 1]\n{}'
_REGISTRIES = {
    "sound": ("", ""), "no lowest terms": ("", '[unit.x]\ndimension = "length"\nfactor = [2, 4]\n'), "no such dimension": ("", '[unit.x]\ndimension = "colour"\nfactor = [1, 1]\n'), "zero factor": ("", '[unit.x]\ndimension = "length"\nfactor = [0, 1]\n'),
    "alias taken": ("", '[unit.x]\ndimension = "length"\nfactor = [1, 2]\naliases = ["m"]\n'), "unknown key": ("", '[unit.x]\ndimension = "length"\nfactor = [1, 2]\ncolour = "red"\n'), "offset without delta": ("", '[unit.x]\ndimension = "temperature"\nfactor = [1, 1]\noffset = [5463, 20]\ndelta = "nowhere"\n'),
    "prefix collision": ("", '[unit.g]\ndimension = "mass"\nfactor = [1, 1000]\nprefixes = "si"\n[unit.kg]\ndimension = "mass"\nfactor = [2, 1]\n'), "refused symbol": ('[registry.ambiguous.MBtu]\nreason = "two readings"\n', '[unit.MBtu]\ndimension = "energy"\nfactor = [1, 1]\n'),
    "kind of nothing": ("", '[quantity]\n"r:x" = { rate_of = "r:nowhere" }\n'), "not TOML": ("", "[unit\n"),
}


@query(_values([(name, "loads" if name == "sound" else "E_REGISTRY_INVALID") for name in _REGISTRIES], "registry, outcome"))
def registry_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registries with one fault each: all are refused as they load."""

    def tried(head: str, tail: str) -> str:
        try:
            Registry(_REGISTRY.format(head, tail))
            return "loads"
        except UnitError as e:
            return e.code

    return spark.createDataFrame([(name, tried(*parts)) for name, parts in _REGISTRIES.items()], "registry string, outcome string")


_BLOBS = [
    ('{"unit":"MW","grammar":1}', "MW"), ('{"unit":"MW","grammar":1,"vendor":{"a":[1]}}', "MW"), ('{"grammar":1}', "E_BAD_METADATA"), ('{"unit":"MW"}', "E_BAD_METADATA"), ("[]", "E_BAD_METADATA"), ('{"unit":5,"grammar":1}', "E_BAD_METADATA"),
    ('{"unit":"MW","grammar":99}', "E_GRAMMAR_VERSION"), ('{"unit":"\\u004dW","grammar":1}', "E_BAD_METADATA"), ('{"unit":"MW\\/h","grammar":1}', "E_BAD_METADATA"), ("no json", "E_BAD_METADATA"),
]


@query(_values(_BLOBS, "blob, outcome"))
def stored_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read from stored tags, or why not; what is read is written back as it was."""

    def tried(text: str) -> str:
        try:
            meta = Metadata.from_json(text)
            return meta.unit if Metadata.from_json(meta.to_json()) == meta else "changed"
        except UnitError as e:
            return e.code

    return spark.createDataFrame([(b, tried(b)) for b, _ in _BLOBS], "blob string, outcome string")


_TIMES = [
    ("integrate a mean over hours", "MW*h"), ("integrate an instant", "E_TEMPORAL_MISMATCH"), ("sum instants of a rate", "E_TEMPORAL_MISMATCH"), ("differentiate a mean", "E_TEMPORAL_MISMATCH"), ("differentiate a sum", "MWh*h^-1"),
    ("a difference in degC", "E_INTERVAL_MISUSE"), ("a difference in delta_degC", "fits"), ("a temperature in delta_degC", "E_INTERVAL_MISUSE"), ("pu in its base", "MVA"), ("pu without a base", "E_BASE_MISSING"),
]


@query(_values(_TIMES, "question, answer"))
def kinds_and_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of time, of kinds of quantities and of per-unit bases."""
    r = default_registry()
    power, energy = (lambda t: Metadata("MW", quantity="core:power", temporal=t)), (lambda t: Metadata("MWh", quantity="core:energy", temporal=t))
    p = Plan(r, {"mean": power(Temporal("interval", "mean", "PT1H")), "instant": power(Temporal("instant", None, None)), "total": energy(Temporal("interval", "sum", "PT1H")), "pu": Metadata("pu", base=Base("core:power", 100, "MVA")), "bare": Metadata("pu")})

    def fits(quantity: str, unit: str) -> str:
        check_interval(r, quantity, r.canonicalize(unit))
        return "fits"

    asked = {
        "integrate a mean over hours": lambda: p["mean"].integrate().unit, "integrate an instant": lambda: p["instant"].integrate().unit, "sum instants of a rate": lambda: A.sum_(p["instant"]).result.unit, "differentiate a mean": lambda: p["mean"].differentiate().unit, "differentiate a sum": lambda: p["total"].differentiate().unit,
        "a difference in degC": lambda: fits("core:temperature_delta", "degC"), "a difference in delta_degC": lambda: fits("core:temperature_delta", "delta_degC"), "a temperature in delta_degC": lambda: fits("core:temperature", "delta_degC"), "pu in its base": lambda: p["pu"].physical().unit, "pu without a base": lambda: p["bare"].physical().unit,
    }

    def tried(ask) -> str:
        try:
            return ask()
        except UnitError as e:
            return e.code

    return spark.createDataFrame([(k, tried(v)) for k, v in asked.items()], "question string, answer string")


@query(_values([("as it was", "intact"), ("in another order", "intact"), ("a value changed", "altered"), ("a unit changed", "altered"), ("no key", "unknown publisher"), ("closed", "reproducible"), ("no digest", "attested-only")], "what, state"))
def seal_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a seal of the suppliers' balances says of changed copies."""
    u = frame(spark, sf_dir, "supplier", s_acctbal="USD").select("s_suppkey", "s_acctbal")
    seal, keys = seals.seal_of(u, "us", b"key"), {"us": b"key"}
    dearer = UnitFrame.of(u.df).select("s_suppkey", s_acctbal=u["s_acctbal"] + u["s_acctbal"]).df
    copies = {"as it was": u.df, "in another order": u.df.repartition(3), "a value changed": dearer, "a unit changed": tagging.tag(u.df, {"s_acctbal": "cent_us"}, u.registry)}
    rows = [(k, seals.verify(df, seal, keys).state) for k, df in copies.items()] + [("no key", seals.verify(u.df, seal, {}).state)]
    rows += [("closed", closure_level([Node("raw", "sha256:1")], True)), ("no digest", closure_level([Node("raw", None)], True))]
    return spark.createDataFrame(rows, "what string, state string")
