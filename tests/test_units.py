"""The unit language, registries, composition, boundaries and metadata: no session needed."""

import json
import random
from fractions import Fraction

import pytest

from dimspark.errors import UnitError
from dimspark.units import Registry, default_registry, dims
from dimspark.units.blob import Base, Metadata, Temporal, check_unit_token, period_seconds
from dimspark.units.boundary import check_boundary
from dimspark.units.compose import Ruling, Source, compose, contested, verify_pin, write_toml
from dimspark.units.exact import Scale

R = default_registry()

SPELLED = {
    "hr": "h", "MW*hr": "MW*h", "MW^1": "MW", "m^0": "1", "mW": "mW", "MWh": "MWh", "MW * h": "MW*h", "  MW  ": "MW", " 1 / s ": "s^-1",
    "h*MW": "MW*h", "m*kW*h*MW*W*Btu": "Btu*MW*W*h*kW*m", "mW*MW": "MW*mW", "mW*m": "m*mW", "s^-1*MW": "MW*s^-1", "W/m^2/K": "W*K^-1*m^-2",
    "USD/MWh": "USD*MWh^-1", "m*m": "m^2", "MW*MW*MW": "MW^3", "m^2*m^-2": "1", "s/s": "1", "m^3*m^-1": "m^2", "m^2/m^3": "m^-1", "m^3/m^2": "m",
    "MW*h*MW": "MW^2*h", "MW/h/K": "MW*K^-1*h^-1", "MW/h^2": "MW*h^-2", "W/K*m^2": "W*m^2*K^-1", "1/K/m^2": "K^-1*m^-2", "degC": "degC",
    "degC^1": "degC", "delta_degC/h": "delta_degC*h^-1", "1": "1", "pu": "pu", "MW*h/MWh": "MW*h*MWh^-1", "rad*rad^-1": "1", "kilowatts": "kW",
    "kilometers": "km", "dekametre": "dam", "celsius": "degC",
}
REFUSED = {
    "E_UNIT_SYNTAX": ["", " ", "1*MW", "MW**h", "MW^", "MW*", "(m*s)", "m s", "0.5*MW", "°C", "MW^+2", "m^1/2", "MW/s^-1", "﻿MW", "m^02", "m^-0", "*m", "1/", "1 m", "m ^2"],
    "E_UNKNOWN_UNIT": ["Zorkmid", "unknown", "MBtu", "megawat"],
    "E_AFFINE_COMPOUND": ["degC*h", "degC^2", "degC/degC", "degC*h/h", "degF*delta_degC", "pu*MW", "pu^2"],
    "E_EXP_RANGE": ["m^200", "m^100*m^100", "m^99999999999"],
}


@pytest.mark.parametrize("text,canonical", SPELLED.items())
def test_one_spelling(text, canonical):
    assert R.canonicalize(text).text == canonical
    assert R.canonicalize(canonical).text == canonical


@pytest.mark.parametrize("code,text", [(c, t) for c, ts in REFUSED.items() for t in ts])
def test_refusals(code, text):
    with pytest.raises(UnitError) as e:
        R.canonicalize(text)
    assert e.value.code == code and str(e.value).startswith(f"{code}: ")


def test_messages_say_what_to_write():
    for text, part in (("µW", "u"), ("°C", "degC"), ("Ω", "ohm"), ("m s", "*"), ("MBtu", "refused rather than guessed"), ("megawat", "megawatt")):
        with pytest.raises(UnitError, match=part.replace("*", r"\*")):
            R.canonicalize(text)
    with pytest.raises(UnitError) as e:
        R.canonicalize("m*µW")
    assert e.value.offset == 2
    with pytest.raises(UnitError, match="E_GRAMMAR_VERSION"):
        R.canonicalize("MW", grammar=2)


def test_dimensions():
    assert R.dimension("MW*h") == {"length": 2, "mass": 1, "time": -2}
    assert R.dimension("rad/s") == {"time": -1, "angle": 1} and R.dimension("Hz") == {"time": -1}
    assert dims.text(R.canonicalize("J").dimension) == "length^2·mass·time^-2" and dims.text(dims.NONE) == "dimensionless"
    assert R.commensurable("MWh", "MW*h") and not R.units_equal("MWh", "MW*h") and not R.commensurable("rad/s", "Hz")
    assert R.canonicalize("count*m*count^-1").text == "m"


def test_exact_conversions():
    c = R.conversion("MW*h", "Btu")
    assert (c.numerator, c.denominator) == (180000000000000000, 52752792631)
    c = R.conversion("degC", "degF")
    assert c.factor == Scale(Fraction(9, 5)) and c.offset == 32 and c.is_affine and c.apply(25) == 77 and c.apply_exact(20) == 68
    assert R.conversion("delta_degC", "delta_degF").apply_exact(20) == 36
    c = R.conversion("deg", "rad")
    assert c.apply(180) == pytest.approx(3.141592653589793) and not c.is_exact_rational and c.apply_exact(180) is None
    assert R.conversion("m", "m").formula() == "y = x" and "π" in R.conversion("deg", "rad").formula()
    with pytest.raises(UnitError, match="E_DIM_MISMATCH"):
        R.conversion("MW", "h")


def test_conversions_compose_and_invert():
    rng = random.Random(1)
    plain = [s for s, u in R.units.items() if not u.is_affine and u.symbol != "pu" and max(u.factor.ratio.numerator, u.factor.ratio.denominator) < 10**12]  # products of three stay within 128 bits
    by_dim = {}
    for s in plain:
        by_dim.setdefault(R.units[s].dimension, []).append(s)
    for group in (g for g in by_dim.values() if len(g) > 2):
        a, b, c = rng.sample(group, 3)
        ab, bc, ac = R.conversion(a, b), R.conversion(b, c), R.conversion(a, c)
        assert ab.factor * bc.factor == ac.factor and R.conversion(b, a).factor * ab.factor == Scale()


def test_product_is_commutative_and_idempotent():
    rng = random.Random(2)
    symbols = [s for s, u in R.units.items() if not u.stands_alone and max(u.factor.ratio.numerator, u.factor.ratio.denominator) < 10**6]
    for _ in range(100):
        a, b = rng.sample(symbols, 2)
        n = rng.choice([-2, -1, 1, 2])
        assert R.canonicalize(f"{a}*{b}^{n}").text == R.canonicalize(f"{b}^{n}*{a}").text == R.canonicalize(R.canonicalize(f"{a}*{b}^{n}").text).text


HEAD = '[registry]\nschema_version = 1\nname = "test"\nversion = "1"\n'
UNIT = '[unit.{}]\ndimension = "length"\nfactor = [1, 1]\n'


@pytest.mark.parametrize("toml,says", [
    ("", "registry"), ('[registry]\nschema_version = 1\nname = "T"\nversion = "1"\n', "small letters"), (HEAD.replace("= 1", "= 2"), "schema_version"),
    (HEAD + '[unit.x]\ndimension = "nothing"\nfactor = [1, 1]\n', "no dimension"), (HEAD + '[unit.x]\ndimension = "length"\nfactor = [2, 4]\n', "lowest"),
    (HEAD + '[unit.x]\ndimension = "length"\nfactor = 1.5\n', "exact"), (HEAD + UNIT.format("x") + "colour = 1\n", "unknown keys"), (HEAD + UNIT.format("x") + "pi = 9\n", "-8 to 8"),
    (HEAD + UNIT.format("x") + 'aliases = ["y"]\n' + UNIT.format("z") + 'aliases = ["y"]\n', "claimed"), (HEAD + UNIT.format("x") + 'aliases = ["z"]\n' + UNIT.format("z"), "own symbol"),
    (HEAD + UNIT.format("t") + 'prefixes = "si"\n' + UNIT.format("ft"), "is ambiguous"), (HEAD + UNIT.format("x") + 'prefixes = "all"\n', "prefix set"),
    (HEAD + UNIT.format("x") + 'offset = [1, 1]\nprefixes = "si"\n', "affine"), (HEAD + UNIT.format("x") + 'delta = "y"\n', "delta"),
    (HEAD + '[dimension.length]\nvector = { mass = 1 }\n', "base dimension"), (HEAD + '[dimension.x]\nvector = { colour = 1 }\n', "ten base"),
    (HEAD + '[registry.prefix_collisions]\nft = "none"\n', "doesn't collide"), (HEAD + '[registry.ambiguous.x]\nreason = "two"\n' + UNIT.format("x"), "refused and defined"),
    (HEAD + '[quantity."a:b"]\nparent = "a:c"\n', "not defined"), (HEAD + '[quantity."a:b"]\nparent = "a:b"\n', "circle"),
])
def test_registries_that_do_not_load(toml, says):
    with pytest.raises(UnitError, match=says) as e:
        Registry(toml)
    assert e.value.code == "E_REGISTRY_INVALID"


def test_prefix_collision_ruling():
    r = Registry(HEAD.replace('version = "1"\n', 'version = "1"\n[registry.prefix_collisions]\nft = "the foot wins"\n') + UNIT.format("t") + 'prefixes = "si"\n' + UNIT.format("ft"))
    assert r.resolve("ft").prefixed_from is None and r.resolve("kt").prefixed_from == "t"
    assert r.would_collide("mt").base == "t" and [x.symbol for x in r.collision_risks()] == ["ft"]
    assert r.unit_count == 2 + 24 and r.authored_count == 2


def test_lookups():
    assert R.describe("MW") == "megawatt" and R.canonical_symbol("hr") == "h" and R.by_display("°C") == "degC"
    assert R.delta_of("degC") == "delta_degC" and R.delta_of("m") == "m" and R.resolve("nothing") is None
    assert R.suggest("Megawatt")[0] == "megawatt" and len(R.suggest("meter")) <= 4
    assert sum(n for _, n in R.systems()) == R.authored_count and R.units_without_a_stated_system() == []


#: Sources whose composition has a known hash.
OIL = '[registry]\nschema_version = 1\nname = "oil"\nversion = "1.4"\n[unit.m]\ndimension = "length"\nfactor = [1, 1]\ndisplay = { long = "metre" }\n[unit.bbl]\ndimension = "length"\nfactor = [9938205933, 62500000000]\ndisplay = { long = "oil barrel" }\n'
WATER = '[registry]\nschema_version = 1\nname = "water"\nversion = "2.1"\n[unit.m]\ndimension = "length"\nfactor = [1, 1]\ndisplay = { long = "metre" }\n[unit.bbl]\ndimension = "length"\nfactor = [29810117799, 250000000000]\ndisplay = { long = "water barrel" }\n[unit.acre_ft]\ndimension = "length"\nfactor = [616740919, 500000]\n'
PIN = "sha256:2b5b595e1554450d593262cf671f2694f5f635a4ab17a3fb82743692ab13974a"
RULING = Ruling("bbl", "oil", "this deployment is upstream oil production")


def sources():
    return [Source("oil", "1.4", OIL), Source("water", "2.1", WATER)]


def test_composition_is_pinned():
    one = compose("merged", "1", sources(), [RULING])
    other = compose("merged", "1", sources()[::-1], [RULING])
    assert one.pin == other.pin == PIN and verify_pin(one.toml, PIN) and not verify_pin(one.toml + " ", PIN)
    assert one.agreed == ("m",) and [r.symbol for r in one.applied] == ["bbl"] and one.registry.describe("bbl") == "oil barrel"
    assert [c.symbol for c in contested(sources())] == ["bbl"]
    full, pin = json.loads(one.provenance_json()), json.loads(one.provenance_json(full=False))
    assert full["registry"]["source"] == one.toml and "source" not in pin["registry"] and [c["name"] for c in pin["composed_from"]] == ["oil", "water"]
    assert one.metadata_bytes() > one.metadata_bytes(full=False)


@pytest.mark.parametrize("rulings,says", [([], "oil and water"), ([Ruling("bbl", "oil", " ")], "reason"), ([Ruling("bbl", "gas", "x")], "gas"), ([RULING, Ruling("m", "oil", "x")], "settles nothing"), ([RULING, RULING], "two rulings")])
def test_rulings_that_fail(rulings, says):
    with pytest.raises(UnitError, match=says):
        compose("merged", "1", sources(), rulings)


def test_composing_nothing_or_twice():
    with pytest.raises(UnitError):
        compose("merged", "1", [])
    with pytest.raises(UnitError, match="oil"):
        compose("merged", "1", [sources()[0]] * 2)


def test_composing_files(tmp_path):
    from dimspark.units.compose import compose_paths

    for s in sources():
        (tmp_path / f"{s.name}.toml").write_text(s.toml)
    assert compose_paths("merged", "1", sorted(tmp_path.iterdir()), [RULING]).pin == PIN


def test_writer():
    assert write_toml({"b": {"x": 1, "a": {"k": "v"}}, "a": {}}) == '[a]\n\n[b]\nx = 1\n\n[b.a]\nk = "v"\n'
    assert write_toml({"t": {"odd key": [1, "q\"uote"], "f": True}}) == '[t]\nf = true\n"odd key" = [1, "q\\"uote"]\n'


def test_boundary():
    here, there = Registry(OIL), Registry(WATER)
    v = check_boundary(here, there, ["bbl", "m"])
    assert v.strict_code == "E_UNIT_MISMATCH" and "33.4%" in v.message() and not v.is_safe
    assert check_boundary(here, there, ["m"]).kind == "compatible" and check_boundary(here, here, ["bbl"]).kind == "same_pin"
    assert check_boundary(here, there, ["acre_ft"]).strict_code == "E_UNKNOWN_UNIT"
    v = check_boundary(here, None, ["m"], there_pin="sha256:other")
    assert v.strict_code == "E_REGISTRY_INVALID" and "not available here" in v.message() and "embedded" in v.message()


def test_metadata():
    assert Metadata("MW").to_json() == '{"unit":"MW","grammar":1}'
    full = '{"unit":"pu","grammar":1,"quantity":"core:power","base":{"quantity":"core:power","value":100,"unit":"MVA"},"temporal":{"kind":"interval","statistic":"mean","period":"PT1H"},"a":{"b":[1,"x"]},"vendor":"keep"}'
    assert Metadata.from_json(full).to_json() == full
    assert Metadata.from_json(full).base == Base("core:power", 100, "MVA") and Metadata.from_json(full).temporal == Temporal("interval", "mean", "PT1H")
    for text in ("[]", "{}", '{"unit":"MW"}', '{"unit":1,"grammar":1}', '{"unit":"\\u004dW","grammar":1}', '{"unit":"MW","grammar":0}', '{"unit":"MW","grammar":true}', "not json", '{"unit":"pu","grammar":1,"base":{"value":1,"unit":"M\\\\W"}}'):
        with pytest.raises(UnitError, match="E_BAD_METADATA"):
            Metadata.from_json(text)
    with pytest.raises(UnitError, match="E_GRAMMAR_VERSION"):
        Metadata.from_json('{"unit":"MW","grammar":99}')
    assert check_unit_token('"MW"') == "MW"
    for token in ('"MW\\/h"', '"\\ud800"', "MW"):
        with pytest.raises(UnitError):
            check_unit_token(token)


def test_periods():
    assert period_seconds("PT1H") == 3600 and period_seconds("P1DT30M") == 88200 and period_seconds("PT15M") == 900
    for period in ("P1M", "P1Y", "P", "1H"):
        with pytest.raises(UnitError, match="E_TEMPORAL_MISMATCH"):
            period_seconds(period)


def test_command_line(capsys):
    from dimspark.__main__ import main

    assert main(["canonicalize", "MW*hr"]) == 0 and capsys.readouterr().out == "MW*h\n"
    assert main(["convert", "degC", "degF", "25"]) == 0 and capsys.readouterr().out == "77.0\n"
    assert main(["dimension", "Zorkmid"]) == 1 and "E_UNKNOWN_UNIT" in capsys.readouterr().err


def test_great_factors_survive():
    r = Registry(HEAD + '[unit.huge]\ndimension = "length"\nfactor = [170141183460469231729, 7]\n' + UNIT.format("m"))
    c = r.conversion("huge", "m")
    assert (c.numerator, c.denominator) == (170141183460469231729, 7)
    with pytest.raises(UnitError, match="E_EXP_RANGE"):
        r.canonicalize("huge^9")


@pytest.mark.parametrize("text,target,factor", [
    ("US_liquid_gallon", "L", "473176473/125000000"), ("refrigeration_ton", "Btu/h", "12000"), ("troy_ounce", "g", "31.1034768"),
    ("Julian_year", "d", "365.25"), ("slug", "lbf*s^2/ft", "1"), ("ksi", "psi", "1000"), ("metric_horsepower", "W", "735.49875"), ("poundal", "lbf", "3048/98066.5"), ("UK_fluid_ounce", "mL", "28.4130625"), ("octet", "bit", "8"), ("board_foot", "inch^3", "144"),
])
def test_customary_units(text, target, factor):
    """Public definitions, exactly."""
    top, _, below = factor.partition("/")
    assert default_registry().conversion(text, target).factor.ratio == Fraction(top) / Fraction(below or "1")
