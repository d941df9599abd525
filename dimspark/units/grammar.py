"""The unit-string language, grammar 1.

    unit    := "1" | "1" "/" term {op term} | term {op term}
    op      := "*" | "/"
    term    := symbol ["^" ["-"] digits]

A slash turns the sign of the next term only. Blanks may stand at the ends and around
operators. An exponent under a slash has no sign of its own.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from dimspark.errors import UnitError

GRAMMAR_VERSION = 1
_TOKEN = re.compile(r"(?P<blank>[ \t]+)|(?P<symbol>[A-Za-z][A-Za-z0-9_@]*)|(?P<power>\^(?P<digits>-?[0-9]*))|(?P<op>[*/])|(?P<one>1(?![0-9.]))")
#: What stands where a symbol should, and what to say about it.
_HINTS = (
    ("()", "parentheses have no place in a unit; division binds from left to right"),
    ("0123456789.", "numbers have no place in a unit; scaled units such as kW are units of their own"),
    ("µμ", "µ is for display only: write u (as in uW) or the whole name (microwatt)"),
    ("°", "° is for display only: write degC, degF or deg"),
    ("ΩΩ", "Ω is for display only: write ohm"),
)


@dataclass(frozen=True)
class Term:
    symbol: str
    exponent: int
    offset: int  # in bytes of UTF-8


def _refuse(text: str, at: int, message: str, code: str = "E_UNIT_SYNTAX") -> UnitError:
    return UnitError(code, message, offset=len(text[:at].encode("utf-8", "surrogatepass")))


def _hint(text: str, at: int) -> UnitError:
    if at >= len(text):
        return _refuse(text, at, "a symbol is missing at the end")
    c = text[at]
    for chars, message in _HINTS:
        if c in chars:
            return _refuse(text, at, message)
    return _refuse(text, at, "symbols are ASCII; other forms are for display" if ord(c) > 127 else "a symbol begins with an ASCII letter")


def _exponent(text: str, digits: str, at: int, inverted: bool) -> int:
    body = digits.lstrip("-")
    if not body or (len(body) > 1 and body[0] == "0") or digits == "-0":
        raise _refuse(text, at, "an exponent is a whole number without sign + or leading zeros")
    if inverted and digits.startswith("-"):
        raise _refuse(text, at, "a slash inverts already: give the exponent without its minus")
    value = -int(digits) if inverted else int(digits)
    if not -128 <= value <= 127:
        raise _refuse(text, at, "an exponent leaves the range -128 to 127", "E_EXP_RANGE")
    return value


def parse(text: str) -> tuple[Term, ...]:
    """The terms of a unit string, unmerged; none for "1"."""
    tokens, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise _hint(text, at)
        if m.lastgroup == "digits" or m["power"] is not None:
            tokens.append(("power", m["digits"], at))
        elif m["blank"] is None:
            tokens.append((m.lastgroup, m[0], at))
        elif tokens and tokens[-1][0] != "blank":
            tokens.append(("blank", m[0], at))
        at = m.end()
    tokens = [t for i, t in enumerate(tokens) if t[0] != "blank" or (0 < i < len(tokens) - 1 and tokens[i - 1][0] != "op" and tokens[i + 1][0] != "op")]
    if not tokens:
        raise _refuse(text, 0, "an empty unit; a pure number is written 1")
    terms: list[Term] = []
    k = 0
    if tokens[0][0] == "one":
        if len(tokens) == 1:
            return ()
        if tokens[1][:2] != ("op", "/"):
            raise _refuse(text, tokens[1][2], "1 stands alone or before a slash")
        k = 1
    while True:
        inverted = False
        if terms or k:
            kind, op, where = tokens[k]
            if kind == "blank":
                raise _refuse(text, where, "a blank between symbols says nothing: write * between them")
            if kind != "op":
                raise _refuse(text, where, "an operator is missing")
            inverted, k = op == "/", k + 1
        if k >= len(tokens) or tokens[k][0] != "symbol":
            raise _hint(text, tokens[k][2] if k < len(tokens) else len(text))
        _, symbol, where = tokens[k]
        k += 1
        exponent = -1 if inverted else 1
        if k < len(tokens) and tokens[k][0] == "power":
            exponent = _exponent(text, tokens[k][1], tokens[k][2] + 1, inverted)
            k += 1
        terms.append(Term(symbol, exponent, len(text[:where].encode("utf-8", "surrogatepass"))))
        if k == len(tokens):
            return tuple(terms)
