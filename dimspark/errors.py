"""Errors and warnings of the unit layer, each with a stable code."""

from __future__ import annotations

ERROR_CODES = (
    "E_UNIT_SYNTAX", "E_UNKNOWN_UNIT", "E_DIM_MISMATCH", "E_UNIT_MISMATCH", "E_AFFINE_COMPOUND", "E_INTERVAL_MISUSE",
    "E_BASE_MISSING", "E_BASE_MISMATCH", "E_CAST_LOSSY", "E_BAD_PLACEMENT", "E_KIND_UNSUMMABLE", "E_TEMPORAL_MISMATCH",
    "E_GRAMMAR_VERSION", "E_BAD_METADATA", "E_REGISTRY_INVALID", "E_EXP_RANGE",
    "E_PLAN_TYPE", "E_SEAL_BROKEN", "E_PUBLISHER_UNKNOWN", "E_TRANSIT_ALTERED", "E_ADVISORY_MATCH",
)
WARNING_CODES = ("W_TAINT_INTRODUCED", "W_COERCED", "W_UNRESOLVED_SYMBOL", "W_CAST_LOSSY")


class UnitError(ValueError):
    """A refusal: `CODE: message`, with the byte offset or symbol it is about, where there is one."""

    def __init__(self, code: str, message: str, *, offset: int | None = None, symbol: str | None = None):
        if code not in ERROR_CODES:
            raise KeyError(code)
        self.code, self.message, self.offset, self.symbol = code, message, offset, symbol
        where = "" if offset is None else f" (at byte {offset})"
        super().__init__(f"{code}: {message}{where}")


class UnitWarning(UserWarning):
    """A notice that a lineage gives once."""

    def __init__(self, code: str, message: str):
        if code not in WARNING_CODES:
            raise KeyError(code)
        self.code, self.message = code, message
        super().__init__(f"{code}: {message}")
