"""What an analysis returns: a status, values, and where these come from."""

from __future__ import annotations

from dataclasses import dataclass, field

OK, INSUFFICIENT, ERROR = "ok", "insufficient_data", "error"


@dataclass(frozen=True)
class Provenance:
    period: str | None = None
    rows_scanned: int = 0
    filters: list[str] = field(default_factory=list)
    assumptions: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Result:
    tool: str
    status: str
    values: dict | list
    provenance: Provenance
    message: str = ""


def ok(tool: str, values: dict | list, period: str | None, rows: int, filters: list[str] = (), assumptions: list[str] = ()) -> Result:
    return Result(tool, OK, values, Provenance(period, rows, list(filters), list(assumptions)))


def insufficient(tool: str, message: str, period: str | None, rows: int = 0) -> Result:
    return Result(tool, INSUFFICIENT, {}, Provenance(period, rows), message)


def error(tool: str, message: str, period: str | None = None, filters: list[str] = ()) -> Result:
    return Result(tool, ERROR, {}, Provenance(period, filters=list(filters)), message)
