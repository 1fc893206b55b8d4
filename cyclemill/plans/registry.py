"""The analyses by name, the arguments each takes, and the check of a call."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from cyclemill.operators import analyses as T


@dataclass(frozen=True)
class Arg:
    """kind: str, int, number or ints. choices, least and most (items) narrow it. Every argument may be None."""

    kind: str
    choices: tuple = ()
    least: int | None = None
    most: int | None = None

    def schema(self) -> dict:
        json_kind = {"str": "string", "int": "integer", "number": "number", "ints": "array"}[self.kind]
        out: dict = {"type": [json_kind, "null"]}
        if self.choices:
            out["enum"] = [*self.choices, None]
        if self.kind == "ints":
            out["items"] = {"type": "integer"} | ({"minimum": self.least} if self.least is not None else {})
            if self.most is not None:
                out["maxItems"] = self.most
        elif self.least is not None:
            out["minimum"] = self.least
        return out

    def fault(self, value) -> str | None:
        if value is None:
            return None
        kinds = {"str": str, "int": int, "number": (int, float), "ints": (list, tuple)}
        if isinstance(value, bool) or not isinstance(value, kinds[self.kind]):
            return f"must have type {self.kind}, got {value!r}"
        if self.choices and value not in self.choices:
            return f"must be one of {list(self.choices)}, got {value!r}"
        for x in value if self.kind == "ints" else [value]:
            if self.kind == "ints" and (isinstance(x, bool) or not isinstance(x, int)):
                return f"items must have type int, got {x!r}"
            if self.least is not None and x < self.least:
                return f"must be {self.least} at least, got {x!r}"
        if self.most is not None and len(value) > self.most:
            return f"takes {self.most} items at most, got {len(value)}"
        return None


@dataclass(frozen=True)
class Tool:
    run: Callable
    answers: str
    args: dict[str, Arg] = field(default_factory=dict)


_PERIOD = Arg("str")


def _pick(*choices: str) -> Arg:
    return Arg("str", choices)


TOOLS: dict[str, Tool] = {
    "overview": Tool(T.overview, "What the period holds: operations, outcomes, heads, times, doubtful data.", {"period": _PERIOD}),
    "success_rates": Tool(T.success_rates, "Share of successes by head, by day or overall.", {"period": _PERIOD, "by": _pick("head", "day", "overall")}),
    "torque_stats": Tool(T.torque_stats, "Level and spread of the closing torque.", {"period": _PERIOD, "outcome": _pick("successful", "failed", "all"), "by": _pick("head")}),
    "capping_speed": Tool(T.capping_speed, "Pieces per active hour.", {"period": _PERIOD, "bucket": _pick("hour", "day")}),
    "idle_periods": Tool(T.idle_periods, "Runs of cycles without load.", {"period": _PERIOD, "min_seconds": Arg("int", least=1)}),
    "anomalies": Tool(T.anomalies, "Rejects, torque outside the band or far from the head's median.", {"period": _PERIOD, "method": _pick("threshold", "deviation", "both")}),
    "trend": Tool(T.trend, "Moving means and lasting drift per head.", {"period": _PERIOD, "signal": _pick("torque", "success_rate"), "by": _pick("day", "hour"), "window": Arg("int", least=1)}),
    "head_correlation": Tool(T.head_correlation, "Which head moves unlike the others.", {"period": _PERIOD, "heads": Arg("ints", least=1, most=64), "by": _pick("day", "hour")}),
    "event_gaps": Tool(T.event_gaps, "Stretches in which no head sent anything.", {"period": _PERIOD, "min_seconds": Arg("int", least=1)}),
    "compare_periods": Tool(T.compare_periods, "Months or weeks side by side.", {"period": _PERIOD, "by": _pick("month", "week")}),
    "closure_filter": Tool(T.closure_filter, "Exact count and first events of a filter.", {"period": _PERIOD, "above": Arg("number"), "below": Arg("number"), "outcome": _pick("successful", "failed", "all"), "head": Arg("int", least=1)}),
    "failure_correlation": Tool(T.failure_correlation, "Rejects by hour of day, or against torque.", {"period": _PERIOD, "by": _pick("hour_of_day", "torque")}),
    "methodology": Tool(T.methodology, "How figures are defined; measures nothing.", {"topic": _pick(*T.TOPICS)}),
}


@dataclass(frozen=True)
class Step:
    tool: str
    args: dict = field(default_factory=dict)
    why: str = ""

    def effective(self) -> dict:
        """Arguments that were given; None stands for the default."""
        return {k: v for k, v in self.args.items() if v is not None}


def fault(step: Step) -> str | None:
    """Why a step can't be called; None if it can."""
    tool = TOOLS.get(step.tool)
    if tool is None:
        return f"unknown tool {step.tool!r}; known are {sorted(TOOLS)}"
    for name, value in step.args.items():
        if name not in tool.args:
            return f"{step.tool} takes no argument {name!r}; it takes {sorted(tool.args)}"
        if (what := tool.args[name].fault(value)) is not None:
            return f"{step.tool}.{name} {what}"
    return None


def tool_schemas() -> list[dict]:
    return [{"name": n, "description": t.answers, "parameters": {"type": "object", "properties": {a: x.schema() for a, x in t.args.items()}, "additionalProperties": False}} for n, t in TOOLS.items()]


def plan_schema() -> dict:
    """JSON schema of a plan: a goal and steps, each a tool with its own arguments."""
    steps = [{"type": "object", "properties": {"tool": {"const": s["name"]}, "args": s["parameters"], "why": {"type": "string"}}, "required": ["tool", "args"], "additionalProperties": False} for s in tool_schemas()]
    return {"type": "object", "properties": {"goal": {"type": "string"}, "steps": {"type": "array", "minItems": 1, "items": {"anyOf": steps}}}, "required": ["goal", "steps"], "additionalProperties": False}
