"""Fixed plans behind three reports, and the choice among them by keywords."""

from __future__ import annotations

from dataclasses import dataclass

from cyclemill.plans.registry import Step


@dataclass(frozen=True)
class Plan:
    goal: str
    steps: tuple[Step, ...]
    note: str = ""


#: Fixed sequences of calls.
_CALLS: dict[str, list[tuple[str, dict, str]]] = {
    "kpi": [
        ("overview", {}, "what the period holds"),
        ("success_rates", {"by": "overall"}, "the rate of all heads"),
        ("success_rates", {"by": "head"}, "the weakest head"),
        ("capping_speed", {"bucket": "day"}, "output per active hour"),
        ("idle_periods", {}, "cycles without load"),
    ],
    "drift": [
        ("trend", {"signal": "torque", "by": "day", "window": 7}, "heads whose torque rises or falls"),
        ("trend", {"signal": "success_rate", "by": "day", "window": 7}, "whether quality moves too"),
        ("torque_stats", {"outcome": "successful", "by": "head"}, "noise apart from drift"),
        ("head_correlation", {"by": "day"}, "the head out of step"),
    ],
    "anomalies": [
        ("anomalies", {"method": "both"}, "rejects and torque that stands out"),
        ("overview", {}, "what the counts compare with"),
        ("success_rates", {"by": "day"}, "the days in question"),
    ],
}
REPORTS = tuple(_CALLS)

#: Substrings that speak for a report.
KEYWORDS = {
    "kpi": ("kpi", "success", "successful", "rate", "how many", "percentage", "throughput", "speed", "pieces", "idle", "count", "overview", "summary", "performed", "stopped", "downtime"),
    "drift": ("drift", "drifting", "trend", "over time", "evolve", "evolved", "change over", "changed over", "moving average", "walking", "correlate", "correlation", "differently", "compare", "worse"),
    "anomalies": ("anomaly", "anomalies", "anomalous", "abnormal", "outlier", "outside", "threshold", "fault", "faults", "reject", "rejected", "deviation", "unusual", "spike"),
}


def canned(report: str, period: str | None = None) -> Plan:
    if report not in _CALLS:
        raise ValueError(f"reports are {list(_CALLS)}, not {report!r}")
    steps = tuple(Step(tool, {"period": period} | args, why) for tool, args, why in _CALLS[report])
    return Plan(f"{report} report for {period or 'all stored events'}", steps)


def route(question: str, period: str | None = None) -> Plan:
    """The report that most keywords speak for; the first of equals, kpi where none does."""
    text = question.lower()
    hits = {r: sum(k in text for k in KEYWORDS[r]) for r in REPORTS}
    best = max(REPORTS, key=lambda r: hits[r])
    note = f"{hits[best]} keywords point to the {best} report" if hits[best] else "no keyword was found; this is the default report"
    return Plan(f"Answer: {question}", canned(best, period).steps, note)


def with_level_check(plan: Plan, period: str | None = None) -> Plan:
    """A torque trend says nothing about steps in level, so a comparison of months goes along with it."""
    trends = any(s.tool == "trend" and s.effective().get("signal", "torque") == "torque" for s in plan.steps)
    if not trends or any(s.tool == "compare_periods" for s in plan.steps):
        return plan
    return Plan(plan.goal, (*plan.steps, Step("compare_periods", {"period": period, "by": "month"}, "the level, month by month")), plan.note)
