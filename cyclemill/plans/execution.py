"""Running a plan. A step that fails is a result with status error, and the plan goes on."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.storagelevel import StorageLevel

from cyclemill.functions.exprs import scope
from cyclemill.operators.analyses import Session
from cyclemill.operators.frames import fingerprint
from cyclemill.plans.planning import Plan
from cyclemill.plans.registry import TOOLS, fault
from cyclemill.result import Result, error


@dataclass(frozen=True)
class Execution:
    plan: Plan
    results: list[Result] = field(default_factory=list)
    trace: list[dict] = field(default_factory=list)
    store: dict = field(default_factory=dict)


#: Columns that an analysis reads.
READ = ["machine_id", "head_id", "ts", "cap_seq", "app_torque", "status", "is_reset"]


def shared(session: Session, plan: Plan) -> DataFrame:
    """What the steps read in common: the machine's events, of the plan's period if all steps have the same one and none looks
    beyond it, as a correlation does to find all heads."""
    periods = {s.effective().get("period") if fault(s) is None else None for s in plan.steps}
    one = next(iter(periods)) if len(periods) == 1 and not any(s.tool == "head_correlation" for s in plan.steps) else None
    try:
        return scope(session.events, session.cfg, one).select(READ)
    except ValueError:  # a period that isn't one: the step that has it says so
        return scope(session.events, session.cfg, None).select(READ)


def execute(session: Session, plan: Plan) -> Execution:
    """The steps read the same events, so what they have in common is kept (memory, then disk) while the plan runs."""
    kept = shared(session, plan).persist(StorageLevel.MEMORY_AND_DISK)
    results, trace = [], []
    try:
        try:
            store = fingerprint(session.events).first().asDict()
        except Exception as e:  # the trace says so
            store = {"error": f"{type(e).__name__}: {e}"}
        session = replace(session, events=kept)
        for number, step in enumerate(plan.steps, 1):
            args = step.effective()
            if (why := fault(step)) is not None:
                result = error(step.tool, why, args.get("period"), [f"args={args}"])
            else:
                try:
                    result = TOOLS[step.tool].run(session, **args)
                except Exception as e:  # one analysis must not end the report
                    result = error(step.tool, f"{type(e).__name__}: {e}", args.get("period"), [f"args={args}"])
            results.append(result)
            trace.append({"step": number, "tool": step.tool, "args": args, "why": step.why, "status": result.status, "rows_scanned": result.provenance.rows_scanned, "message": result.message})
    finally:
        kept.unpersist()
    return Execution(plan, results, trace, store)
