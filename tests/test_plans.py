import json

import pytest
from conftest import TINY
from test_sources import example

from cyclemill.__main__ import main
from cyclemill.config import Config
from cyclemill.operators.analyses import Session
from cyclemill.plans.execution import execute
from cyclemill.plans.planning import Plan, canned, route, with_level_check
from cyclemill.plans.registry import TOOLS, Step, fault, plan_schema, tool_schemas
from cyclemill.plans.report import html, markdown, ungrounded, write


@pytest.mark.parametrize(
    "step, part",
    [
        (Step("nope"), "unknown tool"),
        (Step("trend", {"x": 1}), "takes no argument"),
        (Step("trend", {"by": "week"}), "must be one of"),
        (Step("trend", {"window": True}), "type int"),
        (Step("trend", {"window": 0}), "1 at least"),
        (Step("head_correlation", {"heads": list(range(1, 66))}), "64 items"),
        (Step("head_correlation", {"heads": [0]}), "1 at least"),
        (Step("head_correlation", {"heads": ["a"]}), "type int"),
        (Step("closure_filter", {"above": "2"}), "type number"),
    ],
)
def test_faults(step, part):
    assert part in fault(step)


def test_good_steps_and_schemas():
    assert fault(Step("closure_filter", {"above": 2, "below": 2.5, "head": None})) is None
    assert len(TOOLS) == 13 and len(tool_schemas()) == 13
    json.dumps(plan_schema())


def test_routes():
    assert [s.tool for s in canned("kpi").steps] == ["overview", "success_rates", "success_rates", "capping_speed", "idle_periods"]
    assert route("which head is drifting over time?").steps[0].tool == "trend"
    assert route("any unusual outlier?").steps[0].tool == "anomalies"
    assert route("hm").steps == canned("kpi").steps
    assert with_level_check(canned("drift")).steps[-1].tool == "compare_periods"
    assert with_level_check(canned("kpi")).steps == canned("kpi").steps
    with pytest.raises(ValueError):
        canned("other")


def test_a_plan_survives_its_steps(event_table, tmp_path):
    plan = Plan("mixed", (Step("overview", {"period": "2026-02"}), Step("overview", {"period": "bad"}), Step("nope"), Step("event_gaps", {"min_seconds": 5})))
    run = execute(Session(Config(), event_table(TINY)), plan)
    assert [r.status for r in run.results] == ["ok", "error", "error", "ok"] and run.store["rows"] == 8
    text = markdown(run)
    assert "6 capping operations" in text and "## Limits" in text and "unknown tool" in text
    assert ungrounded("There were 6 operations and 977 others.", run) == ["977"]
    path = write(run, str(tmp_path / "out"))
    assert path.endswith("report.md") and len(json.loads((tmp_path / "out/trace.json").read_text())["steps"]) == 4
    assert "<table>" in html(text)


@pytest.mark.parametrize("report", ["kpi", "drift", "anomalies"])
def test_canned_reports(event_table, report):
    run = execute(Session(Config(), event_table(TINY)), canned(report, "2026-02"))
    assert "error" not in {r.status for r in run.results}
    assert markdown(run)


def test_command_line(spark, tmp_path):
    store = str(tmp_path / "store")
    assert main(["ingest", example(tmp_path / "d.csv"), "--store", store, "--machine", "MCC"], spark) == 0
    (tmp_path / "c.json").write_text(json.dumps({"store_path": store}))
    assert main(["report", "kpi", "--config", str(tmp_path / "c.json"), "--out", str(tmp_path / "r")], spark) == 0
    assert (tmp_path / "r/report.md").exists()
    assert main(["ask", "any fault?", "--config", str(tmp_path / "c.json"), "--out", str(tmp_path / "q")], spark) == 0
    assert main(["export", store, str(tmp_path / "x")], spark) == 0
    assert main(["report", "other"], spark) == 2 and main([], spark) == 2
    assert main(["report", "kpi", "--config", str(tmp_path / "none.json")], spark) == 2
    (tmp_path / "n.json").write_text(json.dumps({"store_path": str(tmp_path / "no")}))
    assert main(["report", "kpi", "--config", str(tmp_path / "n.json")], spark) == 1


def test_findings_name_steps_and_next_checks():
    from datetime import datetime

    from cyclemill.plans.report import findings, next_checks
    from cyclemill.result import ok

    def bucket(month, caps, rate, mean, sd):
        return {"bucket_start": datetime(2026, month, 1), "caps": caps, "reject_rate": rate, "torque_mean": mean, "torque_stddev": sd}

    steady = [bucket(2, 1000, 0.01, 2.0, 0.02), bucket(3, 1000, 0.0105, 2.05, 0.03)]
    moved = [bucket(1, 5, 0.5, 9.0, 0.0001), bucket(2, 1000, 0.01, 2.0, 0.02), bucket(3, 1000, 0.02, 2.2, 0.05)]
    said = {}
    for name, buckets in (("steady", steady), ("moved", moved)):
        r = ok("compare_periods", {"buckets": buckets, "change_first_to_last": None}, None, 1)
        said[name] = " ".join(findings(r)), next_checks(r)
    assert "stayed" in said["steady"][0] and "level" not in said["steady"][0] and "spreads" not in said["steady"][0] and not said["steady"][1]
    assert all(x in said["moved"][0] for x in ("1 buckets hold too few", "went from 1.000%", "10.0 standard deviations", "2.5 times as wide")) and said["moved"][1]
    heads = [{"head_id": h, "stddev": x} for h, x in ((7, 0.03), (1, 0.021), (2, 0.02))]
    assert "stands out" in " ".join(findings(ok("torque_stats", heads, None, 1))) and "No head stands out" in " ".join(findings(ok("torque_stats", heads[1:], None, 1)))
    same = [{"head_id": h, "mean_correlation": x} for h, x in ((1, 0.9991), (2, 0.9995))]
    assert "median torque" in next_checks(ok("head_correlation", {"outliers": same}, None, 1))[0]
    apart = [{"head_id": 3, "mean_correlation": 0.2}, *same]
    assert "head 3" in next_checks(ok("head_correlation", {"outliers": apart}, None, 1))[0]


def test_more_findings():
    from datetime import datetime

    from cyclemill.plans.report import findings, next_checks
    from cyclemill.result import ok

    def said(tool, values, filters=()):
        r = ok(tool, values, None, 1, list(filters))
        return " ".join(findings(r)), " ".join(next_checks(r))

    buckets = [{"bucket_start": datetime(2026, m, 1), "caps": c, "caps_per_day": c / 30, "reject_rate": 0.01, "torque_mean": 2.0, "torque_stddev": 0.02} for m, c in ((1, 3000), (2, 600), (3, 3100))]
    text, check = said("compare_periods", {"buckets": buckets, "change_first_to_last": None, "lowest_volume_bucket": buckets[1]})
    assert "Fewest operations: 20 a day in 2026-02-01" in text and "Look at the gaps in 2026-02-01" in check and "changed on the line" not in check
    assert "Fewest" not in said("compare_periods", {"buckets": buckets[::2], "change_first_to_last": None, "lowest_volume_bucket": buckets[0]})[0]
    filters = {"above": 2.5, "below": None, "outcome": "failed", "head": None}
    text, _ = said("closure_filter", {"filters": filters, "count": 40, "capping_operations": 1000, "by_head": [{"head_id": 3, "count": 30}, {"head_id": 1, "count": 10}]})
    assert "40 of 1,000" in text and "(above 2.5 Nm, outcome failed)" in text and "Head 3 has most of them, 30 (75.00 %)" in text
    zones = [{"zone": "below", "closures": 10, "rejected": 5, "reject_rate": 0.5}, {"zone": "inside", "closures": 0, "rejected": 0, "reject_rate": None}]
    text, _ = said("failure_correlation", {"correlation": -0.25, "zones": zones}, ["by=torque"])
    assert "-0.2500" in text and "Below the band: 5 rejects of 10" in text and "Inside" not in text
    short = [{"head_id": 1, "tau": 0.0, "p_value": None, "direction": "flat", "drifting": False, "insufficient": True}]
    assert said("trend", {"series": [], "drift": short})[0].startswith("Undetermined")
    moving = [{"head_id": h, "tau": 0.9, "p_value": 0.001, "direction": "rising", "drifting": True, "insufficient": False} for h in range(7)]
    assert "2 more heads drift" in said("trend", {"series": [], "drift": moving})[0]
    counts = {"faults": 0, "threshold_hits": 9, "deviation_hits": 0}
    text, _ = said("anomalies", {"counts": counts, "faults_by_condition": {}, "threshold_by_head": [{"head_id": 4, "count": 9}], "deviation_heads_at_floor": 2, "deviation_heads": 5, "deviation_fallbacks": {}})
    assert "head 4 with 9" in text and "2 of 5 heads" in text
