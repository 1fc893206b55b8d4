"""Figures of small results: against files made before, and what each must show. CYCLEMILL_GOLDEN=1 makes the files anew."""

import math
import os
import xml.etree.ElementTree as ET
from datetime import date, datetime, timedelta
from pathlib import Path

import pytest
from conftest import TINY

from cyclemill.config import Config
from cyclemill.operators.analyses import Session
from cyclemill.plans import figures as G
from cyclemill.plans.execution import Execution, execute
from cyclemill.plans.planning import Plan
from cyclemill.plans.registry import Step
from cyclemill.plans.report import findings, html, write
from cyclemill.result import error, insufficient, ok

GOLDEN = Path(__file__).parent / "golden"
DAY = datetime(2026, 2, 1)


def heads(rates):
    return ok("success_rates", [{"head_id": i + 1, "total": 1000, "successful": round(1000 * r), "failed": 1000 - round(1000 * r), "success_rate": r} for i, r in enumerate(rates)], None, 1, ["by=head"])


def trend():
    series = [{"head_id": h, "bucket": DAY + timedelta(days=d), "value": 2.0, "rolling_mean": 2 + 0.01 * h * (h == 2) * d + 0.002 * math.sin(d + h), "rolling_std": None} for h in (1, 2, 3) for d in range(10)]
    drifts = [{"head_id": h, "tau": t, "p_value": p, "n_buckets": 10, "direction": "rising", "drifting": moves, "insufficient": False} for h, t, p, moves in ((1, 0.1, 0.7, False), (2, 0.95, 0.0002, True), (3, -0.3, 0.2, False))]
    return ok("trend", {"series": series, "drift": [*drifts, {"head_id": 4, "tau": 0.0, "p_value": None, "n_buckets": 2, "direction": "flat", "drifting": False, "insufficient": True}]}, None, 1, ["signal=torque", "by=day"])


def anomalies(total=3):
    def hits(n, at, torque):
        return [{"head_id": 1, "ts": DAY + timedelta(hours=at + i), "app_torque": torque + i / 10, "reason": 'more than "4" & so'} for i in range(n)]

    values = {"faults": hits(1, 1, 1.0), "threshold_hits": hits(1, 30, 3.0), "deviation_hits": hits(1, 60, 2.0)}
    return ok("anomalies", values | {"counts": {"faults": total - 2, "threshold_hits": 1, "deviation_hits": 1}, "listed": {k: len(v) for k, v in values.items()}}, None, 1)


RESULTS = {
    "success_by_head": heads([0.9999, 0.9995, 0.9991, 0.9998]),
    "rejects_by_day": ok("success_rates", [{"day": date(2026, 2, d), "total": 100, "successful": 100 - d, "failed": d % 4, "success_rate": 0.9} for d in range(1, 8)], None, 1, ["by=day"]),
    "speed": ok("capping_speed", {"buckets": [{"bucket_start": DAY + timedelta(hours=h), "pieces_per_hour": 1000 + 100 * (h % 3)} for h in range(12)], "mean_pieces_per_hour": 1100.0}, None, 1),
    "rolling_mean": trend(),
    "drift": trend(),
    "anomalies": anomalies(),
    "torque_histogram": ok("torque_stats", {"histogram_bin_width": 0.01, "histogram": [{"bin_start": 1.9 + k / 100, "count": n} for k, n in ((0, 1), (5, 200), (6, 3000), (7, 150), (30, 1))]}, None, 1),
    "rejects_by_hour": ok("failure_correlation", {"by": "hour_of_day", "hours": [{"hour": h, "closures": 1000, "rejected": h % 5, "reject_rate": (h % 5) / 1000} for h in range(6, 22)], "rejected": 30, "reject_rate": 0.002, "highest": {"hour": 9}, "lowest": {"hour": 10}}, None, 1),
}


@pytest.mark.parametrize("name", sorted(G.FIGURES))
def test_golden(name):
    svg = G.FIGURES[name](RESULTS[name])
    root = ET.fromstring(svg)
    assert root.tag.endswith("svg")
    for node in root.iter():  # all marks lie inside
        for k, most in (("x", G.WIDTH), ("cx", G.WIDTH), ("y", G.HEIGHT), ("cy", G.HEIGHT)):
            assert 0 <= float(node.get(k, 0)) <= most
    if os.environ.get("CYCLEMILL_GOLDEN"):
        GOLDEN.mkdir(exist_ok=True)
        (GOLDEN / f"{name}.svg").write_text(svg, encoding="utf-8")
    assert svg == (GOLDEN / f"{name}.svg").read_text(encoding="utf-8")


def test_every_figure_has_its_own_result():
    for name, make in G.FIGURES.items():
        shown = {k for k, r in RESULTS.items() if make(r) is not None}
        assert shown == {k for k in RESULTS if RESULTS[k].tool == RESULTS[name].tool and (RESULTS[k].tool != "success_rates" or k == name)}, name


def test_nothing_to_show():
    tools = {r.tool for r in RESULTS.values()}
    for make in G.FIGURES.values():
        run = Execution(Plan("g", ()), [error(t, "why", None) for t in tools] + [insufficient(t, "why", None) for t in tools])
        assert G.figures(run) == {}
    assert G.success_by_head(ok("success_rates", [{"head_id": 1, "total": 1, "successful": 0, "failed": 0, "success_rate": None}], None, 1, ["by=head"])) is None
    assert G.rejects_by_day(ok("success_rates", [{"day": date(2026, 2, 1), "total": 1, "successful": 1, "failed": 0, "success_rate": 1.0}], None, 1, ["by=day"])) is None
    nothing = {"faults": [], "threshold_hits": [], "deviation_hits": [], "counts": {}, "listed": {}}
    assert G.anomalies(ok("anomalies", nothing, None, 1)) is None
    assert G.torque_histogram(ok("torque_stats", [{"head_id": 1, "stddev": 0.1}], None, 1)) is None
    assert G.rejects_by_hour(ok("failure_correlation", {"by": "torque", "correlation": None}, None, 1)) is None


def test_what_stands_out_is_marked_and_named():
    svg = G.success_by_head(RESULTS["success_by_head"])
    assert "lowest: head 3, 99.910 %" in svg and svg.count(f'fill="{G.SECOND}"') == 2 and "scale from 99.855 %" in svg
    assert "scale from" not in G.success_by_head(heads([0.0, 0.5]))
    assert "head 2, drifting" in G.rolling_mean(trend()) and "limit +0.5" in G.drift(trend()) and "limit -0.5" in G.drift(trend())
    assert "sample, 3 of 1,002" in G.anomalies(anomalies(1002)) and "sample" not in G.anomalies(anomalies())
    assert "&quot;4&quot; &amp; so" in G.anomalies(anomalies())


@pytest.mark.parametrize("low, high", [(0, 1), (0, 7), (99.855, 100), (-1, 1), (0, 123_456), (0.2, 0.2), (1.9, 2.21)])
def test_ticks_are_round_and_inside(low, high):
    got = G.ticks(low, high)
    assert got and all(low - 1e-9 <= t <= high + 1e-9 for t in got) and len(got) <= 8
    assert len({round(b - a, 9) for a, b in zip(got, got[1:])}) <= 1


def test_figures_are_in_the_report(event_table, tmp_path):
    plan = Plan("all", tuple(Step(t, {"period": "2026-02"} | a) for t, a in (("success_rates", {"by": "head"}), ("success_rates", {"by": "head"}), ("torque_stats", {}), ("capping_speed", {}), ("trend", {}), ("anomalies", {}))))
    run = execute(Session(Config(), event_table(TINY)), plan)
    names = list(G.figures(run))
    assert names[:2] == ["success_by_head", "success_by_head-2"] and {"torque_histogram", "speed", "anomalies"} <= set(names)
    path = write(run, str(tmp_path / "out"))
    page = (tmp_path / "out/report.html").read_text()
    assert page.count("<svg") == len(names) == len(list((tmp_path / "out/figures").iterdir()))
    assert all(f"![{n}](figures/{n}.svg)" in Path(path).read_text() for n in names)
    assert "<svg" not in html("![x](figures/x.svg)")


def test_runs_are_counted_by_their_totals():
    """The list of runs may be cut; the sentence counts all."""
    longest = {"head_id": 1, "start": DAY, "end": DAY, "cycles": 2, "duration_seconds": 600}
    v = {"periods": [longest], "total_idle_seconds": 5000, "longest_period": longest, "by_head": [{"head_id": 1, "periods": 1200, "total_seconds": 4000}, {"head_id": 2, "periods": 34, "total_seconds": 1000}], "min_seconds": 1}
    assert findings(ok("idle_periods", v, None, 1))[0].startswith("1,234 runs")


def test_measured_line(capsys):
    import json

    from cyclemill.metrics import Measured

    with Measured() as took:
        sum(range(100_000))
    line = json.loads(took.line(rows=10, file="a"))
    assert line["file"] == "a" and line["rows"] == 10 and line["wall_s"] >= 0 and line["driver_rss_mb"] > 1 and line["rows_per_s"] > 0
