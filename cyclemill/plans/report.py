"""A run of a plan as Markdown, a page with figures, and its trace as JSON. Every number comes from a result."""

from __future__ import annotations

import json
import os
import re
from datetime import date, datetime
from statistics import median

from cyclemill.functions.stats import DRIFT_P
from cyclemill.plans.execution import Execution
from cyclemill.plans.figures import figures
from cyclemill.result import OK, Result


#: Fixed values. Between two buckets: how much larger a reject rate is that has moved, how many of the steadier bucket's standard
#: deviations apart two levels are, how much wider a spread is. Buckets with less than this share of the operations are not
#: compared. A head stands out whose spread is so many percent over the median of the others.
RATE_STEP, LEVEL_STEP, SPREAD_STEP, LEAST_SHARE, STANDOUT = 1.1, 5, 2.0, 0.01, 10.0
#: Mean correlations that differ by less are the same.
SAME_CORRELATION = 0.001


def _percent(x: float | None) -> str:
    return "none" if x is None else f"{100 * x:.2f} %"


def _success(v, by: str) -> list[str]:
    if by == "overall":
        return [f"Success rate {_percent(v['success_rate'])}: {v['successful']:,} of {v['successful'] + v['failed']:,} closures with a verdict.", f"Lowest is head {v['lowest_head']}."]
    rated = [r for r in v if r["success_rate"] is not None]
    if not rated:
        return ["No group has a closure with a verdict."]
    key = "head_id" if by == "head" else "day"
    low = min(rated, key=lambda r: (r["success_rate"], r[key]))
    middle = median(r["success_rate"] for r in rated)
    out = [f"{by.capitalize()} {low[key]} is lowest with {_percent(low['success_rate'])}; the median is {_percent(middle)}."]
    if by == "head" and middle and (middle - low["success_rate"]) / middle >= 0.1:
        out.append(f"Head {low['head_id']} stands out: a tenth or more under the median.")
    return out


def _trend(v) -> list[str]:
    moving = [d for d in v["drift"] if d["drifting"]]
    if v["drift"] and all(d["insufficient"] for d in v["drift"]):
        return ["Undetermined: no head has buckets enough for a verdict."]
    out = [f"Head {d['head_id']} is {d['direction']}: tau {d['tau']:.2f}, p {d['p_value']:.3g}." for d in moving[:5]] or ["No head drifts."]
    out += [f"{len(moving) - 5} more heads drift."] * (len(moving) > 5)
    if short := sum(d["insufficient"] for d in v["drift"]):
        out.append(f"{short} heads have too few buckets for a verdict.")
    return out


def _spread(heads: list[dict]) -> list[str]:
    first, *rest = heads  # widest first
    if first["stddev"] is None:
        return ["No head has two closures, so none has a spread."]
    others = [h["stddev"] for h in rest if h["stddev"] is not None]
    out = [f"Head {first['head_id']} varies most: {first['stddev']:.4f} Nm" + (f", the other {len(others)} from {min(others):.4f} to {max(others):.4f}." if others else ".")]
    middle = median(others) if others else 0
    if not middle:
        return out
    over = 100 * (first["stddev"] / middle - 1)
    return out + [f"It stands out: {over:.1f} % over the median of the others." if over >= STANDOUT else "No head stands out."]


def _compared(v) -> list[str]:
    step = v["change_first_to_last"] and v["change_first_to_last"]["caps_per_day_pct"]
    out = [f"{len(v['buckets'])} buckets." + (f" Capping operations per day changed by {step:+.1f} % from the first to the last." if step is not None else "")]
    out += _lowest(v)
    total = sum(b["caps"] for b in v["buckets"])
    full = [b for b in v["buckets"] if b["caps"] and b["caps"] >= LEAST_SHARE * total]
    if left := len(v["buckets"]) - len(full):
        out.append(f"{left} buckets hold too few operations to be compared.")
    if len(full) < 2:
        return out
    a, b = full[0], full[-1]
    rates = [x["reject_rate"] for x in (a, b)]
    if None not in rates and any(rates):
        moved = min(rates) == 0 or max(rates) / min(rates) >= RATE_STEP
        out.append(f"The reject rate {'went' if moved else 'stayed, going'} from {rates[0]:.3%} in {a['bucket_start']} to {rates[1]:.3%} in {b['bucket_start']}.")
    wide = [x for x in full if x["torque_stddev"]]
    if wide:
        most, least = max(wide, key=lambda x: x["torque_stddev"]), min(wide, key=lambda x: x["torque_stddev"])
        low, high = min(wide, key=lambda x: x["torque_mean"]), max(wide, key=lambda x: x["torque_mean"])
        if (apart := (high["torque_mean"] - low["torque_mean"]) / least["torque_stddev"]) >= LEVEL_STEP:
            out.append(f"Torque is at another level: {low['torque_mean']:.3f} Nm in {low['bucket_start']}, {high['torque_mean']:.3f} in {high['bucket_start']}, {apart:.1f} standard deviations of the steadiest bucket apart.")
        if most["torque_stddev"] >= SPREAD_STEP * least["torque_stddev"]:
            out.append(f"Torque spreads {most['torque_stddev'] / least['torque_stddev']:.1f} times as wide in {most['bucket_start']} as in {least['bucket_start']}.")
    return out


def _matching(v) -> list[str]:
    f = v["filters"]
    limits = [f"{k} {f[k]:g} Nm" for k in ("above", "below") if f[k] is not None]
    named = [*limits, *([f"outcome {f['outcome']}"] if f["outcome"] != "all" else []), *([f"head {f['head']}"] if f["head"] is not None else [])]
    out = [f"{v['count']:,} of {v['capping_operations']:,} capping operations match" + (f" ({', '.join(named)})." if named else ".")]
    if len(v["by_head"]) > 1:
        first = v["by_head"][0]
        out.append(f"Head {first['head_id']} has most of them, {first['count']:,} ({_percent(first['count'] / v['count'])}), {len(v['by_head'])} heads have some.")
    return out


def _lowest(v) -> list[str]:
    """The bucket with the fewest operations a day, if it lies a tenth or more under the median of the others."""
    low = v.get("lowest_volume_bucket")
    others = [b["caps_per_day"] for b in v["buckets"] if b is not low and b.get("caps_per_day") is not None] if low else []
    if not others or low["caps_per_day"] > 0.9 * median(others):
        return []
    return [f"Fewest operations: {low['caps_per_day']:,.0f} a day in {low['bucket_start']}, where the others' median is {median(others):,.0f}."]


def next_checks(r: Result) -> list[str]:
    """What a result gives reason to look at next."""
    if r.status != OK:
        return []
    v = r.values
    if r.tool == "overview" and v["invalid_torque"]:
        return ["See whether the torque band in the settings is that of the product that runs."]
    if r.tool == "success_rates" and isinstance(v, list):
        rated = [x for x in v if "head_id" in x and x["success_rate"] is not None and x["failed"]]
        low = min(rated, key=lambda x: (x["success_rate"], x["head_id"]), default=None)
        return [f"Look at head {low['head_id']} on the machine."] if low else []
    if r.tool == "trend":
        moving = [d for d in v["drift"] if d["drifting"]]
        if moving:
            return [f"Repeat the trend of head {moving[0]['head_id']} in a month: if it goes on in the same direction, the head wants service."]
        return ["Repeat the trend over a longer period."] * bool(v["drift"] and all(d["insufficient"] for d in v["drift"]))
    if r.tool == "head_correlation" and v["outliers"]:
        low, high = v["outliers"][0], v["outliers"][-1]
        if high["mean_correlation"] - low["mean_correlation"] < SAME_CORRELATION:
            return ["Compare the heads' median torque: a correlation does not see a head that runs at another level."]
        return [f"Lay head {low['head_id']}'s torque beside that of head {high['head_id']} over the same days."]
    if r.tool == "anomalies" and v["counts"]["faults"]:
        return ["See by day whether rejects come together in time."]
    if r.tool == "event_gaps" and v["gaps"]:
        return ["Ask whether the machine stood in the longest gap or its files are missing."]
    if r.tool == "compare_periods":
        out = [f"Look at the gaps in {v['lowest_volume_bucket']['bucket_start']}: how much of the drop is a machine that stood?"] if _lowest(v) else []
        return out + ["Ask what was changed on the line between the buckets that differ."] * (len(_compared(v)) - len(_lowest(v)) > 2)
    if r.tool == "failure_correlation" and v.get("p_value") is not None and v["p_value"] < DRIFT_P:
        return [f"Ask what differs on the line in hour {v['highest']['hour']}: shift, product or material."]
    if r.tool == "idle_periods":
        first = v["by_head"][0]
        return [f"See why head {first['head_id']} ran without load for {first['total_seconds']:,} s."]
    return []


def findings(r: Result) -> list[str]:
    """Sentences about one result."""
    if r.status != OK:
        return [f"{r.tool}: {r.message}"]
    v = r.values
    by = next((f[3:] for f in r.provenance.filters if f.startswith("by=")), "")
    if r.tool == "overview":
        out = [f"{v['capping_operations']:,} capping operations of {len(v['heads'])} heads: {v['successful']:,} successful, {v['failed']:,} failed; {v['no_load_cycles']:,} cycles without load."]
        return out + [f"Doubtful data: {v['null_torque']:,} without torque, {v['invalid_torque']:,} outside the band, {v['counter_resets']:,} counter resets."]
    if r.tool == "success_rates":
        return _success(v, by)
    if r.tool == "torque_stats":
        if isinstance(v, list):
            return _spread(v)
        return [f"Torque {v['mean']:.3f} Nm in the mean, {v['min']:.3f} to {v['max']:.3f}, median {v['median']:.3f}, over {v['n']:,} closures."]
    if r.tool == "capping_speed":
        return [f"{v['mean_pieces_per_hour']:,.1f} pieces per active hour, over {len(v['buckets'])} buckets."]
    if r.tool == "idle_periods":
        x = v["longest_period"]
        return [f"{sum(h['periods'] for h in v['by_head']):,} runs without load, {v['total_idle_seconds']:,} s together; the longest, {x['duration_seconds']:,} s, is of head {x['head_id']} from {x['start']}."]
    if r.tool == "anomalies":
        c = v["counts"]
        out = [f"{c['faults']:,} rejects, {c['threshold_hits']:,} closures outside the band, {c['deviation_hits']:,} far from their head's median."]
        out += [f"{n}: {k:,} rejects." for n, k in sorted(v["faults_by_condition"].items(), key=lambda x: (-x[1], x[0]))[:3]]
        if v["threshold_by_head"]:
            out.append("Most readings outside the band: " + ", ".join(f"head {h['head_id']} with {h['count']:,}" for h in v["threshold_by_head"][:3]) + ".")
        if at_floor := v["deviation_heads_at_floor"]:
            out.append(f"{at_floor} of {v['deviation_heads']} heads vary so little that the least spread in the settings measures them.")
        return out + [f"Heads with another measure than the MAD: {v['deviation_fallbacks']}."] * bool(v["deviation_fallbacks"])
    if r.tool == "trend":
        return _trend(v)
    if r.tool == "head_correlation":
        return [f"Head {v['outliers'][0]['head_id']} is least like the others: mean correlation {v['outliers'][0]['mean_correlation']:.3f}."] if v["outliers"] else ["No two heads can be correlated."]
    if r.tool == "event_gaps":
        x = v["longest_gap"]
        return [f"{v['gap_count']} gaps of more than {v['min_seconds']} s, {v['total_gap_hours']:.2f} h together." + (f" The longest, {x['duration_seconds']:,} s, begins at {x['start']}." if x else "")]
    if r.tool == "compare_periods":
        return _compared(v)
    if r.tool == "closure_filter":
        return _matching(v)
    if r.tool == "failure_correlation":
        if by == "torque":
            out = ["Torque and success are not correlated in these data." if v["correlation"] is None else f"Pearson's r of torque and success is {v['correlation']:.4f}."]
            return out + [f"{z['zone'].capitalize()} the band: {z['rejected']:,} rejects of {z['closures']:,} closures, {_percent(z['reject_rate'])}." for z in v["zones"] if z["closures"]]
        p = v["p_value"]
        return [f"Rejects are most frequent in hour {v['highest']['hour']} ({_percent(v['highest']['reject_rate'])}).", v.get("note") or f"Chi-square {v['chi_square']:.1f} with {v['degrees_of_freedom']} degrees of freedom, p {p:.3g}."]
    return [t["text"] for t in v["topics"]]


def _table(rows: list[dict], most: int = 20) -> list[str]:
    if not rows:
        return []

    def cell(x) -> str:
        return "" if x is None else f"{x:.6g}" if isinstance(x, float) else str(x)

    keys = [k for k, x in rows[0].items() if not isinstance(x, (list, dict))]
    out = ["| " + " | ".join(keys) + " |", "|" + "---|" * len(keys)]
    out += ["| " + " | ".join(cell(r[k]) for k in keys) + " |" for r in rows[:most]]
    return out + [f"({len(rows) - most} more rows)"] * (len(rows) > most)


def tables(r: Result) -> list[str]:
    """The lists of a result as Markdown tables."""
    if r.status != OK:
        return []
    lists = {"": r.values} if isinstance(r.values, list) else {k: v for k, v in r.values.items() if isinstance(v, list) and v and isinstance(v[0], dict)}
    out = []
    for name, rows in lists.items():
        out += [f"### {r.tool} {name}".rstrip(), "", *_table(rows), ""]
    return out


def markdown(run: Execution) -> str:
    done, failed = [r for r in run.results if r.status == OK], [r for r in run.results if r.status != OK]
    out = [f"# {run.plan.goal}", ""] + [run.plan.note, ""] * bool(run.plan.note)
    out += ["## Summary", "", *(f"- {x}" for r in done for x in findings(r)[:1]), ""]
    out += ["## Findings", ""]
    for r in done:
        out += [f"### {r.tool}", "", *(f"- {x}" for x in findings(r)), ""]
    checks = list(dict.fromkeys(x for r in done for x in next_checks(r)))
    out += ["## Next checks", "", *([f"- {x}" for x in checks] or ["- none that these results call for; make the report again next period and compare"]), ""]
    if pictures := figures(run):
        out += ["## Figures", "", *(f"![{name}](figures/{name}.svg)" for name in pictures), ""]
    out += ["## Tables", "", *(x for r in done for x in tables(r))]
    out += ["## Method", "", *dict.fromkeys(f"- {r.tool}: {a}" for r in run.results for a in r.provenance.assumptions), ""]
    out += ["## Limits", "", *([f"- {r.tool}: {r.status}, {r.message}" for r in failed] or ["- every step had an answer"]), ""]
    out += ["## Provenance", "", f"- store: {run.store}", *(f"- step {t['step']}: {t['tool']} {t['args']}, {t['rows_scanned']:,} rows" for t in run.trace), ""]
    return "\n".join(out)


def write(run: Execution, folder: str) -> str:
    """report.md, report.html with its figures in it, trace.json and figures/*.svg in folder, on the driver's disk; the path of the
    first."""
    os.makedirs(os.path.join(folder, "figures"), exist_ok=True)
    text, pictures = markdown(run), figures(run)
    trace = json.dumps({"goal": run.plan.goal, "store": run.store, "steps": run.trace}, default=_plain, indent=1)
    for name, body in ((f"figures/{n}.svg", svg) for n, svg in pictures.items()):
        _put(folder, name, body)
    for name, body in (("report.md", text), ("report.html", html(text, pictures)), ("trace.json", trace)):
        _put(folder, name, body)
    return os.path.join(folder, "report.md")


def _put(folder: str, name: str, body: str) -> None:
    half = os.path.join(folder, f"{name}.part")
    with open(half, "w", encoding="utf-8") as f:
        f.write(body)
    os.replace(half, os.path.join(folder, name))


def _plain(x):
    return x.isoformat() if isinstance(x, (date, datetime)) else str(x)


def html(text: str, pictures: dict[str, str] | None = None) -> str:
    """A page of its own for the Markdown that `markdown` writes: headings, lists, tables, and pictures as they are."""
    from html import escape

    out, open_ = [], ""

    def close(want: str) -> None:
        nonlocal open_
        if open_ != want:
            out.extend([f"</{open_}>"] * bool(open_) + [f"<{want}>"] * bool(want))
            open_ = want

    for line in text.split("\n"):
        if m := re.match(r"(#{1,3}) (.*)", line):
            close("")
            out.append(f"<h{len(m[1])}>{escape(m[2])}</h{len(m[1])}>")
        elif (m := re.match(r"!\[(.*)\]\(", line)) and m[1] in (pictures or {}):
            close("")
            out.append(f"<figure>{pictures[m[1]]}</figure>")
        elif line.startswith("- "):
            close("ul")
            out.append(f"<li>{escape(line[2:])}</li>")
        elif line.startswith("|"):
            close("table")
            if not line.startswith("|---"):
                out.append("<tr>" + "".join(f"<td>{escape(c.strip())}</td>" for c in line.strip("|").split("|")) + "</tr>")
        else:
            close("")
            out.extend([f"<p>{escape(line)}</p>"] * bool(line.strip()))
    close("")
    return "<!doctype html><meta charset=utf-8><title>Report</title>" + "\n".join(out)


_FIGURE = re.compile(r"\d[\d,]*\.?\d*")


def ungrounded(answer: str, run: Execution, question: str = "") -> list[str]:
    """Numbers in a text that are in no finding and not in the question: a written answer with any is not to be shown."""
    known = {x.replace(",", "").rstrip(".") for t in [question, *(s for r in run.results for s in [*findings(r), *next_checks(r)])] for x in _FIGURE.findall(t)}
    return [x for x in _FIGURE.findall(answer) if x.replace(",", "").rstrip(".") not in known]
