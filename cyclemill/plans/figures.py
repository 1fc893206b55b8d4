"""Figures of results as SVG, written here; no library is needed. Each function gives None for a result that has nothing to show.

One hue for a measure, a second one for what stands out, which is named in words too. Marks tell their values when they
are pointed at. Frames that don't begin at 0 say so. Figures have no random part, so equal results give equal files.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from datetime import datetime, timedelta
from html import escape

from cyclemill.functions.stats import DRIFT_TAU
from cyclemill.plans.execution import Execution
from cyclemill.result import OK, Result

WIDTH, HEIGHT, LEFT, RIGHT, TOP, BOTTOM = 880, 360, 72, 16, 44, 52
SURFACE, INK, SOFT, GRID, BASE = "#fcfcfb", "#0b0b0b", "#52514e", "#e1e0d9", "#a8a79f"
FIRST, SECOND, THIRD, QUIET = "#2a78d6", "#eb6834", "#1baf7a", "#b9b8b0"
#: Bars have gaps, and points of a line have marks, up to so many.
MOST_APART = 120
#: Times have no zone; places on a scale are seconds from here.
ZERO = datetime(1970, 1, 1)


def _n(x: float) -> str:
    return f"{x:.2f}".rstrip("0").rstrip(".")


def _label(x: float) -> str:
    return f"{x:,.0f}" if abs(x) >= 1000 else f"{x:.6g}"


def ticks(low: float, high: float, most: int = 6) -> list[float]:
    """Round numbers from low to high: steps of 1, 2 or 5 times a power of ten."""
    if not high > low:
        return [low]
    rough = (high - low) / most
    power = 10 ** math.floor(math.log10(rough))
    step = next(m * power for m in (1, 2, 5, 10) if m * power >= rough * 0.999)
    return [round(i * step, 12) for i in range(math.ceil(low / step - 1e-9), math.floor(high / step + 1e-9) + 1)]


class Frame:
    """A plot with a title, a scale on each side and marks. The vertical scale may be one of powers of ten."""

    def __init__(self, title: str, across: str, up: str, x: tuple[float, float], y: tuple[float, float], powers: bool = False):
        self.x, self.y, self.powers = x, y, powers
        self.out = [
            f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {WIDTH} {HEIGHT}" width="{WIDTH}" height="{HEIGHT}" role="img" font-family="system-ui, sans-serif" font-size="12">',
            f"<title>{escape(title)}</title>",
            f'<rect width="{WIDTH}" height="{HEIGHT}" fill="{SURFACE}"/>',
            f'<text x="{LEFT}" y="22" font-size="15" font-weight="600" fill="{INK}">{escape(title)}</text>',
            f'<text x="{(LEFT + WIDTH - RIGHT) // 2}" y="{HEIGHT - 10}" text-anchor="middle" fill="{SOFT}">{escape(across)}</text>',
            f'<text x="14" y="{(TOP + HEIGHT - BOTTOM) // 2}" transform="rotate(-90 14 {(TOP + HEIGHT - BOTTOM) // 2})" text-anchor="middle" fill="{SOFT}">{escape(up)}</text>',
        ]
        marks = [10.0**k for k in range(math.floor(math.log10(y[0])), math.ceil(math.log10(y[1])) + 1) if y[0] <= 10.0**k <= y[1]] if powers else ticks(*y)
        for v in marks:
            self.out.append(f'<line x1="{LEFT}" x2="{WIDTH - RIGHT}" y1="{_n(self.up(v))}" y2="{_n(self.up(v))}" stroke="{GRID}"/>')
            self.out.append(f'<text x="{LEFT - 8}" y="{_n(self.up(v) + 4)}" text-anchor="end" fill="{SOFT}">{_label(v)}</text>')
        self.out.append(f'<line x1="{LEFT}" x2="{WIDTH - RIGHT}" y1="{HEIGHT - BOTTOM}" y2="{HEIGHT - BOTTOM}" stroke="{BASE}"/>')

    def across(self, v: float) -> float:
        low, high = self.x
        return LEFT + (WIDTH - RIGHT - LEFT) * ((v - low) / (high - low) if high > low else 0.5)

    def up(self, v: float) -> float:
        low, high = map(math.log10, self.y) if self.powers else self.y
        v = math.log10(v) if self.powers else v
        return HEIGHT - BOTTOM - (HEIGHT - BOTTOM - TOP) * ((min(max(v, low), high) - low) / (high - low) if high > low else 0.5)

    def below(self, at: float, text: str) -> None:
        self.out.append(f'<text x="{_n(at)}" y="{HEIGHT - BOTTOM + 16}" text-anchor="middle" fill="{SOFT}">{escape(text)}</text>')

    def numbers_below(self) -> None:
        for v in ticks(*self.x, most=10):
            self.below(self.across(v), _label(v))

    def times_below(self) -> None:
        for k in range(6):
            at = self.x[0] + (self.x[1] - self.x[0]) * (k + 0.5) / 6
            self.below(self.across(at), (ZERO + timedelta(seconds=at)).strftime("%Y-%m-%d"))

    def bars(self, values: list[float], said: list[str], marked: Iterable[int] = (), centre: float | None = None) -> None:
        """Bars side by side over the whole width, from `centre` or the lower end."""
        wide, marked = (WIDTH - RIGHT - LEFT) / max(1, len(values)), set(marked)
        gap = 2 if len(values) <= MOST_APART else 0
        for i, (v, text) in enumerate(zip(values, said, strict=True)):
            a, b = sorted((self.up(v), self.up(self.y[0] if centre is None else centre)))
            colour = SECOND if i in marked else FIRST
            self.out.append(f'<rect x="{_n(LEFT + i * wide + gap / 2)}" y="{_n(a)}" width="{_n(max(wide - gap, 0.5))}" height="{_n(max(b - a, 0.5))}" fill="{colour}"><title>{escape(text)}</title></rect>')

    def names_below(self, names: list[str]) -> None:
        wide, every = (WIDTH - RIGHT - LEFT) / max(1, len(names)), max(1, -(-len(names) // 24))
        for i in range(0, len(names), every):
            self.below(LEFT + (i + 0.5) * wide, names[i])

    def line(self, points: list[tuple[float, float]], colour: str, width: float = 2, said: str = "") -> None:
        path = " ".join(f"{'L' if i else 'M'}{_n(self.across(a))} {_n(self.up(b))}" for i, (a, b) in enumerate(points))
        self.out.append(f'<path d="{path}" fill="none" stroke="{colour}" stroke-width="{width:g}" stroke-linejoin="round"><title>{escape(said)}</title></path>')

    def level(self, v: float, text: str) -> None:
        """A dashed line over the whole width, with its meaning."""
        at = self.up(v)
        self.out.append(f'<line x1="{LEFT}" x2="{WIDTH - RIGHT}" y1="{_n(at)}" y2="{_n(at)}" stroke="{SOFT}" stroke-dasharray="5 4"/>')
        self.out.append(f'<text x="{WIDTH - RIGHT - 4}" y="{_n(at - 5)}" text-anchor="end" fill="{INK}">{escape(text)}</text>')

    def dots(self, points: list[tuple[float, float, str]], colour: str) -> None:
        self.out += [f'<circle cx="{_n(self.across(a))}" cy="{_n(self.up(b))}" r="4" fill="{colour}" stroke="{SURFACE}"><title>{escape(t)}</title></circle>' for a, b, t in points]

    def legend(self, entries: list[tuple[str, str]]) -> None:
        at = LEFT
        for colour, name in entries:
            self.out.append(f'<rect x="{at}" y="30" width="10" height="10" rx="2" fill="{colour}"/><text x="{at + 15}" y="39" fill="{SOFT}">{escape(name)}</text>')
            at += 40 + 7 * len(name)

    def done(self) -> str:
        return "\n".join([*self.out, "</svg>"]) + "\n"


def _at(t: datetime) -> float:
    return (t - ZERO).total_seconds()


def _by(r: Result) -> str:
    return next((f[3:] for f in r.provenance.filters if f.startswith("by=")), "")


def _times(points: list[datetime]) -> tuple[float, float]:
    low, high = _at(min(points)), _at(max(points))
    return (low, high) if high > low else (low - 43200, high + 43200)


def success_by_head(r: Result) -> str | None:
    """Bars of the rates, the lowest marked. Near 100 % the frame is cut, so that heads can be told apart, and says so."""
    if r.tool != "success_rates" or _by(r) != "head":
        return None
    rows = [v for v in r.values if v["success_rate"] is not None]
    if not rows:
        return None
    rates = [100 * v["success_rate"] for v in rows]
    lowest = rates.index(min(rates))
    floor = max(0.0, min(rates) - (100 - min(rates)) / 2 - 0.01)
    frame = Frame("Success rate by head" + (f" (scale from {floor:.3f} % to 100 %)" if floor else ""), "head", "success rate (%)", (0, 1), (floor, 100.0))
    frame.bars(rates, [f"head {v['head_id']}: {x:.3f} %, {v['successful']:,} of {v['successful'] + v['failed']:,}" for v, x in zip(rows, rates, strict=True)], [lowest])
    frame.names_below([str(v["head_id"]) for v in rows])
    frame.legend([(FIRST, "success rate"), (SECOND, f"lowest: head {rows[lowest]['head_id']}, {rates[lowest]:.3f} %")])
    return frame.done()


def rejects_by_day(r: Result) -> str | None:
    """Bars of failed closures, the day with the most marked."""
    if r.tool != "success_rates" or _by(r) != "day" or not any(v["failed"] for v in r.values):
        return None
    failed = [v["failed"] for v in r.values]
    most = failed.index(max(failed))
    frame = Frame("Failed closures by day", "day", "failed closures", (0, 1), (0, max(failed)))
    frame.bars(failed, [f"{v['day']}: {v['failed']:,} of {v['total']:,}" for v in r.values], [most])
    frame.names_below([str(v["day"])[5:] for v in r.values])
    frame.legend([(FIRST, "failed closures"), (SECOND, f"most: {r.values[most]['day']}, {failed[most]:,}")])
    return frame.done()


def speed(r: Result) -> str | None:
    """Pieces an hour over time, and the mean of the buckets with an operation."""
    if r.tool != "capping_speed":
        return None
    rows = r.values["buckets"]
    points = [(_at(b["bucket_start"]), b["pieces_per_hour"]) for b in rows]
    frame = Frame("Capping speed", "time", "pieces per hour", _times([b["bucket_start"] for b in rows]), (0, max(p for _, p in points) * 1.08))
    frame.line(points, FIRST, said="pieces per hour")
    if len(points) <= MOST_APART:
        frame.dots([(a, b, f"{row['bucket_start']}: {b:,.1f} pieces per hour") for (a, b), row in zip(points, rows, strict=True)], FIRST)
    mean = r.values["mean_pieces_per_hour"]
    frame.level(mean, f"mean {mean:,.1f}")
    frame.times_below()
    return frame.done()


def rolling_mean(r: Result) -> str | None:
    """A line for each head; those that drift most are drawn in colour and named, the others stay behind."""
    if r.tool != "trend" or not any(v["rolling_mean"] is not None for v in r.values["series"]):
        return None
    lines: dict[int, list[tuple[float, float]]] = {}
    for v in r.values["series"]:
        if v["rolling_mean"] is not None:
            lines.setdefault(v["head_id"], []).append((_at(v["bucket"]), v["rolling_mean"]))
    every = [y for p in lines.values() for _, y in p]
    room = (max(every) - min(every)) * 0.05 or 0.01
    what = next((f[7:] for f in r.provenance.filters if f.startswith("signal=")), "torque")
    frame = Frame(f"Rolling mean of {what.replace('_', ' ')} by head", "time", "torque (Nm)" if what == "torque" else what.replace("_", " "), _times([v["bucket"] for v in r.values["series"]]), (min(every) - room, max(every) + room))
    moving = [d["head_id"] for d in r.values["drift"] if d["drifting"] and d["head_id"] in lines]
    named = dict(zip(moving, (SECOND, FIRST, THIRD), strict=False))
    for head in [h for h in sorted(lines) if h not in named] + [h for h in moving if h in named]:
        frame.line(lines[head], named.get(head, QUIET), 2 if head in named else 1, f"head {head}")
    frame.legend([*((c, f"head {h}, drifting") for h, c in named.items()), *([(QUIET, "other heads")] if len(named) < len(lines) else [])])
    frame.times_below()
    return frame.done()


def drift(r: Result) -> str | None:
    """Heads by Kendall's tau, the strongest first; those with a verdict of drifting marked, the limits drawn."""
    if r.tool != "trend":
        return None
    rows = sorted((d for d in r.values["drift"] if not d["insufficient"]), key=lambda d: (-abs(d["tau"]), d["head_id"]))
    if not rows:
        return None
    frame = Frame("Drift by head", "head, strongest first", "Kendall's tau", (0, 1), (-1.0, 1.0))
    frame.bars([d["tau"] for d in rows], [f"head {d['head_id']}: tau {d['tau']:.3f}, p {d['p_value']:.3g}, {d['n_buckets']} buckets" for d in rows], [i for i, d in enumerate(rows) if d["drifting"]], centre=0.0)
    for limit in (DRIFT_TAU, -DRIFT_TAU):
        frame.level(limit, f"limit {limit:+g}")
    frame.names_below([str(d["head_id"]) for d in rows])
    frame.legend([(FIRST, "no drift"), (SECOND, "drifting")])
    return frame.done()


def anomalies(r: Result) -> str | None:
    """The listed closures over time, a colour for each reason. The title says how many of all are listed."""
    if r.tool != "anomalies":
        return None
    kinds = [("faults", "reject", SECOND), ("threshold_hits", "outside the band", THIRD), ("deviation_hits", "far from the head's median", FIRST)]
    rows = {k: [x for x in r.values[k] if x["app_torque"] is not None] for k, *_ in kinds}
    every = [x for v in rows.values() for x in v]
    if not every:
        return None
    torque = [x["app_torque"] for x in every]
    room = (max(torque) - min(torque)) * 0.05 or 0.1
    listed, total = sum(r.values["listed"].values()), sum(r.values["counts"].values())
    frame = Frame("Anomalies over time" + (f" (a sample, {listed:,} of {total:,})" if listed < total else ""), "time", "torque (Nm)", _times([x["ts"] for x in every]), (min(torque) - room, max(torque) + room))
    for key, _, colour in reversed(kinds):
        frame.dots([(_at(x["ts"]), x["app_torque"], f"head {x['head_id']}, {x['ts']}: {x['app_torque']:.3f} Nm, {x['reason']}") for x in rows[key]], colour)
    frame.legend([(c, f"{name} ({r.values['counts'][key]:,})") for key, name, c in kinds])
    frame.times_below()
    return frame.done()


def torque_histogram(r: Result) -> str | None:
    """Closures by torque, on a scale of powers of ten, as the tails are what matters."""
    if r.tool != "torque_stats" or isinstance(r.values, list) or not r.values["histogram"]:
        return None
    wide = r.values["histogram_bin_width"]
    rows = {round(b["bin_start"] / wide): b["count"] for b in r.values["histogram"]}
    low, high = min(rows), max(rows) + 1
    frame = Frame("Closures by torque", "torque (Nm)", "closures, powers of ten", (low * wide, high * wide), (0.5, max(2, max(rows.values()) * 1.3)), powers=True)
    one = (WIDTH - RIGHT - LEFT) / (high - low)
    for k, n in sorted(rows.items()):
        frame.out.append(f'<rect x="{_n(frame.across(k * wide))}" y="{_n(frame.up(n))}" width="{_n(max(one - (one > 4), 0.5))}" height="{_n(HEIGHT - BOTTOM - frame.up(n))}" fill="{FIRST}"><title>{k * wide:.2f} Nm: {n:,}</title></rect>')
    frame.numbers_below()
    return frame.done()


def rejects_by_hour(r: Result) -> str | None:
    """Rejects of 100,000 closures in each hour of the day, and the rate of all."""
    if r.tool != "failure_correlation" or "hours" not in r.values or not r.values["rejected"]:
        return None
    rows = {h["hour"]: h for h in r.values["hours"]}
    rates = [100_000 * rows[h]["reject_rate"] if h in rows else 0.0 for h in range(24)]
    said = [f"{h:02d} h: {rows[h]['rejected']:,} of {rows[h]['closures']:,}" if h in rows else f"{h:02d} h: no closures" for h in range(24)]
    frame = Frame("Rejects by hour of the day", "hour", "rejects of 100,000 closures", (0, 1), (0, max(rates) * 1.08))
    frame.bars(rates, said, [r.values["highest"]["hour"]])
    frame.level(100_000 * r.values["reject_rate"], f"all hours {100_000 * r.values['reject_rate']:,.1f}")
    frame.names_below([str(h) for h in range(24)])
    return frame.done()


FIGURES: dict[str, Callable[[Result], str | None]] = {f.__name__: f for f in (success_by_head, rejects_by_day, speed, rolling_mean, drift, anomalies, torque_histogram, rejects_by_hour)}


def figures(run: Execution) -> dict[str, str]:
    """All figures of a run by file name, in the order of its steps. A later step's figure of a name gets a number."""
    out: dict[str, str] = {}
    for r in run.results:
        if r.status != OK:
            continue
        for name, make in FIGURES.items():
            if (svg := make(r)) is not None:
                again = sum(k.split("-")[0] == name for k in out)
                out[f"{name}-{again + 1}" if again else name] = svg
    return out
