"""Charts as SVG text, from small tables: bars of a histogram or of classes, a curve, boxes, a heat map."""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH, HEIGHT, EDGE = 640, 400, 50


def _svg(title: str, body: list[str]) -> str:
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{WIDTH}" height="{HEIGHT}" font-family="sans-serif" font-size="11"><rect width="100%" height="100%" fill="white"/><text x="{WIDTH / 2}" y="24" text-anchor="middle" font-size="15">{html.escape(title)}</text>{"".join(body)}</svg>'


def _scale(low: float, high: float, begin: float, end: float):
    return lambda v: begin + (end - begin) * ((v - low) / (high - low) if high > low else 0.5)


def bars(title: str, labels: list[str], values: list[float], colour: str = "#4878a8") -> str:
    n, top = max(1, len(values)), max([*values, 0]) or 1
    y, step = _scale(0, top, HEIGHT - EDGE, EDGE), (WIDTH - 2 * EDGE) / n
    body = [f'<rect x="{EDGE + i * step:.1f}" y="{y(v):.1f}" width="{max(step - 2, 1):.1f}" height="{HEIGHT - EDGE - y(v):.1f}" fill="{colour}" data-value="{v:.6g}"/>' for i, v in enumerate(values)]
    shown = range(0, n, max(1, n // 10))
    body += [f'<text x="{EDGE + (i + 0.5) * step:.1f}" y="{HEIGHT - EDGE + 16}" text-anchor="middle">{html.escape(labels[i])}</text>' for i in shown if i < len(labels)]
    return _svg(title, [*body, f'<text x="{EDGE - 6}" y="{EDGE}" text-anchor="end">{top:g}</text>'])


def line(title: str, points: list[tuple[float, float]], diagonal: bool = False) -> str:
    x, y = _scale(0, 1, EDGE, WIDTH - EDGE), _scale(0, 1, HEIGHT - EDGE, EDGE)
    path = " ".join(f"{x(a):.1f},{y(b):.1f}" for a, b in points)
    cross = [f'<line x1="{x(0)}" y1="{y(0)}" x2="{x(1)}" y2="{y(1)}" stroke="#999" stroke-dasharray="4"/>'] if diagonal else []
    return _svg(title, [f'<rect x="{EDGE}" y="{EDGE}" width="{WIDTH - 2 * EDGE}" height="{HEIGHT - 2 * EDGE}" fill="none" stroke="#333"/>', *cross, f'<polyline points="{path}" fill="none" stroke="#b04848" stroke-width="2"/>'])


def histogram_plot(binned: DataFrame, title: str) -> str:
    """From (bin, n)."""
    rows = binned.orderBy("bin").collect()  # a row a bin
    return bars(title, [str(r["bin"]) for r in rows], [float(r["n"]) for r in rows])


def class_plot(classes: DataFrame, label: str, title: str) -> str:
    """From (label, n)."""
    rows = classes.orderBy(label).collect()  # a row a class
    return bars(title, [str(r[label]) for r in rows], [float(r["n"]) for r in rows])


def roc_plot(curve: DataFrame, title: str, most: int = 500) -> str:
    """From (prob, pos, neg, tp, fp); the points are thinned to about `most` steps of the false positives' rate."""
    total = curve.agg(F.max("tp").alias("p"), F.max("fp").alias("n"))
    rates = curve.crossJoin(F.broadcast(total)).select((F.col("fp") / F.greatest("n", F.lit(1))).alias("x"), (F.col("tp") / F.greatest("p", F.lit(1))).alias("y"))
    rows = rates.groupBy(F.floor(F.col("x") * most).alias("step")).agg(F.max("x").alias("x"), F.max("y").alias("y")).orderBy("x", "y").collect()
    return line(title, [(0.0, 0.0), *((r["x"], r["y"]) for r in rows)], diagonal=True)


def box_plot(boxes: DataFrame, title: str) -> str:
    """From (column, q1, median, q3, low, high): each column on its own scale between its fences."""
    rows = boxes.orderBy("column").collect()  # a row a column
    step, body = (HEIGHT - 2 * EDGE) / max(1, len(rows)), []
    for i, r in enumerate(rows):
        x, at = _scale(r["low"], r["high"], EDGE + 90, WIDTH - EDGE), EDGE + (i + 0.5) * step
        body.append(f'<text x="{EDGE + 80}" y="{at + 4:.1f}" text-anchor="end">{html.escape(r["column"])}</text><line x1="{x(r["low"]):.1f}" x2="{x(r["high"]):.1f}" y1="{at:.1f}" y2="{at:.1f}" stroke="#333"/>')
        body.append(f'<rect x="{x(r["q1"]):.1f}" width="{x(r["q3"]) - x(r["q1"]):.1f}" y="{at - step / 4:.1f}" height="{step / 2:.1f}" fill="#a8c4e0" stroke="#333"/><line x1="{x(r["median"]):.1f}" x2="{x(r["median"]):.1f}" y1="{at - step / 4:.1f}" y2="{at + step / 4:.1f}" stroke="#b04848"/>')
    return _svg(title, body)


def confusion_plot(confusion: DataFrame, title: str, label: str = "label", pred: str = "pred") -> str:
    """From (label, pred, n): a square for each pair, darker for more."""
    found = {(r[label], r[pred]): r["n"] for r in confusion.collect()}  # a row a pair of classes
    names = sorted({k for pair in found for k in pair})
    side, top = min((WIDTH - 2 * EDGE), (HEIGHT - 2 * EDGE)) / max(1, len(names)), max([*found.values(), 1])
    body = []
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            n = found.get((a, b), 0)
            x, y = EDGE + 80 + j * side, EDGE + i * side
            body.append(f'<rect x="{x:.1f}" y="{y:.1f}" width="{side:.1f}" height="{side:.1f}" fill="#4878a8" fill-opacity="{n / top:.3f}" stroke="#333"/><text x="{x + side / 2:.1f}" y="{y + side / 2:.1f}" text-anchor="middle">{n}</text>')
        body.append(f'<text x="{EDGE + 70}" y="{EDGE + (i + 0.5) * side:.1f}" text-anchor="end">{html.escape(str(a))}</text><text x="{EDGE + 80 + (i + 0.5) * side:.1f}" y="{EDGE + len(names) * side + 16:.1f}" text-anchor="middle">{html.escape(str(a))}</text>')
    return _svg(title, body)


def _curve(points: list[tuple[float, float]], colour: str = "#b04848") -> str:
    return f'<polyline points="{" ".join(f"{a:.1f},{b:.1f}" for a, b in points)}" fill="none" stroke="{colour}" stroke-width="2"/>'


def density_plot(binned: DataFrame, density: DataFrame, title: str) -> str:
    """Bars of (bin, n) with the curve of (point, x, density) over them, both on the same range, the curve on its own scale."""
    rows = density.orderBy("point").collect()  # a row a point
    top = max([r["density"] for r in rows], default=1.0)
    x, y = _scale(0, max(1, len(rows) - 1), EDGE, WIDTH - EDGE), _scale(0, top, HEIGHT - EDGE, EDGE)
    return histogram_plot(binned, title).replace("</svg>", _curve([(x(i), y(r["density"])) for i, r in enumerate(rows)]) + "</svg>")


def paired_bars(title: str, labels: list[str], first: list[float], second: list[float], names: tuple[str, str]) -> str:
    """Two bars for each label, the second one in front and narrower."""
    top = max([*first, *second, 0]) or 1
    y, step = _scale(0, top, HEIGHT - EDGE, EDGE), (WIDTH - 2 * EDGE) / max(1, len(labels))
    body = [f'<text x="{WIDTH - EDGE}" y="{EDGE - 8}" text-anchor="end">{html.escape(names[0])} (wide), {html.escape(names[1])} (narrow)</text>']
    for i, name in enumerate(labels):
        for v, colour, share in ((first[i], "#4878a8", 0.9), (second[i], "#e0a050", 0.4)):
            body.append(f'<rect x="{EDGE + (i + 0.5 - share / 2) * step:.1f}" y="{y(v):.1f}" width="{step * share:.1f}" height="{HEIGHT - EDGE - y(v):.1f}" fill="{colour}" data-value="{v:.6g}"/>')
        body.append(f'<text x="{EDGE + (i + 0.5) * step:.1f}" y="{HEIGHT - EDGE + 16}" text-anchor="middle">{html.escape(name)}</text>')
    return _svg(title, body)


def benford_plot(digits: DataFrame, title: str) -> str:
    """From (digit, observed, expected)."""
    rows = digits.orderBy("digit").collect()  # nine rows
    return paired_bars(title, [str(r["digit"]) for r in rows], [float(r["observed"]) for r in rows], [float(r["expected"]) for r in rows], ("observed", "expected"))


def metric_plot(metrics: DataFrame, title: str, name: str = "model", columns: tuple[str, str] = ("auc", "ap")) -> str:
    """Two metrics of each model, side by side, the models in the order of their names."""
    rows = metrics.orderBy(name).collect()  # a row a model
    return paired_bars(title, [str(r[name]) for r in rows], *([float(r[c] or 0) for r in rows] for c in columns), columns)


def pr_plot(curve: DataFrame, title: str, most: int = 500) -> str:
    """From (prob, pos, neg, tp, fp): precision over recall, thinned to about `most` steps of recall."""
    total = curve.agg(F.max("tp").alias("p"))
    rates = curve.crossJoin(F.broadcast(total)).select((F.col("tp") / F.greatest("p", F.lit(1))).alias("x"), (F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1))).alias("y"))  # one row of totals
    rows = rates.groupBy(F.floor(F.col("x") * most).alias("step")).agg(F.max_by("x", "x").alias("x"), F.max_by("y", "x").alias("y")).orderBy("x").collect()
    return line(title, [(r["x"], r["y"]) for r in rows])


def pair_plot(sample: DataFrame, columns: list[str], densities: dict[str, DataFrame], title: str, label: str | None = None) -> str:
    """Each column against each other, from a sample of bounded size, coloured by label; densities on the diagonal."""
    rows = sample.collect()  # bounded by pair_sample()
    side, colours = (min(WIDTH, HEIGHT) - 2 * EDGE) / max(1, len(columns)), ("#4878a8", "#b04848", "#60a060", "#a070b0")
    classes = sorted({str(r[label]) for r in rows}) if label else []
    body = []
    for i, a in enumerate(columns):
        for j, b in enumerate(columns):
            left, top = EDGE + j * side, EDGE + i * side
            body.append(f'<rect x="{left:.1f}" y="{top:.1f}" width="{side:.1f}" height="{side:.1f}" fill="none" stroke="#333"/>')
            if i == j:
                curve = densities[a].orderBy("point").collect()  # a row a point
                x, y = _scale(0, max(1, len(curve) - 1), left, left + side), _scale(0, max([r["density"] for r in curve], default=1.0), top + side, top + 4)
                body.append(_curve([(x(k), y(r["density"])) for k, r in enumerate(curve)]))
                continue
            held = [(r[b], r[a], str(r[label]) if label else "") for r in rows if r[a] is not None and r[b] is not None]
            x, y = (_scale(min((h[k] for h in held), default=0), max((h[k] for h in held), default=1), *ends) for k, ends in ((0, (left + 3, left + side - 3)), (1, (top + side - 3, top + 3))))
            body += [f'<circle cx="{x(u):.1f}" cy="{y(v):.1f}" r="1.5" fill="{colours[classes.index(c) % len(colours)] if label else colours[0]}"/>' for u, v, c in held]
    return _svg(title, body)


def values(svg: str) -> list[float]:
    """The numbers behind a chart's bars, in order."""
    return [float(x) for x in re.findall(r'data-value="([^"]+)"', svg)]
