"""Charts of collected report rows as SVG text."""

from __future__ import annotations

import xml.etree.ElementTree as Tree


def scale(values: list[float], low: float | None = None, high: float | None = None) -> list[float]:
    """Values within [0, 1]; 0.5 where all are equal."""
    low, high = min(values) if low is None else low, max(values) if high is None else high
    return [0.5 if high <= low else min(max((v - low) / (high - low), 0.0), 1.0) for v in values]


def colour(t: float) -> str:
    """From blue to red."""
    return "#%02x%02x%02x" % (round(40 + 200 * t), round(90 + 60 * (1 - abs(2 * t - 1))), round(220 - 180 * t))


def _add(to: Tree.Element, tag: str, text: str | None = None, **attributes) -> Tree.Element:
    made = Tree.SubElement(to, tag, {k.replace("_", "-"): str(round(v, 2)) if isinstance(v, float) else str(v) for k, v in attributes.items()})
    made.text = text
    return made


def _picture(width: int, height: int) -> Tree.Element:
    return Tree.Element("svg", {"xmlns": "http://www.w3.org/2000/svg", "width": str(width), "height": str(height)})


def group_bar(rows: list[tuple[int, int, int, float]], title: str, width: int = 800, height: int = 90) -> str:
    """One bar, a segment for each group (group_id, ndims, bits, cost) as wide as its places, coloured by cost."""
    svg = _picture(width, height)
    _add(svg, "text", title, x=10, y=20, font_size=13)
    total, at = sum(r[1] for r in rows), 10.0
    for (g, dims, bits, cost), t in zip(rows, scale([r[3] for r in rows])):
        wide = (width - 20) * dims / total
        segment = _add(svg, "rect", x=at, y=30, width=wide, height=40, stroke="white", fill=colour(t))
        _add(segment, "title", f"group {g}: {dims} places, {bits} bits, {cost:g}")
        if wide > 14:
            _add(svg, "text", str(bits), x=at + wide / 2, y=54, fill="white", font_size=11, text_anchor="middle")
        at += wide
    return Tree.tostring(svg, encoding="unicode")


def scatter(points: list[tuple[float, float, str]], line: dict[str, float], width: int = 480, height: int = 360) -> str:
    """Points (x, y, label) and the line of ``metrics.ols`` (slope, intercept, r2)."""
    svg, pad = _picture(width, height), 40
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    place = lambda x, y: (pad + (width - 2 * pad) * scale([x], min(xs), max(xs))[0], height - pad - (height - 2 * pad) * scale([y], min(ys), max(ys))[0])
    for x, y, name in points:
        cx, cy = place(x, y)
        _add(_add(svg, "circle", cx=cx, cy=cy, r=4, fill="steelblue"), "title", f"{name}: {x:g}, {y:g}")
    (x1, y1), (x2, y2) = (place(v, line["slope"] * v + line["intercept"]) for v in (min(xs), max(xs)))
    _add(svg, "line", x1=x1, x2=x2, y1=y1, y2=y2, stroke="crimson")
    _add(svg, "text", f"R2 = {line['r2']:.3f}", x=pad, y=20, font_size=12)
    return Tree.tostring(svg, encoding="unicode")
