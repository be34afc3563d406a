"""A picture of methods by panel as SVG, drawn as a tree of elements; and labels of runs."""

from __future__ import annotations

from decimal import ROUND_CEILING, ROUND_FLOOR, Decimal
from xml.etree import ElementTree as ET

#: Marks of groups, as paths around their middle: a square, a diamond, two triangles, a cross.
MARKS = ("M-4,-4h8v8h-8z", "M0,-6l6,6l-6,6l-6,-6z", "M0,-6l6,10h-12z", "M0,6l6,-10h-12z", "M-5,-2h3v-3h4v3h3v4h-3v3h-4v-3h-3z")
_NAMES, _VALUES, _WIDTH, _ROW = 190, 70, 640, 20


def nice_ticks(low: float, high: float, most: int = 7) -> list[float]:
    """At most ``most`` multiples of one step from ``low`` or below to ``high`` or above; the step is the least
    one with a single digit 1, 2 or 5 that needs no more.  Reckoned in decimals, as the values are written."""
    a, b = Decimal(repr(float(low))), Decimal(repr(float(high)))
    if not (a.is_finite() and b.is_finite() and a < b):
        raise ValueError(f"there is no range from {low} to {high}")
    if most < 3:
        raise ValueError("there must be three ticks")
    size = ((b - a) / most).adjusted()
    for step in (Decimal(digit).scaleb(size + e) for e in range(4) for digit in (1, 2, 5)):
        first, last = (int((x / step).to_integral_value(r)) for x, r in ((a, ROUND_FLOOR), (b, ROUND_CEILING)))
        if last - first < most:
            return [float(step * i) for i in range(first, last + 1)]
    raise AssertionError("a step of a hundred times the range needs two ticks")


def by_gain(rows: list[dict], reference: dict) -> list[dict]:
    """Rows by their mean gain over the reference, the best first, equals by name."""
    gain = lambda r: sum(r["values"][p] - v for p, v in reference["values"].items()) / len(reference["values"])
    return sorted(rows, key=lambda r: (-gain(r), r["name"]))


def _checked(rows: list[dict], panels: list[str], groups: list[str], reference: str) -> dict:
    """The reference row; errors for rows without a value or of another group, and for a lost reference."""
    for r in rows:
        if lost := [p for p in panels if r["values"].get(p) is None]:
            raise ValueError(f"{r['name']} has no value for {', '.join(lost)}")
        if r["group"] not in groups:
            raise ValueError(f"{r['name']} is of an unknown group {r['group']}")
    found = [r for r in rows if r["name"] == reference]
    if not found:
        raise ValueError(f"there is no row {reference}")
    return found[0]


def _text(parent: ET.Element, x: float, y: float, words: str, **more: str) -> None:
    ET.SubElement(parent, "text", {"x": f"{x:g}", "y": f"{y:g}", **more}).text = words


def _panel(rows: list[dict], panel: str, groups: list[str], base: dict) -> ET.Element:
    """One panel: for each method a stem from the reference's value to its own, and the value in figures."""
    zero, values = base["values"][panel], [r["values"][panel] for r in rows]
    spread = max(abs(v - zero) for v in values) or 0.05
    ticks = nice_ticks(zero - spread, zero + spread, 6)
    span = _WIDTH - _NAMES - _VALUES
    x = lambda v: round(_NAMES + span * (v - ticks[0]) / (ticks[-1] - ticks[0]), 1)
    g = ET.Element("g", {"class": "panel"})
    _text(g, 0, 14, panel, **{"font-weight": "600"})
    ET.SubElement(g, "path", {"class": "reference", "d": f"M{x(zero)},20v{_ROW * len(rows)}"})
    for i, (r, v) in enumerate(zip(rows, values, strict=True)):
        y = 20 + _ROW * i + _ROW / 2
        _text(g, 0, y + 4, r["name"])
        ET.SubElement(g, "path", {"class": "stem", "d": f"M{x(zero)},{y:g}H{x(v)}"})
        ET.SubElement(g, "path", {"class": "mark", "d": MARKS[groups.index(r["group"]) % len(MARKS)], "transform": f"translate({x(v)},{y:g})"})
        _text(g, _WIDTH - _VALUES + 8, y + 4, f"{v:.4f}" if r is base else f"{v:.4f} ({v - zero:+.4f})")
    foot = 20 + _ROW * len(rows)
    ET.SubElement(g, "path", {"class": "scale", "d": "".join(f"M{x(t)},{foot}v5" for t in ticks)})
    for t in ticks:
        _text(g, x(t), foot + 18, f"{t:g}", **{"text-anchor": "middle"})
    return g


def dot_plot_svg(rows: list[dict], panels: list[str], title: str, reference: str, subtitle: str = "", caption: str = "", groups: list[str] | None = None) -> str:
    """Panels below each other, a line a method with its gain over the row named ``reference``; ``rows``: name,
    group (a shape of the mark), and values by panel.  One ink: the page's own, so it suits any ground."""
    groups = groups or list(dict.fromkeys(r["group"] for r in rows))
    base = _checked(rows, panels, groups, reference)
    each = 20 + _ROW * len(rows) + 40
    height = 66 + 18 * len(groups) + each * len(panels)
    svg = ET.Element("svg", {"xmlns": "http://www.w3.org/2000/svg", "viewBox": f"-10 0 {_WIDTH + 90} {height}", "fill": "currentColor", "stroke-width": "1.5", "font-family": "system-ui, sans-serif", "font-size": "12"})
    ET.SubElement(svg, "style").text = ".stem,.reference,.scale{stroke:currentColor;fill:none}.reference{opacity:.4}"
    _text(svg, 0, 20, title, **{"font-size": "15"})
    _text(svg, 0, 38, subtitle)
    for i, name in enumerate(groups):
        ET.SubElement(svg, "path", {"class": "key", "d": MARKS[i % len(MARKS)], "transform": f"translate(6,{54 + 18 * i})"})
        _text(svg, 18, 58 + 18 * i, name)
    for i, panel in enumerate(panels):
        g = _panel(rows, panel, groups, base)
        g.set("transform", f"translate(0,{54 + 18 * len(groups) + each * i})")
        svg.append(g)
    _text(svg, 0, height - 4, caption)
    return ET.tostring(svg, encoding="unicode")


#: Settings that tell runs of a method apart.
_TELLING = {
    "dense": ("model", "chunk_words", "truncation_rate"),
    "learned-sparse": ("model", "top_terms"),
    "late-interaction": ("model",),
    "rm3": ("fb_docs", "fb_terms", "alpha"),
    "bm25": ("k1", "b", "fields"),
    "rrf": ("k", "retrievers"),
    "rerank": ("model", "depth"),
    "expanded": ("expanded", "query_weight"),
}


def run_label(summary: dict) -> str:
    """A readable label of a run from its summary: its tag or method, and the settings that tell it apart.

    ``summary``: tag (may be empty), and the retriever's description as ``settings``.
    """
    settings = summary.get("settings") or {}
    method = settings.get("method") or settings.get("model") or "run"
    parts = []
    for key in _TELLING.get(method, ()):
        value = settings.get(key)
        if key == "retrievers":
            value = "+".join(str(r.get("method") or r.get("model")) for r in value or [])
        elif isinstance(value, (list, tuple)):
            value = "+".join(map(str, value))
        if value is not None and value != "":
            parts.append(f"truncated {100 * value:.0f} %" if key == "truncation_rate" else f"{key} {value}")
    tokenizer = settings.get("tokenizer") or {}
    if tokenizer:
        parts.append("stemmed" if tokenizer.get("stemmer") else "not stemmed")
    return f"{summary.get('tag') or method} [{method}]" + (f": {', '.join(parts)}" if parts else "")
