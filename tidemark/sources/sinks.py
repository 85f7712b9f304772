"""Sinks: metrics as JSON, tables as Parquet or CSV, and one self-contained HTML report."""

from __future__ import annotations

import html
import json
import math
from pathlib import Path

from pyspark.sql import DataFrame


def write_metrics(path: str, metrics: dict[str, DataFrame | dict | float], most_rows: int = 10_000) -> None:
    """Writes small result tables and numbers as one JSON document; a table of more than ``most_rows`` rows is refused."""
    out = {}
    for name, m in metrics.items():
        if isinstance(m, DataFrame):
            rows = m.limit(most_rows + 1).collect()
            if len(rows) > most_rows:
                raise ValueError(f"{name} has more than {most_rows} rows; write it with write_table")
            m = [r.asDict(recursive=True) for r in rows]
        out[name] = m
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(out, indent=2, default=str))


def write_table(df: DataFrame, path: str, format: str = "parquet", partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").format(format).options(**({"header": "true"} if format == "csv" else {})).partitionBy(*partition_by).save(path)


def read_metrics(path: str) -> dict:
    """Reads a metrics document; a missing file is an error that names it."""
    if not Path(path).exists():
        raise FileNotFoundError(f"no metrics at {path}; run the pipeline first")
    return json.loads(Path(path).read_text())


def svg_lines(rows: list[dict], x: str, y: str, series: str | None = None, width: int = 420, height: int = 220) -> str:
    """A line for each series over numeric ``x``, as a self-contained figure; rows without a number are left out."""
    number = lambda v: isinstance(v, (int, float)) and math.isfinite(v)
    lines: dict[str, list[tuple[float, float]]] = {}
    for r in rows:
        if number(r.get(x)) and number(r.get(y)):
            lines.setdefault(str(r.get(series, "")) if series else "", []).append((float(r[x]), float(r[y])))
    points = [p for line in lines.values() for p in line]
    if not points:
        return "<p>no data</p>"
    (x0, x1), (y0, y1) = ((min(v), max(v)) for v in zip(*points, strict=True))
    at = lambda p: f"{40 + (p[0] - x0) / ((x1 - x0) or 1) * (width - 60):.1f},{height - 30 - (p[1] - y0) / ((y1 - y0) or 1) * (height - 50):.1f}"
    parts = [f"<svg xmlns='http://www.w3.org/2000/svg' viewBox='0 0 {width} {height}' width='{width}'>"]
    for k, (name, line) in enumerate(sorted(lines.items())):
        shade = f"hsl({k * 67 % 360},60%,40%)"
        parts.append(f"<polyline fill='none' stroke='{shade}' points='{' '.join(map(at, sorted(line)))}'><title>{html.escape(name)}</title></polyline>")
        parts.append(f"<text x='{width - 15}' y='{14 + 12 * k}' font-size='10' text-anchor='end' fill='{shade}'>{html.escape(name)}</text>")
    labels = ((40, height - 16, x0), (width - 60, height - 16, x1), (2, height - 30, y0), (2, 20, y1))
    parts += [f"<text x='{a}' y='{b}' font-size='9'>{v:.4g}</text>" for a, b, v in labels]
    parts.append(f"<text x='{width // 2}' y='{height - 4}' font-size='10' text-anchor='middle'>{html.escape(f'{y} by {x}')}</text></svg>")
    return "".join(parts)


def project_report(projects: dict[str, dict], title: str) -> str:
    """One self-contained page with a section for each project: its tables and its figures (``{"tables": {...}, "best": {...},
    "figures": {name: svg}}``)."""
    parts = []
    for name, p in projects.items():
        body = html_report(p.get("tables", {}), name, p.get("best")).split("</h1>", 1)[1]
        figures = "".join(f"<figure>{svg}<figcaption>{html.escape(f)}</figcaption></figure>" for f, svg in p.get("figures", {}).items())
        parts.append(f"<section><h1>{html.escape(name)}</h1>{body}{figures}</section>")
    return f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title>" + "\n".join(parts)


def html_report(metrics: dict, title: str, best: dict[str, tuple[str, bool]] | None = None) -> str:
    """A page with a table for each list of records; ``best``: per table the column by which a row is marked, and whether more is better."""
    parts = [f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"]
    for name, rows in metrics.items():
        parts.append(f"<h2>{html.escape(name.replace('_', ' ').title())}</h2>")
        if not isinstance(rows, list):
            parts.append(f"<p>{html.escape(str(rows))}</p>")
            continue
        cols = list(dict.fromkeys(c for r in rows for c in r))
        col, more = (best or {}).get(name, (None, True))
        values = [r.get(col) for r in rows if r.get(col) is not None]
        top = (max if more else min)(values) if values else None
        cell = lambda v: html.escape(f"{v:.4g}" if isinstance(v, float) else str(v))
        parts.append("<table><tr>" + "".join(f"<th>{html.escape(c)}</th>" for c in cols) + "</tr>")
        for r in rows:
            mark = " class='best'" if top is not None and r.get(col) == top else ""
            parts.append(f"<tr{mark}>" + "".join(f"<td>{cell(r.get(c))}</td>" for c in cols) + "</tr>")
        parts.append("</table>")
    return "\n".join(parts)
