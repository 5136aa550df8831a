"""The data-health report as one HTML page, from aggregates of bounded size."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame

from quillspark.operators.health import dead_tickers, summarize, worst_coverage


def _cell(value) -> str:
    return "" if value is None else f"{value:.3f}" if isinstance(value, float) else escape(str(value))


def html_table(df: DataFrame, title: str, most: int) -> str:
    """At most ``most`` rows of a frame, and a line that says so where there are more."""
    rows = df.limit(most + 1).collect()
    head = "".join(f"<th>{escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{_cell(v)}</td>" for v in r) + "</tr>" for r in rows[:most])
    more = f"<p>Only the first {most} are shown.</p>" if len(rows) > most else ""
    return f"<h2>{escape(title)}</h2><table><tr>{head}</tr>{body}</table>{more}"


def html_report(report: DataFrame, as_of: str, *, worst: int = 50, dead: int = 200) -> str:
    """Totals by class, the ``worst`` tickers of each class by coverage, and up to ``dead`` tickers without any bar."""
    classes = [r[0] for r in report.select("asset_class").distinct().orderBy("asset_class").limit(20).collect()]
    parts = [html_table(summarize(report).orderBy("asset_class"), "Coverage by class", 20)]
    for name in classes:
        own = report.where(report["asset_class"].eqNullSafe(name))
        parts.append(html_table(worst_coverage(own, worst), f"Worst coverage: {name}", worst))
    parts.append(html_table(dead_tickers(report).orderBy("asset_class", "ticker"), "Without any bar", dead))
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>Data health</title></head><body><h1>Data health, {escape(as_of)}</h1>{''.join(parts)}</body></html>"
