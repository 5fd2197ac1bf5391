"""Writing: tables, appended runs, one text a row, JSON, LaTeX and printed reports."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overwrite_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def overwrite(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def text_per_row(df: DataFrame, path: str, name: str, body: str) -> None:
    """A folder for each row's name with its text, through Spark's own writer, so any shared file system will do."""
    df.select(F.col(name).alias("name"), F.col(body).alias("value")).repartition("name").write.mode("overwrite").partitionBy("name").text(path, lineSep="\n")


def pretty_json(value: dict, path: str) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(value, f, indent=2, ensure_ascii=False)
        f.write("\n")


def rates_json(rates: DataFrame, source: dict[str, str], caveats: list[str], path: str) -> None:
    """Error rates (a row a variable) as one document."""
    rows = [r.asDict(recursive=True) for r in rates.orderBy("variable").collect()]
    pretty_json({"source": source, "caveats": caveats, "variables": {r.pop("variable"): r for r in rows}}, path)


_ESCAPES = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}"}


def cell(value, digits: int = 3, missing: str = "--") -> str:
    if value is None or value != value:
        return missing
    if isinstance(value, bool):
        return "yes" if value else "no"
    return f"{value:.{digits}f}" if isinstance(value, float) else f"{value:,}" if isinstance(value, int) else "".join(_ESCAPES.get(c, c) for c in str(value))


def latex(df: DataFrame, columns: dict[str, str], caption: str, label: str, digits: int = 3, stars: str | None = None) -> str:
    """A booktabs table of a small frame; ``stars`` names a column whose marks follow the first number."""
    rows = df.collect()
    out = [r"\begin{table}[htbp]", r"\centering", rf"\caption{{{cell(caption)}}}", rf"\label{{{label}}}", rf"\begin{{tabular}}{{l{'r' * (len(columns) - 1)}}}", r"\toprule", " & ".join(cell(h) for h in columns.values()) + r" \\", r"\midrule"]
    for r in rows:
        cells = [cell(r[c], digits) for c in columns]
        if stars and r[stars]:
            first = next(i for i, c in enumerate(columns) if isinstance(r[c], float))
            cells[first] += f"$^{{{r[stars]}}}$"
        out.append(" & ".join(cells) + r" \\")
    return "\n".join([*out, r"\bottomrule", r"\end{tabular}", r"\end{table}", ""])


def report(df: DataFrame, title: str, digits: int = 3, rows: int = 50) -> str:
    """A small frame as aligned text."""
    got = df.limit(rows).collect()
    table = [df.columns, *[[cell(v, digits) for v in r] for r in got]]
    widths = [max(len(str(r[i])) for r in table) for i in range(len(df.columns))]
    return "\n".join([title, "=" * len(title), *["  ".join(str(v).rjust(w) for v, w in zip(r, widths, strict=True)) for r in table], ""])


def svg_lines(df: DataFrame, x: str, ys: list[str], title: str, path: str, width: int = 800, height: int = 320) -> None:
    """A line chart of a small frame, as SVG: no plotting library is needed. Missing values break a line."""
    rows = df.orderBy(x).select(x, *ys).collect()
    values = [float(r[y]) for r in rows for y in ys if r[y] is not None and r[y] == r[y]]
    low, high = (min(values), max(values)) if values else (0.0, 1.0)
    pad, span = 40, (high - low) or 1.0
    at = lambda i, v: (pad + i * (width - 2 * pad) / max(len(rows) - 1, 1), height - pad - (v - low) * (height - 2 * pad) / span)
    ink = ["#1b5e9e", "#c2571a", "#2e7d4f", "#7a4fa3", "#8a6d1d", "#5b6770"]
    esc = lambda t: str(t).replace("&", "&amp;").replace("<", "&lt;")
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" font-family="sans-serif" font-size="11">', f'<text x="{pad}" y="18" font-size="13">{esc(title)}</text>']
    out += [f'<text x="2" y="{at(0, v)[1]:.1f}">{v:.3g}</text>' for v in (low, high)]
    if rows:
        out += [f'<text x="{pad}" y="{height - 12}">{esc(rows[0][x])}</text>', f'<text x="{width - pad}" y="{height - 12}" text-anchor="end">{esc(rows[-1][x])}</text>']
    for k, y in enumerate(ys):
        d, pen = "", False
        for i, r in enumerate(rows):
            ok = r[y] is not None and r[y] == r[y]
            if ok:
                px, py = at(i, float(r[y]))
                d += f"{'L' if pen else 'M'}{px:.1f},{py:.1f} "
            pen = ok
        colour = ink[k % len(ink)]
        out += [f'<path d="{d.strip()}" fill="none" stroke="{colour}" stroke-width="1.5"/>', f'<text x="{width - pad - 120}" y="{18 + 13 * k}" fill="{colour}">{esc(y)}</text>']
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join([*out, "</svg>", ""]))
