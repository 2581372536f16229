"""Chart-ready data: grouped sums, stacks, ordered lines, cross-tabs, correlations.

Transforms stay DataFrames; ``figure`` collects an aggregate of at most ``cap``
rows into a plain description of a figure.
"""

from __future__ import annotations

import re
from datetime import datetime
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.calendar import month_order, quarter_order
from ..functions.naming import is_percentage, measure_label

KINDS = ("bar", "line", "scatter", "heatmap")
CAP = 10_000


def category_order(label: str, kind: T.DataType) -> list[Column]:
    """Chronological for quarters, months and times; otherwise by value."""
    c = F.col(f"`{label}`")
    if isinstance(kind, T.StringType):
        when = F.try_to_timestamp(c)
        return [quarter_order(c).asc_nulls_last(), month_order(c).asc_nulls_last(), when.asc_nulls_last(), c.asc_nulls_last()]
    return [c.asc_nulls_last()]


def is_temporal(df: DataFrame, column: str) -> bool:
    kind = df.schema[column].dataType
    if isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType):
        return True
    if not isinstance(kind, T.StringType):
        return False
    c = F.col(f"`{column}`")
    seen = df.where(c.isNotNull()).select(c.alias("v")).limit(10)
    told = seen.agg(F.count("*").alias("n"), F.count(F.coalesce(F.try_to_timestamp("v").cast("string"), quarter_order(F.col("v")).cast("string"), month_order(F.col("v")).cast("string"))).alias("m")).first()
    return told.n > 0 and told.n == told.m


def group_sum(df: DataFrame, x: str, y: str, color: str | None = None) -> DataFrame:
    """Sum of y by x (and color); null keys are left out, a group of nulls sums to 0."""
    keys = [x, *([color] if color else [])]
    kept = df.where(" and ".join(f"`{k}` is not null" for k in keys))
    return kept.groupBy(*(F.col(f"`{k}`").alias(k) for k in keys)).agg(F.coalesce(F.sum(f"`{y}`"), F.lit(0)).alias(y))


def with_totals(grouped: DataFrame, x: str, y: str) -> DataFrame:
    """Each category's total over all colors, and its place by it (1 is the largest)."""
    totals = grouped.groupBy(x).agg(F.sum(y).alias("category_total"))
    ranked = totals.withColumn("category_rank", F.row_number().over(Window.orderBy(F.col("category_total").desc(), x)).cast("long"))
    return grouped.join(ranked, x)


#: Values of y that a cross table may have.
MOST_AXIS = 10_000


def cross_tab(df: DataFrame, x: str, y: str, most: int = MOST_AXIS) -> DataFrame:
    """Counts of each (y, x) pair in long form, 0 where there is none.

    The values of y are read first; more than ``most`` raise.  Each x is then
    given the values that it lacks, where it lies.
    """
    a, b = F.col(f"`{x}`"), F.col(f"`{y}`")
    kept = df.where(a.isNotNull() & b.isNotNull())
    axis = sorted(r[0] for r in kept.select(b.alias(y)).distinct().limit(most + 1).collect())
    if len(axis) > most:
        raise ValueError(f"more than {most} values of {y}; aggregate first")
    cells = kept.groupBy(a.alias(x), b.alias(y)).agg(F.count("*").alias("n"))
    if not axis:
        return cells
    there = F.filter(F.array(*map(F.lit, axis)), lambda v: ~F.array_contains(F.col("__ys"), v))
    empty = cells.groupBy(a.alias(x)).agg(F.collect_set(b).alias("__ys")).select(a.alias(x), F.explode(there).alias(y), F.lit(0).cast("long").alias("n"))
    return cells.unionByName(empty)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def correlations(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(col_a, col_b, r) of all pairs, from one aggregation; each pair over the rows that have both."""
    names = columns or numeric_columns(df)
    pairs = list(combinations(names, 2))
    both = lambda a, b: F.col(f"`{a}`").isNotNull() & F.col(f"`{b}`").isNotNull()
    exprs = [F.corr(F.when(both(a, b), F.col(f"`{a}`").cast("double")), F.when(both(a, b), F.col(f"`{b}`").cast("double"))).alias(f"r{n}") for n, (a, b) in enumerate(pairs)]
    rows = [F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"r{n}").alias("r")) for n, (a, b) in enumerate(pairs)]
    rows += [F.struct(F.lit(b).alias("col_a"), F.lit(a).alias("col_b"), F.col(f"r{n}").alias("r")) for n, (a, b) in enumerate(pairs)]
    rows += [F.struct(F.lit(a).alias("col_a"), F.lit(a).alias("col_b"), F.lit(1.0).alias("r")) for a in names]
    return df.agg(*exprs or [F.count("*")]).select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def ordered(df: DataFrame, x: str, sort_by: str | None = None, descending: bool = False) -> DataFrame:
    by = sort_by or x
    if by not in df.columns:
        raise ValueError(f"cannot sort by {by!r}: the columns are {', '.join(df.columns)}")
    keys = category_order(by, df.schema[by].dataType)
    plain = F.col(f"`{by}`")
    return df.orderBy(*(keys[:-1] if descending else keys), *([plain.desc_nulls_last()] if descending else []))


# ---- figures --------------------------------------------------------------------------------


#: Titles, the figure's settings, and its margins and legend beside or above the plot.
TITLES = {"bar": "{y} by {x}{stacked}", "line": "{y} over {x}", "lines": "Comparison of {y} over {x}", "scatter": "{y} vs {x}", "heatmap": "Heatmap of {x}{and_y}"}
CONFIG = {"displayModeBar": True, "responsive": True, "scrollZoom": True, "displaylogo": False, "modeBarButtonsToRemove": ["lasso2d", "select2d"]}
BESIDE = {"margin": {"b": 100, "t": 60, "l": 60, "r": 200}, "legend": {"orientation": "v", "yanchor": "middle", "y": 0.5, "xanchor": "left", "x": 1.02}}
ABOVE = {"margin": {"b": 100, "t": 120, "l": 60, "r": 60}, "legend": {"orientation": "h", "yanchor": "bottom", "y": 1.0, "xanchor": "center", "x": 0.5}}
LONG_LABEL, MANY_LABELS, TILT = 10, 8, 45


def default_title(kind: str, x: str, y: str | list[str] | None, color: str | None, style: str) -> str:
    several = isinstance(y, list)
    words = {"x": x, "y": ", ".join(y) if several else y or "Count", "stacked": f" (stacked by {color})" if color and style == "stacked" else "", "and_y": f" and {y}" if y else ""}
    return TITLES["lines" if several and kind == "line" else kind].format(**words)


def check(df: DataFrame, kind: str, x: str, y: str | list[str] | None) -> str | None:
    """What is wrong with a request, or None."""
    if kind not in KINDS:
        return f"chart type {kind!r} is not one of {', '.join(KINDS)}"
    if isinstance(y, list) and kind != "line":
        return "several measures are for line charts only"
    lacking = [c for c in [x, *([y] if isinstance(y, str) else y or [])] if c not in df.columns]
    if lacking:
        return f"no column {', '.join(lacking)}; the columns are {', '.join(df.columns)}"
    if kind != "heatmap" and not y:
        return "a measure is needed"
    return "there is no data" if df.isEmpty() else None


def figure(df: DataFrame, kind: str, x: str, y: str | list[str] | None = None, color: str | None = None, title: str | None = None, style: str = "grouped", width: int = 800, height: int = 600, sort_by: str | None = None, sort_order: str | None = None, cap: int = CAP) -> dict:
    """A figure as traces, layout, config and metadata, or {"error": ...}."""
    if wrong := check(df, kind, x, y):
        return {"error": wrong}
    try:
        if kind == "bar" and is_temporal(df, x):
            kind, sort_by, sort_order = "line", sort_by or x, "ascending"
        traces, labels = {"bar": _bar, "line": _line, "scatter": _scatter, "heatmap": _heatmap}[kind](df, x, y, color, sort_by, sort_order, cap)
    except ValueError as e:
        return {"error": str(e)}
    title = title or default_title(kind, x, y, color, style)
    several = kind == "line" and isinstance(y, list)
    layout = {"title": {"text": title}, "width": width, "height": height, "xaxis": {"title": measure_label(x)}, "barmode": "stack" if style == "stacked" else "group", "showlegend": bool(color) or several}
    layout |= {"font": {"size": 12}, "plot_bgcolor": "white", "paper_bgcolor": "white"} | (ABOVE if several else BESIDE)
    if kind != "heatmap":
        layout["xaxis"]["categoryarray"] = labels
        if len(labels) > MANY_LABELS or any(len(v) > LONG_LABEL for v in labels):
            layout["xaxis"]["tickangle"] = TILT
    if any(t.get("yaxis") == "y2" for t in traces):
        layout["yaxis2"] = {"overlaying": "y", "side": "right"}
    name = f"{kind}_{re.sub(r'[^\w-]', '', title.replace(' ', '_'))}_{datetime.now():%Y%m%d_%H%M%S}"
    return {
        "traces": traces,
        "layout": layout,
        "config": CONFIG | {"toImageButtonOptions": {"format": "png", "filename": name, "scale": 2}},
        "metadata": {"chart_id": name, "chart_type": kind, "data_points": sum(len(t.get("x", [])) for t in traces), "library": "plotly"},
    }


def _rows(df: DataFrame, cap: int) -> list:
    rows = df.limit(cap + 1).collect()
    if len(rows) > cap:
        raise ValueError(f"more than {cap} points; aggregate first")
    return rows


def _plain(v):
    return v.isoformat() if hasattr(v, "isoformat") else float(v) if type(v).__name__ == "Decimal" else v


def _bar(df, x, y, color, sort_by, sort_order, cap):
    data = group_sum(df, x, y, color)
    if sort_by and sort_by not in data.columns:
        raise ValueError(f"cannot sort by {sort_by!r}: it is lost in the grouping")
    data = with_totals(data, x, y) if color else data.withColumn("category_total", F.col(y))
    label = F.col(f"`{x}`")
    if sort_by == x or data.schema[x].dataType.typeName() != "string":
        data = ordered(data, x, x, sort_order == "descending")
    else:
        total = F.col("category_total")
        text = label.cast("string")
        data = data.orderBy(quarter_order(text).asc_nulls_last(), total.asc() if sort_order == "ascending" else total.desc(), label)
    return _traces(_rows(data, cap), "bar", x, [y], color)


def _line(df, x, y, color, sort_by, sort_order, cap):
    measures = [y] if isinstance(y, str) else y
    data = ordered(df, x, sort_by, sort_order == "descending")
    traces, labels = _traces(_rows(data.select(*dict.fromkeys([x, *measures, *([color] if color else [])])), cap), "scatter", x, measures, color if len(measures) == 1 else None)
    if any(not is_percentage(m) for m in measures):
        for t in traces:
            if len(measures) > 1 and is_percentage(t["measure"]):
                t["yaxis"] = "y2"
    return [t | {"mode": "lines+markers"} for t in traces], labels


def _scatter(df, x, y, color, sort_by, sort_order, cap):
    traces, labels = _traces(_rows(df.select(*dict.fromkeys([x, y, *([color] if color else [])])), cap), "scatter", x, [y], color)
    return [t | {"mode": "markers"} for t in traces], labels


def _heatmap(df, x, y, color, sort_by, sort_order, cap):
    """Counts with x downwards, ascending unless asked otherwise, and y across, descending; correlations in the columns' order unless asked."""
    upwards = sort_order == "descending"
    if y:
        cells = {(r[x], r[y]): r["n"] for r in _rows(cross_tab(df, x, y), cap)}
        down = sorted({k[0] for k in cells}, reverse=upwards and sort_by in (None, x))
        across = sorted({k[1] for k in cells}, reverse=True)
    else:
        cells = {(r.col_a, r.col_b): r.r for r in _rows(correlations(df), cap)}
        down = across = sorted(numeric_columns(df), reverse=upwards) if sort_order else numeric_columns(df)
    return [{"type": "heatmap", "x": list(map(_plain, across)), "y": list(map(_plain, down)), "z": [[cells.get((d, a), 0) for a in across] for d in down]}], list(map(str, across))


def _traces(rows, kind, x, measures, color):
    labels = list(dict.fromkeys(_plain(r[x]) for r in rows))
    out = []
    for m in measures:
        for c in dict.fromkeys(r[color] for r in rows) if color else [None]:
            own = [r for r in rows if not color or r[color] == c]
            out.append({"type": kind, "name": str(c) if color else measure_label(m), "measure": m, "x": [_plain(r[x]) for r in own], "y": [_plain(r[m]) for r in own]})
    return out, [str(v) for v in labels]
