"""The Markdown report, and the data and SVG of its figures. Counting is done in Spark; what gets here is a row a cluster."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.operators.moran import MoranResult
from kerbside.operators.summaries import CATEGORIES, category_profile, cluster_sizes, crosstab_percent
from kerbside.sources import files

LISA_CLASSES = {0: ("Not significant", "#c8c8c8"), 1: ("High-High", "#c0392b"), 2: ("Low-Low", "#2c6fbb"), 3: ("Low-High", "#8fbce6"), 4: ("High-Low", "#f0a07c")}
PALETTE = ("#4477aa", "#ee6677", "#228833", "#ccbb44", "#66ccee", "#aa3377", "#bb5566", "#004488", "#ddaa33", "#117733")
ALPHA = 0.05


STARS = ((0.001, "***"), (0.01, "**"), (0.05, "*"))


def stars_of(p: float | None) -> str:
    """Marks of significance, as functions.text.stars gives them for columns."""
    return next((mark for bound, mark in STARS if p is not None and p < bound), "ns")


def generate_report(df: DataFrame, keywords: dict | None = None, moran: dict[object, MoranResult] | None = None, output_path: str | None = None, cluster: str = "cluster", title: str = "Clusters of street scenes") -> str:
    """Markdown: totals, a table of the clusters, one of Moran's I, and what it says."""
    total = df.count()
    sizes = cluster_sizes(df, cluster).orderBy("cluster").collect()
    tops: dict = {}
    columns = [c for c in CATEGORIES[:2] if c in df.columns]
    if columns:
        for r in category_profile(df, columns, cluster).collect():
            tops.setdefault(r["cluster"], {})[r["column"]] = r["top"]
    heads = ["Cluster", "Images", "Share", "Keywords", *(c.replace("_", " ").title() for c in columns)]
    out = [f"# {title}", "", f"- Images: {total}", f"- Clusters: {len(sizes)}", "", "## Clusters", "", f"| {' | '.join(heads)} |", f"|{'---|' * len(heads)}"]
    for r in sizes:
        words = ", ".join((keywords or {}).get(r["cluster"], [])[:4])
        out.append(f"| {r['cluster']} | {r['size']} | {r['pct']:.1f} % | {words} | {''.join(f'{tops.get(r['cluster'], {}).get(c, '')} | ' for c in columns)}".rstrip())
    out += ["", "## Spatial autocorrelation", ""]
    if moran:
        out += ["| Cluster | I | Expected | z | p | |", "|---|---|---|---|---|---|"]
        number = lambda x: "" if x is None else f"{x:.4f}"
        for label, m in sorted(moran.items(), key=lambda x: str(x[0])):
            out.append(f"| {label} | {number(m.I)} | {number(m.expected_I)} | {number(m.z_score)} | {number(m.p_value)} | {stars_of(m.p_value)} |")
        known = [m for m in moran.values() if m.I is not None]
        mean = sum(m.I for m in known) / len(known) if known else 0.0
        sure = sum(m.p_value is not None and m.p_value < ALPHA for m in known)
        how = "gather in places" if mean > 0.3 else "gather weakly" if mean > 0.05 else "show hardly any spatial order" if mean > -0.05 else "avoid one another"
        out += ["", f"The mean I is {mean:.4f}; {sure} of {len(known)} clusters differ from chance (p < {ALPHA}). Images of a cluster {how}."]
    else:
        out.append("Not worked out.")
    text = "\n".join(out) + "\n"
    if output_path:
        files.write_text(df.sparkSession, output_path, text)
    return text


def elbow_svg(ks: list[int], costs: list[float], width: int = 480, height: int = 320) -> str:
    """A line of costs over numbers of clusters."""
    if not ks or len(ks) != len(costs):
        raise ValueError("an elbow plot needs as many costs as numbers of clusters")
    top, low, span = max(costs), min(costs), max(ks) - min(ks) or 1
    at = [(40 + (k - min(ks)) * (width - 60) / span, 20 + (top - c) * (height - 60) / ((top - low) or 1)) for k, c in zip(ks, costs, strict=True)]
    line = " ".join(f"{x:.1f},{y:.1f}" for x, y in at)
    marks = "".join(f'<circle cx="{x:.1f}" cy="{y:.1f}" r="3"/><text x="{x:.1f}" y="{height - 20}" text-anchor="middle">{k}</text>' for (x, y), k in zip(at, ks, strict=True))
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" font-size="11"><polyline fill="none" stroke="{PALETTE[0]}" points="{line}"/>{marks}<text x="{width / 2}" y="{height - 4}" text-anchor="middle">clusters</text></svg>'


def _map_svg(rows: list, color, width: int, height: int) -> str:
    if not rows:
        return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}"/>'
    xs, ys = [r["lon"] for r in rows], [r["lat"] for r in rows]
    wide, tall = (max(xs) - min(xs)) or 1, (max(ys) - min(ys)) or 1
    dots = "".join(f'<circle cx="{10 + (r["lon"] - min(xs)) / wide * (width - 20):.1f}" cy="{10 + (max(ys) - r["lat"]) / tall * (height - 20):.1f}" r="2.5" fill="{color(r["label"])}"><title>{escape(str(r["label"]))}</title></circle>' for r in rows)
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">{dots}</svg>'


def map_data(df: DataFrame, column: str = "cluster", cells: int = 200, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """(lon, lat, label, count) for a map: one dot for each label in each cell of a grid, so a figure never has more dots than cells times labels."""
    known = df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull() & F.col(column).isNotNull())
    x0, x1, y0, y1 = known.agg(F.min(lon), F.max(lon), F.min(lat), F.max(lat)).first()
    if x0 is None:
        return known.select(F.col(lon).alias("lon"), F.col(lat).alias("lat"), F.col(column).alias("label"), F.lit(1).cast("bigint").alias("count"))
    cell = lambda c, low, high: F.floor((F.col(c) - F.lit(low)) / F.lit(((high - low) or 1.0) / cells))
    return known.groupBy(cell(lon, x0, x1).alias("cx"), cell(lat, y0, y1).alias("cy"), F.col(column).alias("label")).agg(F.avg(lon).alias("lon"), F.avg(lat).alias("lat"), F.count("*").alias("count")).select("lon", "lat", "label", "count")


def cluster_map_svg(df: DataFrame, column: str = "cluster", width: int = 600, height: int = 600) -> str:
    """A dot for each cluster in each cell of a map; more than ten clusters take evenly spaced hues."""
    rows = map_data(df, column).collect()
    labels = sorted({r["label"] for r in rows})
    many = len(labels) > len(PALETTE)
    color = {x: f"hsl({360 * k // len(labels)},60%,50%)" if many else PALETTE[k] for k, x in enumerate(labels)}
    return _map_svg(rows, color.get, width, height)


def lisa_map_svg(df: DataFrame, column: str = "lisa_cluster", width: int = 600, height: int = 600) -> str:
    return _map_svg(map_data(df, column).collect(), lambda x: LISA_CLASSES.get(x, LISA_CLASSES[0])[1], width, height)


def category_distribution(df: DataFrame, column: str | None = None, cluster: str = "cluster") -> DataFrame:
    """(cluster, value, pct) of a label column, by default the first that df has."""
    name = column or next((c for c in CATEGORIES if c in df.columns), None)
    if name is None or name not in df.columns:
        raise ValueError(f"df has none of the columns {[column] if column else list(CATEGORIES)}")
    return crosstab_percent(df, name, cluster)


def category_svg(df: DataFrame, column: str | None = None, cluster: str = "cluster", width: int = 600, height: int = 320) -> str:
    """Stacked bars of a label column's values in each cluster."""
    rows = category_distribution(df, column, cluster).orderBy("cluster", "value").collect()
    labels, values = sorted({r["cluster"] for r in rows}), sorted({r["value"] for r in rows})
    bar, done, out = (width - 20) / max(1, len(labels)), {}, []
    for r in rows:
        k, tall = labels.index(r["cluster"]), r["pct"] * (height - 40) / 100
        y = done.get(r["cluster"], height - 20) - tall
        done[r["cluster"]] = y
        hue = 360 * values.index(r["value"]) // max(1, len(values))
        out.append(f'<rect x="{10 + k * bar:.1f}" y="{y:.1f}" width="{bar * 0.8:.1f}" height="{tall:.1f}" fill="hsl({hue},55%,55%)"><title>{escape(r["value"])} {r["pct"]:.1f} %</title></rect>')
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">{"".join(out)}</svg>'
