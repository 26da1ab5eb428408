"""Writers. Large tables stay distributed; dimensions of classes are small and are rendered on the driver."""

from __future__ import annotations

import json
from xml.sax.saxutils import quoteattr

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .versions import Conflict, VersionedTable


def write_table(df: DataFrame, path: str, mode: str = "errorifexists", by: list[str] | None = None) -> None:
    """Parquet; an existing table is refused unless ``mode`` says otherwise."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_version(df: DataFrame, path: str, run_id: str) -> str:
    """A new folder for each run, so what was there stays; a run is never overwritten."""
    target = f"{path.rstrip('/')}/run_id={run_id}"
    write_table(df, target)
    return target


def write_tsv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Tabs and a header; arrays are joined by ';', nulls are empty."""
    flat = [F.array_join(c, ";").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode(mode).csv(path, sep="\t", header=True, nullValue="", emptyValue="", quote="")


def graph_json(nodes: DataFrame, edges: DataFrame, metadata: dict) -> str:
    """{metadata, nodes, edges} with sorted keys and rows, closed by a line break."""
    rows = lambda df: sorted((r.asDict() for r in df.collect()), key=lambda r: json.dumps(r, sort_keys=True, default=str))
    return json.dumps({"metadata": metadata, "nodes": rows(nodes), "edges": rows(edges)}, indent=2, sort_keys=True, default=str) + "\n"


def graphml_text(nodes: DataFrame, edges: DataFrame) -> str:
    """GraphML of nodes (class_id and attributes) and edges (parent_id, child_id and attributes)."""
    out = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">']
    keys = [(c, "node") for c in nodes.columns if c != "class_id"] + [(c, "edge") for c in edges.columns if c not in ("parent_id", "child_id")]
    out += [f'<key id="{where[0]}_{c}" for="{where}" attr.name="{c}" attr.type="string"/>' for c, where in keys]
    out.append('<graph edgedefault="directed">')
    data = lambda r, where: "".join(f'<data key="{where[0]}_{c}">{esc(r[c])}</data>' for c, w in keys if w == where and r[c] is not None)
    for r in sorted(nodes.collect(), key=lambda r: r["class_id"]):
        out.append(f"<node id={quoteattr(r['class_id'])}>{data(r, 'node')}</node>")
    for r in sorted(edges.collect(), key=lambda r: (r["parent_id"], r["child_id"])):
        out.append(f"<edge source={quoteattr(r['parent_id'])} target={quoteattr(r['child_id'])}>{data(r, 'edge')}</edge>")
    return "\n".join([*out, "</graph>", "</graphml>", ""])


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """GraphML of any size: one element a line, in part files that make the document end to end, in order of their names."""
    keys = [(c, "node") for c in nodes.columns if c != "class_id"] + [(c, "edge") for c in edges.columns if c not in ("parent_id", "child_id")]

    def quoted(c: str) -> Column:
        out = F.col(c).cast("string")
        for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")):
            out = F.replace(out, F.lit(char), F.lit(name))
        return out

    def data(where: str) -> Column:
        return F.concat(*[F.coalesce(F.concat(F.lit(f'<data key="{where[0]}_{c}">'), quoted(c), F.lit("</data>")), F.lit("")) for c, w in keys if w == where], F.lit(""))

    spark = nodes.sparkSession
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">']
    head += [f'<key id="{where[0]}_{c}" for="{where}" attr.name="{c}" attr.type="string"/>' for c, where in keys] + ['<graph edgedefault="directed">']
    fixed = spark.createDataFrame([(0, str(i).zfill(4), x) for i, x in enumerate(head)] + [(3, "", "</graph>\n</graphml>")], "turn int, place string, value string")
    node = nodes.select(F.lit(1).alias("turn"), F.col("class_id").cast("string").alias("place"), F.concat(F.lit('<node id="'), quoted("class_id"), F.lit('">'), data("node"), F.lit("</node>")).alias("value"))
    edge = edges.select(F.lit(2).alias("turn"), F.concat_ws("\x1f", "parent_id", "child_id").alias("place"), F.concat(F.lit('<edge source="'), quoted("parent_id"), F.lit('" target="'), quoted("child_id"), F.lit('">'), data("edge"), F.lit("</edge>")).alias("value"))
    every = fixed.unionByName(node).unionByName(edge)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    every.repartitionByRange(parts, "turn", "place").sortWithinPartitions("turn", "place").select("value").write.text(path)


def esc(value: object) -> str:
    return quoteattr(str(value))[1:-1]


def append_audit(df: DataFrame, path: str) -> None:
    """Add rows to the log; what is there stays."""
    df.write.mode("append").parquet(path)


def markdown(df: DataFrame, title: str, most: int = 1000) -> str:
    """A metrics table as Markdown; it is for reports, so at most ``most`` rows are shown and the rest counted."""
    rows = df.limit(most + 1).collect()
    body = ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows[:most]]
    tail = [f"\nand more than {most} rows"] if len(rows) > most else []
    return "\n".join([f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " - |" * len(df.columns), *body, *tail, ""])


def mark_done(summary: DataFrame, path: str) -> bool:
    """Write a run's summary as its sentinel, once: False if it stands already. Of several runs at one time one writes it."""
    try:
        VersionedTable(summary.sparkSession, path).replace(summary.coalesce(1), base=0)
    except Conflict:
        return False
    return True


def is_done(spark: SparkSession, path: str) -> bool:
    """Whether a sentinel stands."""
    return VersionedTable(spark, path).latest() > 0
