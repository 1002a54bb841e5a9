"""Writers of the interchange formats."""

from __future__ import annotations

import json
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object a line, non-ASCII characters as they are; mode "append" adds a batch."""
    df.write.mode(mode).json(path)


def csv_table(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    (df.orderBy(*order) if order else df).write.mode("overwrite").csv(path, header=True)


def texts(df: DataFrame, path: str) -> None:
    """One folder a document, named by its file."""
    df.select("filename", "text").write.mode("overwrite").partitionBy("filename").text(path)


def append_once(df: DataFrame, path: str, key: str) -> None:
    """Append rows whose key the table lacks; a job commits all of its files or none."""
    spark = df.sparkSession
    try:
        known = spark.read.parquet(path).select(key)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        df.write.parquet(path)
        return
    df.join(known, key, "left_anti").write.mode("append").parquet(path)


def file_name(era: Column) -> Column:
    """A file's name from a label: underscores for spaces, no parentheses."""
    return F.regexp_replace(F.replace(era, F.lit(" "), F.lit("_")), "[()]", "")


def escaped(c: Column) -> Column:
    """Text for XML content and for attributes in double quotes; null is empty."""
    c = F.coalesce(c.cast("string"), F.lit(""))
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")):
        c = F.replace(c, F.lit(plain), F.lit(safe))
    return c


GRAPHML_HEAD = (
    '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="w" for="edge" attr.name="weight" attr.type="double"/>'
    '<key id="r" for="edge" attr.name="relations" attr.type="string"/>'
)
GRAPHML_OPEN, GRAPHML_CLOSE = '<graph edgedefault="directed">', "</graph></graphml>"


def edge_line(src: Column, dst: Column, weight: Column, relations: Column) -> Column:
    return F.concat(
        F.lit('<edge source="'), escaped(src), F.lit('" target="'), escaped(dst), F.lit('"><data key="w">'), F.coalesce(weight.cast("string"), F.lit("1")),
        F.lit('</data><data key="r">'), escaped(relations), F.lit("</data></edge>"),
    )


def graphml(edges: DataFrame) -> DataFrame:
    """(file, content): a GraphML document for each era as one value; for small networks (see graphml_files)."""
    ordered = F.array_sort(F.collect_list(F.struct("src", "dst", "weight", "relations")))
    body = F.array_join(F.transform(ordered, lambda e: edge_line(e["src"], e["dst"], e["weight"], e["relations"])), "")
    return edges.groupBy(file_name(F.col("era")).alias("file")).agg(F.concat(F.lit(GRAPHML_HEAD + GRAPHML_OPEN), body, F.lit(GRAPHML_CLOSE)).alias("content"))


def graphml_files(edges: DataFrame, path: str, nodes: DataFrame | None = None) -> None:
    """A GraphML file for each era, in a folder named by it: path/file=NAME/part-....

    edges: era, src, dst, weight, relations. nodes: era, node, and columns that become the
    node's data, named alike; without them nodes are those of edges. Lines are sorted and
    streamed by one task a file, so no network is held in memory.
    """
    name = file_name(F.col("era")).alias("file")
    if nodes is None:
        nodes = edges.select("era", F.explode(F.array("src", "dst")).alias("node")).distinct()
    extra = [c for c in nodes.columns if c not in ("era", "node")]
    kind = {"bigint": "long", "int": "int", "double": "double", "float": "float", "boolean": "boolean"}
    keys = "".join(f'<key id="n{i}" for="node" attr.name="{escape(c)}" attr.type="{kind.get(dict(nodes.dtypes)[c], "string")}"/>' for i, c in enumerate(extra))
    data = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f'<data key="n{i}">'), escaped(F.col(c)), F.lit("</data>"))) for i, c in enumerate(extra)]
    row = lambda place, first, second, line: [F.lit(place).alias("place"), first.alias("first"), second.alias("second"), line.alias("line")]
    none = F.lit("")
    eras = edges.select("era").unionByName(nodes.select("era")).distinct()
    lines = eras.select(name, *row(0, none, none, F.lit(GRAPHML_HEAD + keys + GRAPHML_OPEN)))
    lines = lines.unionByName(eras.select(name, *row(3, none, none, F.lit(GRAPHML_CLOSE))))
    node = F.concat(F.lit('<node id="'), escaped(F.col("node")), F.lit('">'), F.concat_ws("", *data), F.lit("</node>"))
    lines = lines.unionByName(nodes.select(name, *row(1, F.col("node"), none, node)))
    lines = lines.unionByName(edges.select(name, *row(2, F.col("src"), F.col("dst"), edge_line(*(F.col(c) for c in ("src", "dst", "weight", "relations"))))))
    lines.repartition("file").sortWithinPartitions("file", "place", "first", "second").select("file", "line").write.mode("overwrite").partitionBy("file").text(path)


def nested_json(df: DataFrame, keys: list[str], value: str) -> str:
    """A small summary table as nested JSON objects, keyed column by column; infinite numbers become null."""
    out: dict = {}
    for row in df.select(*keys, value).toLocalIterator():
        at = out
        for k in keys[:-1]:
            at = at.setdefault(str(row[k]), {})
        v = row[value]
        at[str(row[keys[-1]])] = None if isinstance(v, float) and (v != v or v in (float("inf"), float("-inf"))) else v
    return json.dumps(out, ensure_ascii=False, sort_keys=True)
