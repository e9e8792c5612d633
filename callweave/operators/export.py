"""Subgraphs as nodes and edges, and as JSON for graph viewers."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.functions import text as X
from callweave.operators.relations import first_definition, functions, symbols_matching


def export_symbols(defs: DataFrame, pattern: str | None = None, max_nodes: int | None = None) -> DataFrame:
    """(symbol): all functions, or symbols of any kind that hold the pattern; the first by name."""
    chosen = functions(defs) if pattern is None else symbols_matching(defs, pattern)
    return chosen if max_nodes is None else chosen.orderBy("symbol").limit(max_nodes)


def export_nodes(defs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(id, label, file, line, kind) of each chosen symbol by its first definition."""
    d = first_definition(defs).withColumnRenamed("symbol", "_s")
    return chosen.join(d, F.col("symbol") == F.col("_s"), "left").select(
        F.col("symbol").alias("id"), F.col("symbol").alias("label"), "file", "line", F.coalesce("kind", F.lit("unknown")).alias("kind")
    )


def export_edges(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """(id, source, target, ord): call rows between chosen symbols; repeated calls stay, with one id."""
    s = chosen.select(F.col("symbol").alias("_s"))
    return (
        rows.select("ord", "caller", "callee")
        .join(s, F.col("caller") == F.col("_s"), "left_semi")
        .join(s, F.col("callee") == F.col("_s"), "left_semi")
        .select(X.edge_id(F.col("caller"), F.col("callee")).alias("id"), F.col("caller").alias("source"), F.col("callee").alias("target"), "ord")
    )


def json_elements(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, element): each node and edge as JSON, made by the executors; part is nodes or edges. Null
    fields are kept."""
    keep = {"ignoreNullFields": "false"}
    n = nodes.select(F.lit("nodes").alias("part"), F.to_json(F.struct(F.struct("id", "label", "file", "line", "kind").alias("data")), keep).alias("element"))
    e = edges.select(F.lit("edges").alias("part"), F.to_json(F.struct(F.struct("id", "source", "target").alias("data")), keep).alias("element"))
    return n.unionByName(e)


def _documents(nodes: DataFrame, edges: DataFrame) -> Iterator[str]:
    """Pieces of {elements: {nodes, edges}}, nodes by name, edges by source and ord."""
    none = lambda df: df.limit(0)
    yield '{"elements":{"nodes":['
    for name, got in (("nodes", json_elements(nodes.orderBy("id"), none(edges))), ("edges", json_elements(none(nodes), edges.orderBy("source", "ord")))):
        for i, r in enumerate(got.where(F.col("part") == name).toLocalIterator()):
            yield ("," if i else "") + "\n" + r["element"]
        yield "\n]" + (',"edges":[' if name == "nodes" else "}}\n")


def graph_json(nodes: DataFrame, edges: DataFrame) -> str:
    """{elements: {nodes, edges}} as one text, for a subgraph that a viewer can draw."""
    return "".join(_documents(nodes, edges))


def export_to_file(defs: DataFrame, rows: DataFrame, path: str, pattern: str | None = None, max_nodes: int | None = None) -> None:
    """The document as one file; elements come to the driver a partition at a time and are written at once."""
    chosen = export_symbols(defs, pattern, max_nodes)
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(_documents(export_nodes(defs, chosen), export_edges(rows, chosen)))
