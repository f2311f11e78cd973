"""The code graph: symbol, relation and file tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callgrove.schemas import schema


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame
    files: DataFrame | None = None

    def of_kind(self, kind: str) -> DataFrame:
        return self.nodes.filter(F.col("kind") == kind)

    @property
    def methods(self) -> DataFrame:
        return self.of_kind("method")

    @property
    def routes(self) -> DataFrame:
        return self.of_kind("route")

    @property
    def classes(self) -> DataFrame:
        return self.of_kind("class")

    def edges_of(self, kind: str) -> DataFrame:
        return self.edges.filter(F.col("kind") == kind)

    @property
    def calls(self) -> DataFrame:
        return self.edges_of("calls").select("source", "target")


def read_graph(spark: SparkSession, path: str | None = None, jdbc: dict[str, str] | None = None) -> Graph:
    """Read the tables from ``<path>/{nodes,edges,files}`` as parquet, or over JDBC."""
    if jdbc is not None:
        tables = {t: spark.read.format("jdbc").options(**jdbc, dbtable=t).load() for t in ("nodes", "edges", "files")}
        return Graph(typed_nodes(tables["nodes"]), typed_edges(tables["edges"]), tables["files"])
    read = lambda name: spark.read.schema(schema(name)).parquet(f"{path}/{name}")
    return Graph(read("nodes"), read("edges"), read("files"))


def typed_nodes(raw: DataFrame) -> DataFrame:
    """Rows as a relational store keeps them: 0/1 flags, JSON text arrays, epoch milliseconds."""
    flags = ["is_exported", "is_async", "is_static", "is_abstract"]
    lists = ["decorators", "type_parameters"]
    return raw.withColumns({
        **{c: F.col(c).cast("int").cast("boolean") for c in flags},
        **{c: F.from_json(F.col(c).cast("string"), "array<string>") for c in lists},
        "updated_at": F.timestamp_millis(F.col("updated_at").cast("long")),
    })


def typed_edges(raw: DataFrame) -> DataFrame:
    return raw.withColumn("metadata", F.from_json(F.col("metadata").cast("string"), "map<string,string>"))


def write_graph(g: Graph, path: str) -> None:
    g.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    g.edges.write.mode("overwrite").parquet(f"{path}/edges")
    if g.files is not None:
        g.files.write.mode("overwrite").parquet(f"{path}/files")
