"""What a reader of the graph asks for, as methods that return DataFrames over one folder of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.operators import events, graph, market, propagate
from ripplegraph.plans.logical import view


class Graph:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def _view(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)

    def _edges(self, types: list[str] | None = None, provisional: bool = False, inferred: bool = False) -> DataFrame:
        """The layers and types asked for, derived customer_of edges included."""
        stored = self._view("edges")
        both = stored.unionByName(graph.customer_of_edges(self._view("nodes"), stored))
        return graph.of_types(graph.layer(both, provisional=provisional, inferred=inferred), types)

    def health(self) -> DataFrame:
        return graph.health_counts(self.spark, self.sf_dir)

    def node(self, id: str) -> DataFrame:
        return self._view("nodes").where(F.col("id") == id)

    def edge(self, id: str) -> DataFrame:
        return self._edges(provisional=True, inferred=True).where(F.col("id") == id)

    def node_edges(self, id: str, types: list[str] | None = None, **layers: bool) -> DataFrame:
        return self._edges(types, **layers).where((F.col("source") == id) | (F.col("target") == id))

    def ego(self, id: str, types: list[str] | None = None, **layers: bool) -> tuple[DataFrame, DataFrame]:
        """The node and its neighbours (center marks it), and the edges at it."""
        at = self.node_edges(id, types, **layers)
        ids = at.select(F.explode(F.array("source", "target")).alias("id")).unionByName(self.node(id).select("id")).distinct()
        return self._view("nodes").join(ids, "id", "left_semi").withColumn("center", F.col("id") == id), at

    def subgraph(self, seeds: list[str], hops: int = 2, types: list[str] | None = None, node_cap: int = 3000, **layers: bool) -> tuple[DataFrame, DataFrame, bool]:
        """(id, depth) within at most three hops, the edges of the expanded nodes, and whether the cap cut the walk short."""
        return graph.capped_subgraph(self._edges(types, **layers), self._view("nodes").where(F.col("id").isin(seeds)), min(hops, 3), node_cap)

    def search(self, text: str, limit: int = 20) -> DataFrame:
        found = graph.search(self._view("aliases"), text, limit, fuzzy=True)
        return found.join(self._view("nodes").select(F.col("id").alias("node_id"), "type", "name"), "node_id").orderBy(F.desc("score"), "node_id")

    def resolve(self, asked: DataFrame) -> DataFrame:
        return graph.resolve_ids(asked, self._view("nodes"), self._view("aliases"))

    def impact(self, seeds: DataFrame, hops: int = propagate.HOPS, scorer: propagate.Scorer = propagate.rule_scorer) -> DataFrame:
        """Traces of (event_id, id, direction, magnitude) through the graph."""
        return propagate.propagate(seeds, self._view("nodes"), self._view("edges"), hops, scorer)

    def live(self, today: str = events.TODAY, window: int = events.WINDOW) -> DataFrame:
        return events.aggregate(self._view("impacts"), today, window)

    def node_impacts(self, id: str) -> DataFrame:
        return self._view("impacts").where(F.col("node_id") == id)

    def usage(self) -> DataFrame:
        return events.usage_buckets(self.spark, self.sf_dir)

    def reliability(self, hop: int | None = None, horizon: int | None = None) -> DataFrame:
        rows = market.reliability_classes(self.spark, self.sf_dir)
        for name, value in (("hop", hop), ("horizon", horizon)):
            rows = rows if value is None else rows.where(F.col(name) == value)
        return rows
