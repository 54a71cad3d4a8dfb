"""The native store: two Parquet tables, vertices and edges, sorted for pruning, and a façade over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, routing, sampling, spatial
from ..operators.ordering import dense_index


def write_graph(vertices: DataFrame, edges: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Vertices by (lat, lon), edges by (src, dst) with a dense edge_id; min/max statistics then serve as the index."""
    n = int(vertices.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    vertices.repartitionByRange(n, "lat_udeg", "lon_udeg").sortWithinPartitions("lat_udeg", "lon_udeg", "id").write.mode(mode).parquet(f"{path}/vertices")
    numbered = edges if "edge_id" in edges.columns else dense_index(edges, ["src", "dst"], "edge_id")
    numbered.repartitionByRange(n, "src", "dst").sortWithinPartitions("src", "dst").write.mode(mode).parquet(f"{path}/edges")


class RoadGraph:
    """A stored road graph and the queries on it."""

    def __init__(self, vertices: DataFrame, edges: DataFrame):
        self.vertices = vertices
        self.edges = edges
        self.lines = spatial.with_lines(edges, vertices)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> RoadGraph:
        return cls(spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges"))

    def save(self, path: str, mode: str = "errorifexists") -> None:
        write_graph(self.vertices, self.edges, path, mode)

    def edge_info(self) -> DataFrame:
        """edge_id with level, distance and both ends."""
        return self.lines.select("edge_id", "road_level", "distance", "src", "dst", "lat1", "lon1", "lat2", "lon2")

    def project(self, points: DataFrame) -> DataFrame:
        return spatial.project_points(points, self.lines)

    def sample_edges(self, box: tuple[float, float, float, float], max_num: int, sip: bool = False) -> DataFrame:
        return sampling.by_level(sampling.sample_edges(self.lines, box, max_num, sip))

    def sample_lines(self, box: tuple[float, float, float, float], max_num: int, sip: bool = False) -> DataFrame:
        """By level, x and y lists in Web-Mercator metres with NaN between lines."""
        return sampling.drawn_by_level(sampling.sample_edges(self.lines, box, max_num, sip))

    def strong_components(self) -> DataFrame:
        return graph.strong_components(self.edges)

    def shortest_paths(self, pairs: DataFrame) -> DataFrame:
        """Between projected points: leg_id, a, b (as ``project`` gives them)."""
        return routing.route_legs(pairs, self.lines, self.vertices)

    def shortest_distances(self, pairs: DataFrame, unreachable: int | None = None) -> DataFrame:
        """leg_id, distance."""
        out = routing.route_legs(pairs, self.lines, self.vertices).select("leg_id", "distance")
        return out if unreachable is None else out.fillna({"distance": unreachable})

    def route(self, requests: DataFrame) -> DataFrame:
        return routing.route(requests, self.lines, self.vertices)

    def bounds(self) -> DataFrame:
        return self.lines.agg(F.min("x1").alias("min_x"), F.min("y1").alias("min_y"), F.max("x1").alias("max_x"), F.max("y1").alias("max_y"))
