"""From ways and nodes to road edges.

Tables: ways (way_id, highway, oneway, junction), refs (way_id, pos, node_id, len: number of the way's
refs), nodes (id, lat_udeg, lon_udeg, barrier). ``explode_ways`` makes the first two from OSM-style ways.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, tags


def explode_ways(osm_ways: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ways, refs) of ways with ``refs ARRAY<BIGINT>`` and ``tags MAP<STRING,STRING>``; what is no road is dropped before refs are expanded."""
    ways = osm_ways.select("way_id", *[F.col("tags")[k].alias(k) for k in ("highway", "oneway", "junction")], "refs")
    ways = ways.where(tags.road_level(F.col("highway")).isNotNull())
    refs = ways.select("way_id", F.size("refs").cast("bigint").alias("len"), F.posexplode("refs").alias("pos", "node_id"))
    return ways.drop("refs"), refs.select("way_id", "node_id", F.col("pos").cast("bigint").alias("pos"), "len")


def tagged_nodes(osm_nodes: DataFrame) -> DataFrame:
    return osm_nodes.select("id", "lat_udeg", "lon_udeg", F.col("tags")["barrier"].alias("barrier"))


def roads(ways: DataFrame, no_is_two_way: bool = False) -> DataFrame:
    """way_id, road_level, direct and reverse of the ways that are roads."""
    level = tags.road_level(F.col("highway"))
    way = tags.oneway(F.col("oneway"), F.col("highway"), F.col("junction"), no_is_two_way)
    return ways.select("way_id", level.alias("road_level"), way["direct"].alias("direct"), way["reverse"].alias("reverse")).where("road_level is not null")


def node_usage(refs: DataFrame, road_ways: DataFrame) -> DataFrame:
    """node_id, n_uses, is_endpoint and is_junction over the refs of roads: a junction ends a way or is used twice."""
    used = refs.join(road_ways.select("way_id"), "way_id", "left_semi")
    end = (F.col("pos") == 0) | (F.col("pos") == F.col("len") - 1)
    counted = used.groupBy("node_id").agg(F.count("*").alias("n_uses"), F.max(end).alias("is_endpoint"))
    return counted.withColumn("is_junction", F.col("is_endpoint") | (F.col("n_uses") >= 2))


def junction_stats(usage: DataFrame) -> DataFrame:
    return usage.agg(F.count_if(~F.col("is_junction")).alias("n_internal"), F.count_if("is_junction").alias("n_junction"))


def used_nodes(nodes: DataFrame, usage: DataFrame) -> DataFrame:
    """Nodes that a road uses: id, lat_udeg, lon_udeg, barrier (boolean)."""
    slim = nodes.select("id", "lat_udeg", "lon_udeg", tags.is_barrier(F.col("barrier")).alias("barrier"))
    return slim.join(usage.select(F.col("node_id").alias("id")), "id", "left_semi")


def steps(refs: DataFrame, road_ways: DataFrame, usage: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row for each two refs in a row of a road: way_id, pos, segment, prev_node, node_id, metres and blocked.

    A segment's number is how many junctions stand before the ref: a junction ends one segment and starts
    the next. Ways that name an unknown node are left out (see ``incomplete_ways``).
    """
    points = nodes.select(F.col("id").alias("node_id"), "lat_udeg", "lon_udeg", tags.is_barrier(F.col("barrier")).alias("barrier"))
    # the refs of a node get its place and its role in one join on the node
    known = usage.select("node_id", "is_junction").join(points, "node_id", "left")
    rows = refs.join(road_ways.select("way_id"), "way_id", "left_semi").join(known, "node_id")
    way = Window.partitionBy("way_id").orderBy("pos")
    whole = Window.partitionBy("way_id")
    out = rows.select(
        "way_id", "pos", "node_id", "lat_udeg", "lon_udeg", "barrier",
        F.sum(F.col("is_junction").cast("int")).over(way.rowsBetween(Window.unboundedPreceding, -1)).alias("segment"),
        F.lag("node_id").over(way).alias("prev_node"),
        F.lag("lat_udeg").over(way).alias("prev_lat"),
        F.lag("lon_udeg").over(way).alias("prev_lon"),
        F.lag("barrier").over(way).alias("prev_barrier"),
        F.max(F.col("lat_udeg").isNull()).over(whole).alias("lacking"),
    )
    metres = geo.haversine(F.col("prev_lat"), F.col("prev_lon"), F.col("lat_udeg"), F.col("lon_udeg"))
    return out.where("pos > 0 and not lacking").select(
        "way_id", "pos", "segment", "prev_node", "node_id", metres.alias("metres"), (F.col("barrier") | F.col("prev_barrier")).alias("blocked")
    )


def incomplete_ways(refs: DataFrame, road_ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """way_id and n_missing of roads that name nodes which there aren't."""
    used = refs.join(road_ways.select("way_id"), "way_id", "left_semi")
    return used.join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_anti").groupBy("way_id").agg(F.count("*").alias("n_missing"))


def segments(step_rows: DataFrame) -> DataFrame:
    """way_id, segment, src, dst, distance (metres, rounded once) and blocked (any node a barrier, both ends included)."""
    return step_rows.groupBy("way_id", "segment").agg(
        F.min_by("prev_node", "pos").alias("src"),
        F.max_by("node_id", "pos").alias("dst"),
        F.round(F.sum("metres")).cast("bigint").alias("distance"),
        F.max("blocked").alias("blocked"),
    )


def arcs(segment_rows: DataFrame, road_ways: DataFrame) -> DataFrame:
    """src, dst, road_level, distance: open segments in the directions that their way allows."""
    rows = segment_rows.where("not blocked").join(road_ways, "way_id")
    forward = F.struct(F.col("src").alias("s"), F.col("dst").alias("d"), F.col("direct").alias("go"))
    backward = F.struct(F.col("dst").alias("s"), F.col("src").alias("d"), F.col("reverse").alias("go"))
    return rows.select(F.explode(F.array(forward, backward)).alias("a"), "road_level", "distance").where("a.go").select(F.col("a.s").alias("src"), F.col("a.d").alias("dst"), "road_level", "distance")


def dedup_edges(arc_rows: DataFrame) -> DataFrame:
    """One edge a (src, dst): the largest level and the least distance, each by itself."""
    return arc_rows.groupBy("src", "dst").agg(F.max("road_level").alias("road_level"), F.min("distance").alias("distance"))


def build_edges(ways: DataFrame, refs: DataFrame, nodes: DataFrame, no_is_two_way: bool = False) -> DataFrame:
    road_ways = roads(ways, no_is_two_way)
    usage = node_usage(refs, road_ways)
    return dedup_edges(arcs(segments(steps(refs, road_ways, usage, nodes)), road_ways))
