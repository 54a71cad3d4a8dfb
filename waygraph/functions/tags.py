"""What the tags of nodes and ways say. Each function takes the tag's value, null if the tag is absent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Highway values by road level (fixed values); all other ways are no roads.
ROAD_LEVELS = {
    0: ("motorway", "motorway_link", "trunk", "trunk_link"),
    1: ("primary", "primary_link"),
    2: ("secondary", "secondary_link"),
    3: ("tertiary", "tertiary_link"),
    4: ("unclassified",),
    5: ("residential", "service", "living_street", "road", "rest_area", "services"),
}
#: Barrier values that close a road (fixed values).
CLOSED = ("border_control", "block", "bollard", "chain", "debris", "gate", "jersey_barrier", "kent_carriage_gap")


def road_level(highway: Column) -> Column:
    """0 (main) to 5, null for what is no road."""
    out = None
    for level, values in ROAD_LEVELS.items():
        hit = highway.isin(*values)
        out = F.when(hit, F.lit(level)) if out is None else out.when(hit, F.lit(level))
    return out


def is_barrier(barrier: Column) -> Column:
    return F.coalesce(barrier.isin(*CLOSED), F.lit(False))


def oneway(value: Column, highway: Column, junction: Column, no_is_two_way: bool = False) -> Column:
    """Struct of direct and reverse. "no", "false" and "0" count as one-way forward unless ``no_is_two_way``."""
    pair = lambda d, r: F.struct(F.lit(d).alias("direct"), F.lit(r).alias("reverse"))
    implied = F.coalesce(junction == "roundabout", F.lit(False)) | F.coalesce(highway == "motorway", F.lit(False))
    return (
        F.when(value.isin("yes", "true", "1"), pair(True, False))
        .when(value.isin("no", "false", "0"), pair(True, no_is_two_way))
        .when(value == "-1", pair(False, True))
        .when(implied, pair(True, False))
        .otherwise(pair(True, True))
    )
