"""Connected components of an undirected graph given as a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Up to this many links (counted first) one task labels them; beyond it, the rounds of joins below do.
ONE_TASK_LINKS = 200_000


def _union_find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parent: dict = {}

    def root(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(p, p)
        return x

    for frame in batches:
        for a, b in zip(frame["a"], frame["b"]):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
    nodes = list(parent)
    for at in range(0, len(nodes), 50_000):
        part = nodes[at : at + 50_000]
        yield pd.DataFrame({"node": part, "label": [root(x) for x in part]})


def connected_components(links: DataFrame, one_task_links: int = ONE_TASK_LINKS) -> DataFrame:
    """(node, label): label is the least node of the component. Nodes without a link don't appear.

    ``links`` has columns a and b of one orderable type; self links and repeated links are harmless,
    rows with a null end are ignored; an empty table gives an empty table.

    Large graphs: alternating large-star and small-star rounds, each an aggregation (combined before
    its shuffle) and a join, with a checkpoint per round, until the links no longer change.
    """
    links = cut(links.select("a", "b").where("a is not null and b is not null"))
    kind = links.schema["a"].dataType.simpleString()
    if links.limit(one_task_links + 1).count() <= one_task_links:
        return links.coalesce(1).mapInPandas(_union_find, f"node {kind}, label {kind}")
    nodes = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).distinct()
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()

    def star(both: DataFrame, larger: bool) -> DataFrame:
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = both.join(least, "u")
        if larger:  # each larger neighbour is linked to the least one
            out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = cut(edges)
    before = state(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        edges = cut(star(both, True))
        edges = cut(star(edges, False))  # u > v already
        if (now := state(edges)) == before:
            break
        before = now
    return nodes.join(edges.select(F.col("u").alias("node"), F.col("v").alias("label")), "node", "left").select(
        "node", F.coalesce("label", "node").alias("label")
    )
