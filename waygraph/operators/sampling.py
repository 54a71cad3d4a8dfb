"""Stable samples: of the elements' hashes, those whose lowest k bits are zero, with the least k that leaves few enough.

Two passes and a table of at most a few dozen counts for each priority; the sample depends on the elements alone, not on their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def zeros_of(element: Column, sip: bool = False) -> Column:
    """Trailing zero bits of the element's hash; ``sip``: of SipHash instead of the plain whole-number hash."""
    return text.siphash_zeros(element) if sip else text.trailing_zeros(text.mix(element))


def _cuts(df: DataFrame, keys: list[str], budget: Column) -> DataFrame:
    """keys and k: the least k with count(zeros >= k) <= budget. df: keys, zeros and what budget needs."""
    counts = df.groupBy(*keys, "zeros", budget.alias("budget")).agg(F.count("*").alias("n"))
    upwards = Window.partitionBy(*keys).orderBy(F.col("zeros").desc())
    running = counts.withColumn("upto", F.sum("n").over(upwards))
    # k must lie above the largest zeros value whose running count is too much
    over = F.max(F.when(F.col("upto") > F.col("budget"), F.col("zeros")))
    return running.groupBy(*keys).agg((F.coalesce(over, F.lit(-1)) + 1).alias("k"))


def sample(df: DataFrame, element: str, max_num: int, sip: bool = False) -> DataFrame:
    """At most ``max_num`` rows of ``df``; 0 gives none."""
    if max_num <= 0:
        return df.limit(0)
    marked = df.withColumn("zeros", zeros_of(F.col(element), sip)).withColumn("_one", F.lit(0))
    cuts = _cuts(marked, ["_one"], F.lit(max_num))
    return marked.join(F.broadcast(cuts), "_one").where("zeros >= k").select(*df.columns)  # one row


def priority_budgets(df: DataFrame, priority: str, max_num: int) -> DataFrame:
    """priority, n and budget: what is left of max_num after all elements (kept or not) of higher priorities; priorities with none left are out."""
    counts = df.groupBy(priority).agg(F.count("*").alias("n"))
    above = Window.orderBy(F.col(priority).desc()).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.sum("n").over(above), F.lit(0))
    return counts.withColumn("budget", F.lit(max_num) - seen).where("budget > 0")


def sample_with_priority(df: DataFrame, element: str, priority: str, max_num: int, sip: bool = False) -> DataFrame:
    """Rows of ``df``: higher priorities first, each sampled to its budget."""
    budgets = priority_budgets(df, priority, max_num).drop("n")
    marked = df.withColumn("zeros", zeros_of(F.col(element), sip)).join(budgets, priority)
    cuts = _cuts(marked, [priority], F.col("budget"))
    return marked.join(cuts, priority).where("zeros >= k").select(*df.columns)


def sample_edges(lines: DataFrame, box: tuple[float, float, float, float], max_num: int, sip: bool = False) -> DataFrame:
    """Lines that meet the box (x1, y1, x2, y2: two opposite corners), main roads first, ``max_num`` at most."""
    from .spatial import box_meets

    inside = lines.where(box_meets(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), tuple(F.lit(float(v)) for v in box)))
    return sample_with_priority(inside.withColumn("priority", -F.col("road_level")), "edge_id", "priority", max_num, sip).drop("priority")


def by_level(sampled: DataFrame) -> DataFrame:
    """road_level and its edge ids in order."""
    return sampled.groupBy("road_level").agg(F.sort_array(F.collect_list("edge_id")).alias("edges"))


def drawn_by_level(sampled: DataFrame) -> DataFrame:
    """road_level, x and y: the lines' ends one after the other, NaN between lines."""
    nan = F.lit(float("nan"))
    rows = sampled.groupBy("road_level").agg(F.sort_array(F.collect_list(F.struct("edge_id", F.array("x1", "x2", nan).alias("x"), F.array("y1", "y2", nan).alias("y")))).alias("m"))
    return rows.select("road_level", F.flatten(F.transform("m", lambda r: r["x"])).alias("x"), F.flatten(F.transform("m", lambda r: r["y"])).alias("y"))
