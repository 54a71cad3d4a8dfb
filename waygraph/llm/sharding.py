"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash and ranked within their source; the fractional rank
(2 * rank - 1) / (2 * rows of the source) spreads each source evenly over 0 to 1. The rows in order of
fractional rank, cut into equal runs, give shards that all have the mixture of the whole.

Law: ``rows`` (shard sizes differ by one row at most). A group of equal texts is not held together:
groups may be larger than a shard.

No window holds more than a slice of a source: rows are counted by slice of their hash, and a row's
rank is the count of the slices before its own plus its place in its slice.

Defined results: a null source is a source of its own; null texts count no bytes; rows that are
equal in all of id, source and text may change places with each other, which changes nothing; an
empty table gives an empty table; very long texts are only read for their size and checksum, where they lie; other columns,
whatever their names, are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Rows that one slice of a window holds on average, at most.
SLICE_ROWS = 100_000


def _ranked(df: DataFrame, group: list[str], slice_col: str, order: list, rank: str) -> DataFrame:
    """``df`` with the rank (from 1) in its group: slices in order, then ``order`` within the slice."""
    counts = df.groupBy(*group, slice_col).agg(F.count("*").alias("_n"))
    before = counts.withColumn(
        "_before",
        F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    ).withColumn("_total", F.sum("_n").over(Window.partitionBy(*group)))
    keys = [*group, slice_col]
    right = before.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_before", "_total")
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    placed = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))
    return placed.join(right, on).withColumn(rank, F.col(rank) + F.col("_before")).drop(*[f"_k{i}" for i in range(len(keys))], "_before")


def shard_documents(
    docs: DataFrame, n_shards: int = 16, seed: int = 20240117, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text"
) -> DataFrame:
    """One row a document: doc_id, source, size, text_crc32, shard and slot (its place in the shard, from 0).

    Only ids, sources and two numbers are shuffled, never texts. ``docs`` is read once to count and
    once to place its rows.
    """
    q = lambda c: F.col(f"`{c}`")
    total = docs.select(F.lit(1)).count()
    slices = max(1, -(-total // SLICE_ROWS)) * 4
    rows = docs.select(
        q(id_col).alias("doc_id"),
        q(source_col).alias("source"),
        (F.coalesce(F.octet_length(q(text_col)), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.coalesce(q(text_col), F.lit(""))).alias("text_crc32"),
    ).withColumn("_h", F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size"))
    rows = cut(rows.withColumn("_slice", F.pmod("_h", F.lit(slices))))
    ranked = _ranked(rows, ["source"], "_slice", ["_h", "doc_id", "text_crc32", "size"], "_rank")
    ranked = ranked.withColumn("_share", (F.col("_rank") * 2 - 1) / (F.col("_total") * 2)).drop("_total", "_slice")
    ranked = cut(ranked.withColumn("_slice", F.floor(F.col("_share") * slices)).withColumn("_all", F.lit(0)))
    placed = _ranked(ranked, ["_all"], "_slice", ["_share", "source", "_h", "doc_id", "text_crc32", "size"], "_place")
    position = F.col("_place") - 1
    shard = F.expr(f"(_place - 1) * {n_shards} div _total")
    start = F.expr(f"(({n_shards} - 1) + _total * shard) div {n_shards}")
    return (
        placed.withColumn("shard", shard.cast("int"))
        .withColumn("slot", (position - start).cast("bigint"))
        .select("doc_id", "source", "size", "text_crc32", "shard", "slot")
    )
