"""Lineage cuts and size checks that the operators share."""

from __future__ import annotations

import logging
import tempfile
import time
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

log = logging.getLogger("waygraph")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the session's checkpoint folder (spark.checkpoint.dir); one is made only where none is set, on one machine."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ckpt-"))
    return df.checkpoint(eager=True)


def at_most(df: DataFrame, rows: int) -> bool:
    """Has ``df`` at most that many rows? Reads no more than one row beyond; ``df`` should be cut."""
    return df.limit(rows + 1).count() <= rows


def bounded(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """``df`` with a broadcast hint if it is that small, else as it is. ``df`` should be cut."""
    return F.broadcast(df) if at_most(df, rows) else df


def tasks(df: DataFrame) -> int:
    """A fixed count, for work that is long for its bytes: partitions of a given number are not put together by size."""
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


@contextmanager
def stage_timer(name: str):
    """Logs how long the block took."""
    began = time.perf_counter()
    yield
    log.info("%s: %.1f s", name, time.perf_counter() - began)
