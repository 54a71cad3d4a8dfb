"""An extension: route requests as a stream, checked and placed on the static road graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators.routing import route


def parsed_requests(requests: DataFrame) -> DataFrame:
    """Streaming or static (request_id, coordinates): request_id, points, error. Stateless, so it runs in any output mode."""
    c = requests.select("request_id", text.parse_coordinates(F.col("coordinates")).alias("c"))
    return c.select("request_id", "c.points", "c.error")


def answer_stream(requests: DataFrame, lines: DataFrame, nodes: DataFrame, path: str, checkpoint: str):
    """Starts a query that answers each micro-batch of requests as one batch and appends it to ``path`` as Parquet."""

    def answer(batch: DataFrame, batch_id: int) -> None:
        route(batch, lines, nodes).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return requests.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).start()
