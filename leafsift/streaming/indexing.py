"""Leaflets that arrive as a stream are indexed in micro-batches; counting by event time bounds late rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leafsift.operators.index import index_leaflets
from leafsift.operators.models import HashingEmbedder


def index_stream(stream: DataFrame, chunks_path: str, documents_path: str, checkpoint: str, make: Callable = HashingEmbedder) -> StreamingQuery:
    """Run the incremental indexing on every micro-batch; a repeated batch adds nothing."""

    def batch(df: DataFrame, _: int) -> None:
        index_leaflets(df.sparkSession, df, chunks_path, documents_path, make)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals(stream: DataFrame, at: str, late: str = "90 days", window: str = "1 day") -> DataFrame:
    """Rows per window of event time; rows later than ``late`` behind the newest are dropped by the watermark."""
    return stream.withWatermark(at, late).groupBy(F.window(at, window).alias("janela")).agg(F.count("*").alias("linhas"))
