"""Stateless detection over frames that arrive as files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..engine import MarkerEngine
from ..sources.netpbm import read_image_stream


def detections_stream(engine: MarkerEngine, folder: str) -> DataFrame:
    return engine.detect(read_image_stream(engine.spark, folder).filter("buf IS NOT NULL"))


def start(engine: MarkerEngine, folder: str, sink: str, checkpoint: str, every: str = "5 seconds") -> StreamingQuery:
    """Appends detections to Parquet files in sink, each frame once."""
    out = detections_stream(engine, folder).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
    return out.outputMode("append").trigger(processingTime=every).start()
