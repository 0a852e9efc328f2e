"""The ingest path as a stream: new documents are chunked as they come and added once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quillon.operators import nodes


def document_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1000) -> DataFrame:
    """Documents (doc_id, text) as their Parquet files arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def chunks(documents: DataFrame, size: int = 512, overlap: int = 50) -> DataFrame:
    """Chunk nodes of a stream; row-local, so there is no state to keep."""
    return nodes.fixed_size(nodes.roots(documents), size, overlap)


def index_stream(documents: DataFrame, target: str, checkpoint: str, size: int = 512, overlap: int = 50) -> StreamingQuery:
    """Write chunks of all available documents below `target`, exactly once by the file sink's log."""
    out = chunks(documents, size, overlap)
    return out.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals(documents: DataFrame, time_col: str, minutes: int = 5, late: int = 10) -> DataFrame:
    """Documents by window of event time, late ones let in for `late` minutes."""
    from pyspark.sql import functions as F

    return documents.withWatermark(time_col, f"{late} minutes").groupBy(F.window(time_col, f"{minutes} minutes").alias("w")).agg(F.count("*").alias("n")).select("w.start", "n")
