"""Jobs of a stream of document versions: an extension, on top of the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.history import classify


def stream_versions(spark: SparkSession, folder: str) -> DataFrame:
    """Version rows (path, seq, hash, content) from Parquet files as they arrive in a folder."""
    return spark.readStream.schema("path string, seq long, hash string, content string").parquet(folder)


def start(
    versions: DataFrame, history: Callable[[], DataFrame], translations: Callable[[], DataFrame], targets: DataFrame, source_root: str, sink: Callable[[DataFrame, int], None], checkpoint: str
) -> StreamingQuery:
    """Classify the documents of each micro-batch against the whole history and hand the jobs to a sink.

    history and translations give their tables as they are when a batch runs. The batch's last version
    of a path is its source. A batch that is repeated after a failure gives the same jobs under the same number.
    """

    def batch(rows: DataFrame, number: int) -> None:
        sources = rows.groupBy("path").agg({"seq": "max"}).withColumnRenamed("max(seq)", "seq").join(rows, ["path", "seq"]).selectExpr("path", "content", "cast(null as string) instructions")
        sink(classify(sources, history(), translations(), targets, source_root), number)

    return versions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
