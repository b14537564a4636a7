"""Streaming ingestion of chunks: exactly-once appends of digests not seen before, and sessions that time out."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cairnspark.operators.chunking import Policy, cdc_chunks, new_chunks


def ingest(files: DataFrame, store_path: str, checkpoint: str, policy: Policy = Policy()) -> StreamingQuery:
    """Appends the new content-defined chunks of a stream of files (path, content) to the Parquet store, each batch in a folder of its own, so that a repeated batch replaces itself.

    The store itself is the state, so none grows in memory, and a digest is stored once however far apart its files come.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        try:
            held = spark.read.option("recursiveFileLookup", True).schema("hash string, len int, data binary").parquet(store_path)
            held = held.where(~F.col("_metadata.file_path").contains(f"/batch-{number}/"))
        except AnalysisException as e:  # the first batch finds no store
            if "PATH_NOT_FOUND" not in str(e):
                raise
            held = spark.createDataFrame([], "hash string, len int, data binary")
        new_chunks(cdc_chunks(batch, policy), held).select("hash", "len", "data").write.mode("overwrite").parquet(f"{store_path}/batch-{number}")

    return files.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def session_totals(events: DataFrame, ttl: str = "1 hour") -> DataFrame:
    """remote, window, objects and bytes of transfer events (remote, ts, bytes) by session, closed after ttl without one."""
    return events.withWatermark("ts", ttl).groupBy("remote", F.session_window("ts", ttl).alias("window")).agg(F.count("*").alias("objects"), F.sum("bytes").alias("bytes"))
