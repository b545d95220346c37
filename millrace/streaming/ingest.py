"""Streams of blobs into a chunk store: chunk, then write what the store lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from millrace.functions.rolling import Sizes
from millrace.operators.chunking import chunk_index
from millrace.operators.stores import to_store


def ingest(blobs: DataFrame, store: str, indexes: str, checkpoint: str, sizes: Sizes, **trigger) -> StreamingQuery:
    """Write new chunks (id, payload) below `store` and the blobs' indexes below `indexes`, both Parquet.

    A micro-batch is chunked once. Ids it repeats and ids the store has are left out by an anti-join; batches that
    run again after a failure replace what they wrote (each writes a folder of its own), so nothing doubles.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        chunks = chunk_index(df, sizes, payload=True).persist()
        try:
            new = chunks.select("id", "payload").dropDuplicates(["id"])
            if (held := stored(spark, store, number)) is not None:
                new = to_store(new, held)
            new.write.mode("overwrite").parquet(f"{store}/batch={number}")
            chunks.drop("payload").write.mode("overwrite").parquet(f"{indexes}/batch={number}")
        finally:
            chunks.unpersist()

    return blobs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stored(spark, store: str, before: int) -> DataFrame | None:
    """Ids that earlier batches wrote, or None if there are none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    if not before or not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema("id string, payload binary, batch long").parquet(store).where(f"batch < {before}").select("id")
