"""Fetching as a stream: request files arrive in a folder, each micro-batch is fetched and committed."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from skylattice.operators.fetch import run_fetch
from skylattice.operators.tiles import unique_tiles


def fetch_stream(spark: SparkSession, requests: str, schema: str, client, out: str, checkpoint: str, once: bool = True, **options) -> StreamingQuery:
    """Start the stream. A batch is reduced to unique tiles, those done in earlier batches are left out, tiles are
    appended before their status; a replayed batch fetches only what its first try didn't commit."""

    def commit(batch, _):
        run_fetch(unique_tiles(batch), client, out, **options)

    writer = spark.readStream.schema(schema).parquet(requests).writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
