"""New chunks from a stream of chunk manifests.

Manifests arrive as Parquet files; each hash is passed on once.  State is one row for each
hash, kept by the stream's checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..schema import SCHEMAS


def new_chunks(spark: SparkSession, manifests: str) -> DataFrame:
    return spark.readStream.schema(SCHEMAS["chunks"]).parquet(manifests).dropDuplicates(["hash"])


def maintain_index(spark: SparkSession, manifests: str, index: str, checkpoint: str) -> StreamingQuery:
    """Append the new chunks of all manifests so far to ``index`` and stop."""
    return new_chunks(spark, manifests).writeStream.format("parquet").option("path", index).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
