"""Questions about a catalog that are one query each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dedup_ratio(pieces: DataFrame, by: str, size: str, order: list[str]) -> DataFrame:
    """Bytes before and after deduplication; a shared chunk counts where it stands first."""
    first = F.row_number().over(Window.partitionBy("hash").orderBy(*order)) == 1
    flagged = pieces.withColumn("_first", first)
    return flagged.groupBy(by).agg(
        F.count("*").alias("chunks"), F.count_if("_first").alias("unique_chunks"), F.sum(size).cast("long").alias("logical_bytes"),
        F.coalesce(F.sum(F.when(F.col("_first"), F.col(size))), F.lit(0)).cast("long").alias("unique_bytes"),
    )


def growth(rows: DataFrame, bucket: Column, size: str) -> DataFrame:
    """Bytes added in each bucket of time and in total so far."""
    per = rows.groupBy(bucket.alias("bucket")).agg(F.sum(size).cast("long").alias("added"))
    return per.withColumn("total", F.sum("added").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)).cast("long"))


def largest(nodes: DataFrame, n: int = 10) -> DataFrame:
    return nodes.orderBy(F.desc("size"), "path").limit(n)


def changed_since(nodes: DataFrame, ns: int) -> DataFrame:
    return nodes.where(F.col("mtime") > ns)


def mostly_dead(liveness: DataFrame, share: float = 0.5) -> DataFrame:
    return liveness.where(F.col("live_n") / F.col("total") < share)
