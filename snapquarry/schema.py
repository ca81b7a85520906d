"""The five catalog tables, their defaults and typed views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Times are Unix nanoseconds; tags, annotations and source paths are JSON text.
SCHEMAS = {
    "snapshots": "id STRING, timestamp BIGINT, kind STRING, actor STRING, event_label STRING, tags STRING, parent_id STRING, host STRING, source_paths STRING, annotations STRING",
    "nodes": "snapshot_id STRING, path STRING, type STRING, mode BIGINT, uid BIGINT, gid BIGINT, size BIGINT, mtime BIGINT, symlink_target STRING, content_hash STRING, content_type STRING, embedding STRING",
    "nodechunks": "snapshot_id STRING, path STRING, seq BIGINT, hash STRING",
    "chunks": "hash STRING, pack_id STRING, offset BIGINT, comp_length BIGINT, length BIGINT",
    "packs": "pack_id STRING, size BIGINT, chunk_count BIGINT",
}
DEFAULT_KIND = "backup"
NODE_TYPES = ("file", "dir", "symlink")


def columns_of(table: str) -> list[tuple[str, str]]:
    return [tuple(c.split(" ")) for c in SCHEMAS[table].split(", ")]


def conform(df: DataFrame, table: str) -> DataFrame:
    """The table's columns by name; absent ones and nulls become ``""`` or 0, an empty kind the default."""
    out = []
    for name, kind in columns_of(table):
        zero = F.lit("") if kind == "STRING" else F.lit(0)
        c = F.coalesce(F.col(name), zero) if name in df.columns else zero
        if (table, name) == ("snapshots", "kind"):
            c = F.when(c == "", DEFAULT_KIND).otherwise(c)
        out.append(c.cast(kind).alias(name))
    return df.select(*out)


def typed_snapshots(df: DataFrame) -> DataFrame:
    """JSON columns as maps and arrays, and ``time`` beside the exact nanoseconds."""
    return (
        df.withColumn("tags", F.from_json("tags", "map<string,string>"))
        .withColumn("annotations", F.from_json("annotations", "map<string,string>"))
        .withColumn("source_paths", F.from_json("source_paths", "array<string>"))
        .withColumn("time", to_time(F.col("timestamp")))
    )


def to_time(ns: Column) -> Column:
    """A timestamp from nanoseconds; the part below a microsecond is lost."""
    return F.timestamp_micros(F.floor(ns / F.lit(1000).cast("decimal(4,0)")).cast("long"))


def to_ns(time: Column) -> Column:
    return F.unix_micros(time) * 1000
