"""The catalog's tables projected from the test tables, so that each operator runs on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import hash_chunk
from ..operators import packs

PIECE = 1024
PACK_TARGET = 65536
BLOCK = 10  # bits of the documents whose sizes one task runs over


class Tables:
    """Reads on demand; nothing is read that a query does not use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def snapshots(self) -> DataFrame:
        """Events; nanoseconds from the microseconds of ``ts``."""
        e = self.raw("events")
        return e.select(F.col("event_id").cast("string").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("timestamp"), F.col("event_type").alias("event_label"), F.col("user_id").cast("string").alias("actor"), F.col("props").alias("tags"))

    def nodes(self) -> DataFrame:
        """Documents as files."""
        d = self.raw("documents")
        return d.select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), F.lit("file").alias("type"), F.octet_length("text").cast("long").alias("size"), hash_chunk(F.col("text")).alias("content_hash"), "doc_id", "source")

    def pieces(self) -> DataFrame:
        """Fixed-width pieces of documents in place of content-defined chunks."""
        d = self.raw("documents")
        numbers = F.sequence(F.lit(0), F.floor((F.greatest(F.length("text"), F.lit(1)) - 1) / PIECE).cast("int"))
        # hashed within the row: no row carries its text more than once
        hashed = F.transform(numbers, lambda i: self._piece(i.cast("long"), F.substr("text", i * PIECE + 1, F.lit(PIECE))))
        return d.select("doc_id", "source", F.explode(hashed).alias("piece")).select("doc_id", "source", "piece.*")

    @staticmethod
    def _piece(seq: Column, text: Column) -> Column:
        return F.struct(seq.alias("seq"), hash_chunk(text).alias("hash"), F.octet_length(text).cast("long").alias("length"))

    def chunks(self) -> DataFrame:
        """Distinct pieces in packs: the first place of each, packed by running size within each source."""
        first = self.pieces().groupBy("hash").agg(F.min(F.struct("doc_id", "seq", "source", "length")).alias("at")).select("hash", "at.*")
        placed = packs.assign_buckets(first, "length", PACK_TARGET, ["doc_id", "seq"], within=["source"], block=F.shiftright("doc_id", BLOCK))
        named = placed.withColumn("pack_id", F.concat_ws("-", "source", F.col("pack_no").cast("string")))
        return packs.offsets(named, "pack_id", "length", ["doc_id", "seq"]).withColumn("comp_length", F.col("length"))

    def surviving(self) -> DataFrame:
        """Pieces of the documents that were not forgotten: those with a bad label, in other languages than English, and of two sources, were."""
        bad = self.raw("labels").where("toxic = 1 OR quality = 0").select("doc_id")
        gone = self.raw("documents").where("lang <> 'en' OR source IN ('src1', 'src2')").select("doc_id")
        return self.pieces().join(bad.unionByName(gone), "doc_id", "left_anti")

    def version(self, before: str) -> DataFrame:
        """Orders up to a date as a file tree: one file for each customer."""
        o = self.raw("orders").where(F.col("o_orderdate") < F.to_timestamp_ntz(F.lit(before)))
        return o.groupBy(F.col("o_custkey").alias("path")).agg(F.count("*").alias("size"), F.unix_micros(F.max("o_orderdate").cast("timestamp")).alias("mtime"))
