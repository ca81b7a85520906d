"""Packs: assignment, offsets, liveness, compaction plans."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEADER = 8
TARGET = 16 << 20
THRESHOLD = 0.5


def assign_buckets(chunks: DataFrame, size: str, target: int, order: Sequence[str], within: Sequence[str] = (), block: Column | None = None) -> DataFrame:
    """``pack_no`` by the running size before each chunk over ``target``.

    ``within`` splits the order into independent parts (say, one for each walked root).
    ``block`` never falls along the order and cuts each part into stretches that tasks can
    hold: sizes are summed by stretch first, the few sums are added up in order, and each
    stretch starts from its sum, so that a large part isn't one task's.
    """
    if block is None:
        w = Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return chunks.withColumn("pack_no", F.floor(F.coalesce(F.sum(size).over(w), F.lit(0)) / target).cast("long"))
    rows = chunks.withColumn("_block", block)
    along = Window.partitionBy(*within).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*within, "_block").agg(F.sum(size).alias("_sum"))
    sums = sums.select(*[F.col(c).alias(f"_in{i}") for i, c in enumerate(within)], F.col("_block").alias("_at"), F.coalesce(F.sum("_sum").over(along), F.lit(0)).alias("_before"))
    same = F.col("_block").eqNullSafe(F.col("_at"))
    for i, c in enumerate(within):
        same = same & F.col(c).eqNullSafe(F.col(f"_in{i}"))
    inside = Window.partitionBy(*within, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_before") + F.coalesce(F.sum(size).over(inside), F.lit(0))
    return rows.join(sums, same).select(*chunks.columns, F.floor(before / target).cast("long").alias("pack_no"))


def assign_exact(chunks: DataFrame, size: str, target: int, order: Sequence[str], group: str) -> DataFrame:
    """``pack_no`` of a packer that closes a pack once it holds ``target`` bytes, header included.

    The running sum starts again with each pack, which no window can say; it is computed in
    the order of each ``group``, in a stream of batches.
    """
    rows = chunks.repartition(group).sortWithinPartitions(group, *order)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in chunks.schema)}, pack_no long"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, no, held = object(), 0, HEADER
        for frame in frames:
            numbers = []
            for g, n in zip(frame[group], frame[size], strict=True):
                if g != last:
                    last, no, held = g, 0, HEADER
                numbers.append(no)
                held += n
                if held >= target:
                    no, held = no + 1, HEADER
            yield frame.assign(pack_no=numbers)

    return rows.mapInPandas(run, schema)


def offsets(chunks: DataFrame, pack: str | Sequence[str], size: str, order: Sequence[str]) -> DataFrame:
    """``offset`` of each chunk in its pack, behind the header."""
    keys = [pack] if isinstance(pack, str) else list(pack)
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("offset", (F.coalesce(F.sum(size).over(w), F.lit(0)) + HEADER).cast("long"))


def summary(chunks: DataFrame, pack: str, size: str) -> DataFrame:
    return chunks.groupBy(pack).agg((F.sum(size) + HEADER).cast("long").alias("size"), F.count("*").alias("chunk_count"))


def flag_live(chunks: DataFrame, live: DataFrame) -> DataFrame:
    known = live.select("hash", F.lit(True).alias("live"))
    return chunks.join(known, "hash", "left").withColumn("live", F.coalesce("live", F.lit(False)))


def liveness(flagged: DataFrame) -> DataFrame:
    """Live and all indexed chunks of each pack."""
    return flagged.groupBy("pack_id").agg(F.count("*").alias("total"), F.count_if("live").alias("live_n"))


def classify(per_pack: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``dead`` without live chunks, ``candidate`` if fewer than the share of ``threshold`` are live, else ``keep``."""
    threshold = threshold if threshold > 0 else THRESHOLD
    return per_pack.withColumn("class", F.when(F.col("live_n") == 0, "dead").when(F.col("live_n") / F.col("total") < threshold, "candidate").otherwise("keep"))


def dead_chunks(chunks: DataFrame, live: DataFrame) -> DataFrame:
    return chunks.join(live, "hash", "left_anti")


def compacted_chunks(flagged: DataFrame, classes: DataFrame, relocated: DataFrame) -> DataFrame:
    """The chunk index after compaction: kept packs as they are, live chunks of candidates at new places."""
    joined = flagged.join(classes.select("pack_id", "class"), "pack_id")
    columns = ["hash", "pack_id", "offset", "comp_length", "length"]
    moved = joined.where("class = 'candidate' AND live").select("hash").join(relocated, "hash")
    return joined.where("class = 'keep'").select(*columns).unionByName(moved.select(*columns))


def compacted_packs(packs: DataFrame, classes: DataFrame, new: DataFrame) -> DataFrame:
    retired = classes.where("class <> 'keep'").select("pack_id")
    return packs.join(retired, "pack_id", "left_anti").unionByName(new)


def reclaimed(packs: DataFrame, classes: DataFrame, new: DataFrame) -> DataFrame:
    """One row: bytes of retired packs less bytes of new ones."""
    old = packs.join(classes.where("class <> 'keep'"), "pack_id", "left_semi").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("o"))
    return old.crossJoin(new.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n"))).select((F.col("o") - F.col("n")).cast("long").alias("bytes_reclaimed"))
