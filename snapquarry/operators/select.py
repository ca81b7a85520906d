"""Choosing snapshots: by id, prefix, time and event; lineage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Selector:
    """Event beats time beats id; ``before`` counts with an event only.  Times are nanoseconds."""

    id: str = ""
    at: int | None = None
    event: str = ""
    before: int | None = None


class SnapshotNotFound(LookupError):
    pass


class AmbiguousSnapshot(LookupError):
    pass


def latest(snapshots: DataFrame) -> DataFrame:
    """The newest snapshot; of equal times the larger id."""
    return snapshots.orderBy(F.desc("timestamp"), F.desc("id")).limit(1)


def at_time(snapshots: DataFrame, ns: int) -> DataFrame:
    return latest(snapshots.where(F.col("timestamp") <= ns))


def at_event(snapshots: DataFrame, event: str, before: int | None = None) -> DataFrame:
    found = snapshots.where(F.col("event_label") == event)
    return latest(found if before is None else found.where(F.col("timestamp") <= before))


def by_id(snapshots: DataFrame, text: str) -> DataFrame:
    """The exact id, or else all ids that start with ``text``: the caller checks how many there are."""
    rank = F.when(F.col("id") == text, 0).otherwise(1)
    return snapshots.where(F.col("id").startswith(text)).withColumn("_rank", rank).withColumn("_best", F.min("_rank").over(Window.partitionBy(F.lit(0)))).where("_rank = _best").drop("_rank", "_best")


def resolve(snapshots: DataFrame, selector: Selector) -> Row:
    """The snapshot that a selector means."""
    if selector.event:
        found = at_event(snapshots, selector.event, selector.before).collect()
        what = f"with event {selector.event!r}"
    elif selector.at is not None:
        found, what = at_time(snapshots, selector.at).collect(), "at or before that time"
    elif selector.id in ("", "latest"):
        found, what = latest(snapshots).collect(), "at all"
    else:
        matching = snapshots.where(F.col("id").startswith(selector.id))
        exact = matching.where(F.col("id") == selector.id).limit(1).collect()
        found, what = exact or matching.limit(2).collect(), f"with id {selector.id!r}"
        if len(found) > 1:
            raise AmbiguousSnapshot(f"{selector.id!r} begins the ids of {matching.count()} snapshots")
    if not found:
        raise SnapshotNotFound(f"no snapshot {what}")
    return found[0]


def asof(points: DataFrame, states: DataFrame, key: str, time: str, value: str, *, state_time: str | None = None) -> DataFrame:
    """For each point the last state of its key at or before its time.

    Points and states are stacked and the last state carried forward in one window: one
    shuffle on the key and no range join.  States come before points of the same time.
    """
    state_time = state_time or time
    p = points.select("*", F.lit(None).cast(states.schema[value].dataType).alias(f"_{value}"), F.col(time).alias("_t"), F.lit(1).alias("_side"))
    s = states.select(F.col(key), F.col(value).alias(f"_{value}"), F.col(state_time).alias("_t"), F.lit(0).alias("_side"))
    w = Window.partitionBy(key).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = p.unionByName(s, allowMissingColumns=True).withColumn(f"asof_{value}", F.last(f"_{value}", ignorenulls=True).over(w))
    return both.where("_side = 1").drop(f"_{value}", "_t", "_side")


def lineage(snapshots: DataFrame) -> DataFrame:
    """Each snapshot with its predecessor on the whole timeline."""
    return snapshots.withColumn("parent", F.lag("id").over(Window.orderBy("timestamp", "id")))


def latest_per_event(snapshots: DataFrame) -> DataFrame:
    return snapshots.where("event_label <> ''").groupBy("event_label").agg(F.max_by("id", F.struct("timestamp", "id")).alias("id"), F.max("timestamp").alias("timestamp"))


def ancestors(snapshots: DataFrame, id_: str) -> DataFrame:
    """The chain of recorded parents of a snapshot, by a recursive query."""
    snapshots.select("id", "parent_id").createOrReplaceTempView("_lineage_links")
    return snapshots.sparkSession.sql(
        "WITH RECURSIVE chain(id, parent_id, depth) AS (SELECT id, parent_id, 0 FROM _lineage_links WHERE id = :id"
        " UNION ALL SELECT l.id, l.parent_id, depth + 1 FROM chain JOIN _lineage_links l ON l.id = chain.parent_id) SELECT * FROM chain",
        args={"id": id_},
    )
