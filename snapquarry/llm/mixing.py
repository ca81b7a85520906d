"""Mixing sources to target weights with hash-threshold histograms.

Every document gets a hash of its ``doc_id`` and text.  Sizes are summed by source and by the
leading bits of the hash.  The budget of a source ends in one bucket; only that bucket is
split by further bits, until the hashes are used up.  The last bucket that fits gives a
threshold, and a filter on the hash takes the documents: nothing is sorted, and a larger
budget takes a superset.  If the hash at the threshold is that of several equal rows, their
own numbers, hashed, are split in the same way, so that as many of them are taken as fit.

A target above the source's size repeats it: whole copies first, then the share of the
rest below the threshold.

Defined results: a null or blank text has size 0; null is a source like any other and
comes last; equal ``doc_id`` values, or null ones, are told apart by their texts, and of rows
equal in both as many are taken as the budget allows, no matter which; ``take`` does that in
expectation, row by row; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialise, table

#: Bits of the hash and bits told apart by each histogram.
HASH_BITS, LEVEL_BITS = 60, 10


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def document_hash(doc_id: Column, text: Column) -> Column:
    """60 bits, the same in any engine: the first 15 hexadecimal digits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``source``, ``source_size``, ``target``: one row for each source.

    The level at which targets ``min(most * size, weight * level)`` add up to the budget is
    found from sums in the order of ``size / weight``, which is the limit of sharing the
    excess again and again.  There is one row for each source, so the windows are small.
    """
    everything = Window.partitionBy()
    named = sizes.withColumn("nth", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighed = named.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int")))
    weighed = weighed.withColumn("total", F.sum("source_size").over(everything)).withColumn("all_weight", F.sum("weight").over(everything))
    before = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("nth")).rowsBetween(Window.unboundedPreceding, -1)
    levels = weighed.withColumn("capped", F.coalesce(F.sum("source_size").over(before), F.lit(0)).cast("double") * most).withColumn("gone", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levels = levels.withColumn("level", (F.col("total") * share - F.col("capped")) / (F.col("all_weight") - F.col("gone")))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("source_size") * most, F.col("level"))
    found = levels.withColumn("level", F.coalesce(F.min_by(fits, F.when(fits.isNotNull(), F.col("gone"))).over(everything), F.lit(float("inf"))))
    return found.select("source", "source_size", F.least(F.col("level") * F.col("weight"), F.col("source_size") * F.lit(float(most))).alias("target"))


def _refine(rows: DataFrame, state: DataFrame, digits: str, name: str) -> DataFrame:
    """The threshold on the numbers ``digits`` of ``rows``, whose sizes beyond ``spent`` must fit the budget.

    ``state`` has ``s``, ``budget`` and ``spent``; the result also ``low``, and as ``spent`` what
    lies below it.  Each level sums the boundary bucket of each source by the next bits; what
    a histogram holds is at most 1,024 rows for each source.
    """
    state = state.select("s", "budget", "spent", F.lit(0).cast("long").alias("low"))
    for level in range(HASH_BITS // LEVEL_BITS):
        shift = HASH_BITS - LEVEL_BITS * (level + 1)
        inside = rows.join(state, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright(digits, shift + LEVEL_BITS) == F.shiftright("low", shift + LEVEL_BITS)))
        sums = inside.groupBy("s", "budget", "low", "spent", F.shiftright(digits, shift).alias("bucket")).agg(F.sum("size").alias("size"))
        running = sums.withColumn("upto", F.col("spent") + F.sum("size").over(Window.partitionBy("s").orderBy("bucket")))
        # the first bucket that does not fit whole; past the last one if all fit
        over = F.when(F.col("upto") > F.col("budget"), F.col("bucket"))
        found = running.groupBy("s", "budget", "low", "spent").agg(
            F.min(over).alias("edge"), F.max(F.when(F.col("upto") <= F.col("budget"), F.col("upto"))).alias("fit"), F.max("bucket").alias("last")
        )
        state = materialise(found.select("s", "budget", F.coalesce("fit", "spent").alias("spent"), F.shiftleft(F.coalesce("edge", F.col("last") + 1), shift).alias("low")), f"{name}{level}")
    return state


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """``source``, ``threshold``, ``next`` and ``part``: hashes below ``threshold`` have sizes that add up to the budget at most.

    ``budgets`` has ``source`` and ``budget``.  Of rows whose hash is the threshold, those with
    numbers below ``next`` still fit, which is ``part`` of them; there are some only if rows are equal.
    """
    state = _refine(sized, budgets.select(F.col("source").alias("s"), "budget", F.lit(0).cast("long").alias("spent")), "hash", "mix-level")
    state = state.withColumnRenamed("low", "threshold")
    edge = sized.join(state, F.col("source").eqNullSafe(F.col("s")) & (F.col("hash") == F.col("threshold")))
    equal = materialise(edge.groupBy("s", "budget", "spent", "threshold").agg(F.count("*").alias("n"), F.sum("size").alias("all")).where("n > 1 AND all > 0"), "mix-ties")
    out = state.select(F.col("s").alias("source"), "threshold")
    if equal.isEmpty():
        return out.withColumn("next", F.lit(0).cast("long")).withColumn("part", F.lit(0.0))
    tied = sized.join(equal.select(F.col("s").alias("of"), "threshold"), F.col("source").eqNullSafe(F.col("of")) & (F.col("hash") == F.col("threshold"))).select("source", "size", "number")
    split = _refine(tied, equal.select("s", "budget", "spent"), "number", "mix-tie")
    before = equal.select(F.col("s").alias("s0"), F.col("spent").alias("before"), "all")
    split = split.join(before, F.col("s").eqNullSafe(F.col("s0"))).select("s", F.col("low").alias("next"), ((F.col("spent") - F.col("before")) / F.col("all")).alias("part"))
    return out.join(split, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "threshold", F.coalesce("next", F.lit(0)).alias("next"), F.coalesce("part", F.lit(0.0)).alias("part"))


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target``, ``taken`` and ``copies`` for every row of ``docs``."""
    return _mix(docs, weights, share, most, ())


def _mix(docs: DataFrame, weights: Sequence[float], share: float, most: float, keep: Sequence[str]) -> DataFrame:
    number = F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - HASH_BITS)
    sized = materialise(docs.select("doc_id", F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size"), document_hash(F.col("doc_id"), F.col("text")).alias("hash"), number.alias("number")), "mix-sizes")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = materialise(targets(sizes, weights, share, most), "mix-targets")
    # least() keeps a quotient that was rounded up from adding a copy beyond the limit
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    goal = goal.withColumn("whole", F.floor(ratio)).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    edges = thresholds(sized, goal.where("source_size > 0 AND budget > 0").select("source", "budget"))
    edges = edges.select(F.col("source").alias("s2"), "threshold", "next", "part")
    plan = goal.join(edges, F.col("source").eqNullSafe(F.col("s2")), "left").select(F.col("source").alias("s"), "source_size", "target", "whole", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("threshold", "next", "part")])
    # written, the plan has a known size: one row for each source, broadcast below Spark's threshold
    plan = materialise(plan.coalesce(1), "mix-plan")
    if not keep:
        copies = F.col("whole") + ((F.col("hash") < F.col("threshold")) | ((F.col("hash") == F.col("threshold")) & (F.col("number") < F.col("next")))).cast("long")
        return sized.join(plan, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))
    plan = plan.select(F.col("s").alias("_s"), *[F.col(c).alias(f"_{c}") for c in ("whole", "threshold", "part")])
    hashed = document_hash(docs["doc_id"], docs["text"])
    copies = F.col("_whole") + ((hashed < F.col("_threshold")) | ((hashed == F.col("_threshold")) & (F.rand(5) < F.col("_part")))).cast("long")
    mixed = docs.join(plan, docs["source"].cast("string").eqNullSafe(F.col("_s"))).select(F.struct(*[docs[c] for c in keep]).alias("kept"), copies.cast("int").alias("copies"))
    return mixed.where("copies > 0")


def take(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The mixed rows themselves: each row of ``docs`` as often as the mix takes it."""
    columns = docs.columns
    mixed = _mix(docs, weights, share, most, columns)
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("kept.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS hash
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
         row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM sizes),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(source_size) OVER w, 0)::DOUBLE * 2.0::DOUBLE)
            / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS lev, coalesce(sum(weight) OVER w, 0) AS gone
  FROM weighed WINDOW w AS (ORDER BY source_size / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
best AS (SELECT coalesce(min_by(lev, gone), 'inf'::DOUBLE) AS lev FROM levels WHERE lev * weight <= source_size * 2.0),
goal AS (SELECT l.source, l.source_size, least(best.lev * l.weight, l.source_size * 2.0::DOUBLE) AS target FROM levels l, best),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(least(target / source_size, 2.0))::BIGINT ELSE 0 END AS whole FROM goal),
ranked AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.whole,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.hash ROWS UNBOUNDED PRECEDING) AS upto
  FROM sized s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       size * (whole + CASE WHEN source_size > 0 AND target > whole * source_size AND upto <= target - whole * source_size THEN 1 ELSE 0 END) AS taken,
       whole + CASE WHEN source_size > 0 AND target > whole * source_size AND upto <= target - whole * source_size THEN 1 ELSE 0 END AS copies
FROM ranked
"""
