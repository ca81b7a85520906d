"""N-gram Jaccard join with Bayesian pruning of candidates.

1. Each text becomes its set of five-word shingles; texts with equal sets are one class.
2. Classes that agree in a band of five MinHash values meet in that band's bucket.  Two sets
   of similarity 0.8 miss each other in all 25 bands with probability 5e-5, closer ones
   more rarely.
3. Within a bucket MinHash values (four bits of each) are compared 16 at a time.  A pair goes
   when the posterior probability (uniform prior) that its similarity reaches the threshold
   falls below ``tolerance``.  Only what stays connects: the components are candidate
   groups, so texts that merely share a passage form none.
4. The pairs within a group are verified by the exact sizes of intersection and union.  A
   group is cut into blocks bounded by number and by shingles; each pair of blocks is a
   piece of work of its own, so no group is a task's alone.

Buckets hold numbers and sketches; shingle sets are made for members of candidate groups
only.  Tasks return the number of links of each class and one link to the smallest class
reached, never pairs, so the output is of the order of the classes however many pairs there
are.

Defined results: a text that is null, empty or without words links with nothing and is a
class of its own; rows with equal texts, or equal ``doc_id``, or a null ``doc_id``, are
documents of their own with a row each; one row of each component is kept, the one with the
smallest ``doc_id`` (nulls last), of equal ids the one with the smallest hash of its text, of
equal rows any one; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .candidates import candidate_groups, pairs_of_blocks
from .components import connected_components
from .runs import fixed_width, single_runs, smallest_linked
from .shared import drop_table, map_arrow, materialise, table
from .shingles import MinHash, shingle_sets, text_slices

HASHES, ROWS, STEP = 128, 5, 16
#: Shingles of a block of a candidate group, unless a single set has more.
_BLOCK_SHINGLES = 1 << 20


def class_key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def least_matches(threshold: float, tolerance: float, hashes: int = HASHES, step: int = STEP) -> list[int]:
    """How many of the first 16, 32, ... values must agree.

    With a uniform prior the posterior of the similarity after m of n agree is Beta(m + 1,
    n - m + 1), and its mass above t is the chance of at most m successes in n + 1 trials.
    """
    out = []
    for n in range(step, hashes + 1, step):
        mass = 0.0
        for m in range(n + 2):
            mass += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if mass >= tolerance:
                out.append(m)
                break
    return out


def sketch(signature: np.ndarray) -> np.ndarray:
    """Four bits of each MinHash value.  They agree by chance too, so no pair is dropped for using them."""
    low = signature.astype(np.uint8) & 15
    return low[::2] << 4 | low[1::2]


def band_hashes(signature: np.ndarray) -> np.ndarray:
    """A number for each band of MinHash values."""
    bands = HASHES // ROWS
    turns = MinHash(ROWS, seed=5).turns
    mixed = ((signature[: bands * ROWS].reshape(bands, ROWS).astype(np.uint64) + np.uint64(1)) * turns).sum(axis=1, dtype=np.uint64)
    mixed ^= mixed >> np.uint64(29)
    return ((mixed + np.arange(bands, dtype=np.uint64)) * turns[0]).view(np.int64)


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def signatures(docs: DataFrame) -> DataFrame:
    """``row``, ``doc_id``, ``text_hash``, ``key`` of the class (null without words), number of shingles ``size``, ``sketch`` and ``bands``."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = MinHash(HASHES)
        for batch in batches:
            for a, b, texts in text_slices(batch):
                rows: list[tuple] = []
                for s in shingle_sets(texts):
                    if len(s):
                        signature = minhash.signature(s)
                        rows.append((class_key(s), len(s), sketch(signature).tobytes(), band_hashes(signature)))
                    else:
                        rows.append((None, 0, None, None))
                keys, sizes, sketches, bands = zip(*rows, strict=True)
                kept = [batch.column(c).slice(a, b - a) for c in ("row", "doc_id", "text_hash")]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    ["row", "doc_id", "text_hash", "key", "size", "sketch", "bands"],
                )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_hash(F.col("text")).alias("text_hash"), "text")
    return map_arrow(rows, sign, "row long, doc_id long, text_hash long, key binary, size long, sketch binary, bands array<long>")


def _node(key: str) -> Column:
    """A class in the search for candidates.  Two keys with one node only share a group of candidates."""
    return F.xxhash64(key)


def possible_values(ids: DataFrame, column: str, most_bits: int = 24) -> Callable[[Column], Column]:
    """A Bloom filter of at most 2 MiB on a column: whether a value may be among ``ids``.

    It spares the shuffle of most texts.  With more ids than it was made for it lets more
    through, and the join behind it decides.
    """
    bits = 1 << min(most_bits, max(10, (16 * ids.count()).bit_length()))
    places = lambda c: [F.pmod(F.xxhash64(c, F.lit(k)), F.lit(bits)) for k in range(2)]
    word = ids.select(F.explode(F.array(*places(F.col(column)))).alias("at")).groupBy(F.shiftright("at", 6).alias("word"))
    rows = word.agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("bits")).collect()
    table_ = np.zeros(bits // 64, np.uint64)
    table_[[r["word"] for r in rows]] = np.array([r["bits"] for r in rows], np.int64).view(np.uint64)
    sent = ids.sparkSession.sparkContext.broadcast(table_)

    @F.pandas_udf("boolean")
    def may(one: pd.Series, two: pd.Series) -> pd.Series:
        test = lambda s: sent.value[s.to_numpy() >> 6] >> (s.to_numpy() & 63).astype(np.uint64) & np.uint64(1) == 1
        return pd.Series(test(one) & test(two))

    return lambda c: may(*places(c))


def alike(threshold: float, tolerance: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Which pairs of sketches the posterior does not rule out, looked at step by step."""
    needed = least_matches(threshold, tolerance)

    def test(one: np.ndarray, two: np.ndarray) -> np.ndarray:
        left, matches = np.arange(len(one)), np.zeros(len(one), np.int32)
        for step, least in enumerate(needed):
            part = slice(step * STEP // 2, (step + 1) * STEP // 2)
            apart = one[left, part] ^ two[left, part]
            matches = matches + np.count_nonzero(apart < 16, axis=1) + np.count_nonzero(apart & 15 == 0, axis=1)
            stays = matches >= least
            left, matches = left[stays], matches[stays]
            if not len(left):
                break
        out = np.zeros(len(one), bool)
        out[left] = True
        return out

    return test


def _verified(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of sets reach the threshold, exactly."""
    sizes = np.array([len(s) for s in sets])
    both = np.empty(len(i), np.int64)
    if len(i) > 1000:
        # many pairs among few sets: intersections as products of a presence matrix, by column slices
        used = np.unique(np.concatenate([i, j]))
        row = np.zeros(len(sets), np.int64)
        row[used] = np.arange(len(used))
        owner = np.repeat(np.arange(len(used)), sizes[used])
        _, column = np.unique(np.concatenate([sets[u] for u in used]), return_inverse=True)
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        product = np.zeros((len(used), len(used)), np.float32)
        for a in range(0, int(column[-1]) + 1, 4096):
            inside = slice(*np.searchsorted(column, [a, a + 4096]))
            m = np.zeros((len(used), 4096), np.float32)
            m[owner[inside], column[inside] - a] = 1
            product += m @ m.T
        both[:] = np.rint(product[row[i], row[j]])
    else:
        for k, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
            both[k] = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
    return both / (sizes[i] + sizes[j] - both) >= threshold


def _verify(threshold: float, tolerance: float, group: list[str]):
    test = alike(threshold, tolerance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in single_runs(batches, group):
            keys = rows.column("key").to_pylist()
            once = [k for k in range(len(keys)) if not k or keys[k] != keys[k - 1]]  # a class of equal rows may come from several tasks
            if len(once) < 2:
                continue
            if len(once) < len(keys):
                rows, keys = rows.take(pa.array(once)), [keys[k] for k in once]
            own, copies = rows.column("own").to_numpy(), rows.column("copies").to_numpy()
            x, y = rows.column("x")[0].as_py(), rows.column("y")[0].as_py()
            sketches, raw = fixed_width(rows.column("sketch"), np.uint8, HASHES // 2), rows.column("shingles")
            one, two = (np.arange(len(keys)),) * 2 if x == y else (np.flatnonzero(own == x), np.flatnonzero(own == y))
            ones, twos = [], []
            for k, r in enumerate(one.tolist()):
                other = two[k + 1 :] if x == y else two
                other = other[test(np.broadcast_to(sketches[r], (len(other), HASHES // 2)), sketches[other])]
                ones.append(np.full(len(other), r))
                twos.append(other)
            i, j = np.concatenate(ones), np.concatenate(twos)
            if not len(i):
                continue
            wanted = set(i.tolist()) | set(j.tolist())
            sets = [np.frombuffer(raw[k].as_buffer(), np.uint64) if k in wanted else np.zeros(0, np.uint64) for k in range(len(keys))]
            keep = _verified(sets, i, j, threshold)
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            n = np.bincount(i, copies[j], len(keys)) + np.bincount(j, copies[i], len(keys))
            roots = smallest_linked(len(keys), i, j)
            at = np.flatnonzero(n).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([keys[k] for k in at], pa.binary()), pa.array([keys[roots[k]] for k in at], pa.binary()), pa.array(n[at].astype(np.int64))], ["a", "b", "n"])

    return run


def _groups(signed: DataFrame, threshold: float, tolerance: float, block: int) -> DataFrame:
    """``node`` and ``group`` of the classes whose sketches are like another's."""
    worded = signed.where("key IS NOT NULL").select(_node("key").alias("node"), "sketch", "bands")
    entries = worded.select("node", F.explode("bands").alias("band"))
    met = entries.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    met = materialise(met.select("band"), "ngram-met")
    possible = possible_values(met, "band")
    hits = materialise(entries.where(possible(F.col("band"))).join(met, "band", "left_semi").select("band", "node").distinct(), "ngram-hits")
    meeting = hits.select("node").distinct()
    sketches = worded.join(meeting, "node", "left_semi").groupBy("node").agg(F.max("sketch").alias("sketch"))
    entries = hits.join(sketches, "node").select("band", "node", "sketch")
    out = candidate_groups(entries, ["band"], alike(threshold, tolerance), np.uint8, HASHES // 2, "ngram", block, bare=hits)
    drop_table(hits)
    drop_table(met)
    return out


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sketch and shingles of the texts of candidate groups."""
    minhash, seen = MinHash(HASHES), set()
    for batch in batches:
        wanted = batch.column("key").to_pylist()
        for a, b, texts in text_slices(batch):
            # a class comes once from each task, and from a text that is really its own
            found = [(k, s) for k, s in zip(range(a, b), shingle_sets(texts), strict=True) if class_key(s) == wanted[k] and not (wanted[k] in seen or seen.add(wanted[k]))]
            at = pa.array([k for k, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(at) for c in ("key", "copies", "group", "blocks")), pa.array([sketch(minhash.signature(s)).tobytes() for _, s in found], pa.binary()), pa.array([s.tobytes() for _, s in found], pa.binary())],
                ["key", "copies", "group", "blocks", "sketch", "shingles"],
            )


def _links(docs: DataFrame, classes: DataFrame, groups: DataFrame, threshold: float, tolerance: float, block: int) -> DataFrame:
    """Verified links: each class's number of linked documents, and the smallest class that its block's links reach."""
    found_in = classes.withColumn("node", _node("key")).join(groups, "node")
    blocks = F.ceil(F.greatest(F.count("*") / block, F.sum("size") / _BLOCK_SHINGLES)).cast("int")
    sizes = found_in.groupBy("group").agg(blocks.alias("blocks"))
    members = materialise(found_in.join(sizes, "group").select("key", "first.doc_id", "first.text_hash", "copies", "group", "blocks"), "ngram-members")
    # only the texts of classes in candidate groups are read again, each from the class's first row
    possible = possible_values(members, "doc_id")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), text_hash(F.col("text")).alias("hash"), "text").where(possible(F.col("id")))
    again = texts.join(members, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash"))).select("text", "key", "copies", "group", "blocks")
    payload = map_arrow(again, _shingled, "key binary, copies long, group long, blocks int, sketch binary, shingles binary")
    pairs = pairs_of_blocks(payload, "key", F.col("blocks"), ["group"], ["key", "copies", "sketch", "shingles"])
    found = materialise(map_arrow(pairs, _verify(threshold, tolerance, ["group", "x", "y"]), "a binary, b binary, n long"), "ngram-links")
    drop_table(members)
    return found


def join(docs: DataFrame, threshold: float = 0.8, tolerance: float = 1e-6, block: int = 1024) -> DataFrame:
    """``doc_id``, ``text_hash``, ``class_id``, ``n_links``, ``component_id`` and ``kept`` for each row of ``docs`` (``doc_id``, ``text``).

    ``class_id``: smallest ``doc_id`` with the same shingles; ``n_links``: other documents of
    similarity ``threshold`` or more, those of the same class included; ``component_id``:
    smallest ``doc_id`` that links reach; ``kept``: whether this row stays if one document of
    each component does.
    """
    signed = materialise(signatures(docs), "ngram-signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "text_hash", "row"))
    classes = materialise(signed.where("key IS NOT NULL").groupBy("key").agg(first.alias("first"), F.count("*").alias("copies"), F.max("size").alias("size")), "ngram-classes")
    groups = _groups(signed, threshold, tolerance, block)
    found = _links(docs, classes, groups, threshold, tolerance, block)
    drop_table(groups)

    parts = connected_components(found.select("a", "b"), "ngram").select(F.col("node").alias("key"), F.col("component").alias("part"))
    links = found.groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("n"))
    known = classes.select("key", "first", "copies").join(links, "key", "left").join(parts, "key", "left").withColumn("part", F.coalesce("part", "key"))
    smallest = known.groupBy("part").agg(F.min("first").alias("least"))
    known = known.join(smallest, "part").select("key", F.col("first.doc_id").alias("class_id"), F.col("least.doc_id").alias("component_id"), F.col("least.row").alias("kept_row"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    known = materialise(known, "ngram-known")
    for gone in (found, parts, classes):
        drop_table(gone)
    linked = signed.where("key IS NOT NULL").join(known, "key").select("doc_id", "text_hash", "class_id", F.col("n_links").cast("long").alias("n_links"), "component_id", (F.col("row") == F.col("kept_row")).alias("kept"))
    alone = signed.where("key IS NULL").select("doc_id", "text_hash", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return linked.unionByName(alone)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text_hash")


# Every pair of documents by their shingles; ids are unique in the tables that this is run on.
ORACLE = r"""
WITH RECURSIVE
d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1) + 1))) AS i FROM d)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.r <> b.r GROUP BY ALL),
l AS (SELECT a, b, c = x.n AND c = y.n AS same FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE c / (x.n + y.n - c) >= 0.8),
reach(a, b) AS (SELECT r, r FROM d UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
root AS (SELECT a AS r, min(b) AS component FROM reach GROUP BY a),
links AS (SELECT a AS r, count(*) AS n_links, min(b) FILTER (same) AS twin FROM l GROUP BY a)
SELECT d.doc_id, t.doc_id AS class_id, coalesce(n_links, 0)::BIGINT AS n_links, c.doc_id AS component_id, d.r = component AS kept
FROM d JOIN root USING (r) LEFT JOIN links USING (r) JOIN d t ON t.r = least(d.r, coalesce(twin, d.r)) JOIN d c ON c.r = component
"""
