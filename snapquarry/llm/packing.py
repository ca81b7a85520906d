"""Sequence packing by minimum bin slack.

A document longer than the window is cut into full windows, which need no packing, and
one remainder.  Remainders are counted by length: at most ``window - 1`` numbers, however
many documents there are.  For the longest remaining length a bitset subset-sum over the
multiset of remaining lengths finds the fill closest to the window; the counts of the fill
are backtracked, and the same fill is repeated as often as the multiset allows.  The plan is
a table of a few thousand rows at most, bounded by the window and not by the data.  Each
piece then finds its place from its rank among the pieces of its length, without a sort or
a shuffle of texts or ids.

Defined results: a null or empty text is a document of the end id alone; repeated rows are
documents of their own; a null ``doc_id`` is kept; an empty table gives no pieces; other
columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .encoder import encoder
from .shared import map_arrow, materialise, table
from .token_files import _slices


def _closest_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset taken from ``counts`` with the largest sum of at most ``room``.

    ``reach`` is a bitset of sums.  Each length enters as groups of 1, 2, 4, ... copies,
    and the bitset before each group is kept to walk back from the best sum.
    """
    mask, reach = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, group = min(counts[length], room // length), 1
        while left > 0:
            take = min(group, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            group *= 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            used[length] = used.get(length, 0) + take
    return used


def plan_fills(histogram: dict[int, int], window: int) -> list[tuple[int, dict[int, int]]]:
    """Fills and how often each is used: ``[(times, {length: copies}), ...]``."""
    counts = {k: v for k, v in histogram.items() if v > 0}
    fills = []
    while counts:
        longest = max(counts)
        rest = dict(counts)
        rest[longest] -= 1
        fill = _closest_fill({k: v for k, v in rest.items() if v}, window - longest)
        fill[longest] = fill.get(longest, 0) + 1
        times = min(counts[k] // c for k, c in fill.items())
        for k, c in fill.items():
            counts[k] -= c * times
            if not counts[k]:
                del counts[k]
        fills.append((times, fill))
    return fills


def _places(fills: list[tuple[int, dict[int, int]]]) -> tuple[dict[int, tuple], int]:
    """For each length: first ranks, and the copies, first sequence and offset of each fill that uses it."""
    places: dict[int, tuple[list, list, list, list]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for times, fill in fills:
        offset = 0
        for length in sorted(fill, reverse=True):
            ranks, copies, first, offsets = places.setdefault(length, ([], [], [], []))
            ranks.append(used.get(length, 0))
            copies.append(fill[length])
            first.append(sequence)
            offsets.append(offset)
            used[length] = used.get(length, 0) + fill[length] * times
            offset += length * fill[length]
        sequence += times
    return places, sequence


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, window: int) -> DataFrame:
    """One row for each piece, with its rank among the task's pieces of the same length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, end, ranks = TaskContext.get().partitionId(), np.array([end_id], "<u4").tobytes(), [0] * (window + 1)
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        with encoder(tokenizer) as enc:
            for batch in batches:
                ids_of = batch.column("doc_id").to_pylist()
                for at, texts in _slices(batch, "text"):
                    rows: list[tuple] = []
                    for i, packed in enumerate(enc.encode(texts)):
                        packed += end
                        total = len(packed) // 4
                        for start in range(0, total, window):
                            length = min(window, total - start)
                            rows.append((ids_of[at + i], start, length, zlib.crc32(packed[4 * start : 4 * (start + length)]), total, ranks[length]))
                            ranks[length] += 1
                    columns = list(zip(*rows, strict=True)) or [()] * 6
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), pa.array(np.full(len(rows), part, np.int32))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank", "part"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), cut, "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, rank long, part int")


def pack(docs: DataFrame, tokenizer: str, end_id: int, window: int = 1024) -> DataFrame:
    """Pieces of ``docs`` (``doc_id``, ``text``) with ``sequence_id``, ``offset`` and ``padded_to``.

    The pieces are written once, so that ranks do not change.  The driver gets the counts
    of the lengths only: ``window`` rows at most.
    """
    pieces = materialise(cut_pieces(docs, tokenizer, end_id, window), "pieces")
    by_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    bases = by_part.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    histogram.pop(window, None)
    fills = plan_fills(histogram, window)
    places, packed = _places(fills)
    sums = [sum(k * c for k, c in fill.items()) for _, fill in fills]
    firsts = list(accumulate((times for times, _ in fills), initial=0))[:-1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_pylist(), batch.column("rank").to_pylist()
            sequence, offset, padded = [], [], []
            for n, r in zip(length, rank, strict=True):
                if n == window:
                    sequence.append(packed + r)
                    offset.append(0)
                    padded.append(window)
                    continue
                ranks, copies, first, offsets = places[n]
                k = bisect_right(ranks, r) - 1
                nth, copy = divmod(r - ranks[k], copies[k])
                s = first[k] + nth
                sequence.append(s)
                offset.append(offsets[k] + copy * n)
                size = sums[bisect_right(firsts, s) - 1]
                padded.append(size if size & (size - 1) == 0 else window)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "start")), batch.column("length").cast(pa.int64()), *(batch.column(c) for c in ("ids_crc32", "doc_tokens")), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64()), pa.array(padded, pa.int64())],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_to"],
            )

    ranked = pieces.join(bases, ["length", "part"]).withColumn("rank", F.col("base") + F.col("rank"))
    return map_arrow(ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank"), place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_to long")


def op6_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None, end_id: int = 0, window: int = 1024) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("byte_bpe_50k.json"), end_id, window)
