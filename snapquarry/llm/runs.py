"""Rows with equal keys that stand together in sorted partitions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa


def _starts(batch: pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """Where the runs of a batch start."""
    columns = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in keys])
    return np.concatenate([[0], np.flatnonzero((columns[:, 1:] != columns[:, :-1]).any(axis=0)) + 1])


def whole_runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches that hold whole runs only, with the bounds of the runs."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = _starts(batch, keys)
        if held and [batch.column(k)[0].as_py() for k in keys] != last:
            yield _bounded(held, keys)
            held = []
        last = [batch.column(k)[batch.num_rows - 1].as_py() for k in keys]
        cut = int(starts[-1])
        if cut:
            yield _bounded([*held, batch.slice(0, cut)], keys)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield _bounded(held, keys)


def _bounded(parts: list[pa.RecordBatch], keys: Sequence[str]) -> tuple[pa.RecordBatch, np.ndarray]:
    batch = parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
    return batch, np.concatenate([_starts(batch, keys), [batch.num_rows]])


def single_runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.RecordBatch]:
    for batch, bounds in whole_runs(batches, keys):
        for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
            yield batch.slice(a, b - a)


def smallest_linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the smallest node that the links reach."""
    labels = np.arange(n)
    while True:
        low = np.minimum(labels[a], labels[b])
        new = labels.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == labels).all():
            return labels
        labels = new


def fixed_width(column: pa.Array, dtype: type, width: int) -> np.ndarray:
    """A binary column whose values all have ``width`` items, as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), width)
