"""Language identification with string kernels.

The blended-spectrum presence kernel of two texts counts the character n-grams, n from 1 to
``orders``, that both hold, divided by the root of the product of their own counts.  Some
labelled texts are landmarks; the Nystrom map projects the kernel on them, and ridge
regression, one language versus the rest, is fitted in the mapped space.  Scoring adds up the
landmarks' rows of a text's n-grams; a matrix product takes kernel values to languages.

Letters are code points of the whole of Unicode, none of them capped or merged; n-grams of
them are hashed into a space of fixed size.  Those that some landmark holds are the columns of
the kernel; a text's own count is that of all its n-grams.  The labelled sample is bounded by
``per_language`` distinct texts for each language, fewer where there are more than 200
languages, chosen by a hash of the text; the executors reduce them to their n-grams.  All
texts, those of the sample too, are read whole.

Defined results: a null text or one without letters gives ``und`` and score 0; if nothing
can be learned every text gives ``und``; repeated rows give equal rows, and of equal texts with
one label one is learned from; ties go to the language that sorts first; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import map_arrow, table

UNDETERMINED = "und"
#: N-grams are hashed to numbers of so many bits.
_SPACE = 18
#: At most so many labelled texts in all, but one for each language.
_SAMPLE = 80_000


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def _symbols(text: str) -> np.ndarray:
    """Code points of the letters, with one 0 at either end and for each run of other characters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    s = np.concatenate([[0], np.where(_letters()[points], points, 0), [0]]).astype(np.uint64)
    return s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])]


def _grams(symbols: np.ndarray, orders: int) -> Iterator[np.ndarray]:
    """Hashes of the n-grams of each order."""
    for order in range(1, orders + 1):
        n = max(0, len(symbols) - order + 1)
        out = np.full(n, order, np.uint64)
        for k in range(order):
            out = (out ^ symbols[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        yield ((out * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - _SPACE)).astype(np.int64)


def grams(text: str, orders: int) -> np.ndarray:
    """The distinct n-grams of a text."""
    held = np.zeros(1 << _SPACE, bool)
    for found in _grams(_symbols(text), orders):
        held[found] = True
    return np.flatnonzero(held)


@dataclass
class Model:
    """What the executors need; its size depends on the sample's bounds and not on the data."""

    languages: list[str]
    orders: int
    lookup: np.ndarray
    landmarks: np.ndarray
    landmark_norms: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def kernel(self, texts: Sequence[np.ndarray]) -> np.ndarray:
        """Kernel values of texts, given by their n-grams, with the landmarks."""
        known = [self.lookup[t] for t in texts]
        shared = np.stack([self.landmarks[k[k >= 0]].sum(0, dtype=np.float32) for k in known])
        norms = np.sqrt(np.maximum([len(t) for t in texts], 1)).astype(np.float32)
        return shared / norms[:, None] / self.landmark_norms[None, :]

    def scores(self, texts: Sequence[str]) -> np.ndarray:
        return self.kernel([grams(t, self.orders) for t in texts]) @ self.weights + self.bias


def fit(texts: Sequence[np.ndarray], labels: Sequence[str], orders: int = 3, landmarks: int = 192, ridge: float = 1e-2) -> Model:
    """Fit on the n-grams of labelled texts; the landmarks are spread evenly over the languages."""
    languages = sorted(set(labels))
    nothing = np.zeros((0, 0), np.float32)
    if not languages:
        return Model([], orders, np.zeros(0, np.int32), np.zeros((0, 0), np.uint8), nothing.ravel(), nothing, nothing.ravel())
    by = {lang: [i for i, x in enumerate(labels) if x == lang] for lang in languages}
    landmarks = max(landmarks, len(languages))
    chosen = [i for k in range(landmarks) for lang in languages for i in by[lang][k : k + 1]][:landmarks]
    kinds = np.unique(np.concatenate([texts[i] for i in chosen]))
    lookup = np.full(1 << _SPACE, -1, np.int32)
    lookup[kinds] = np.arange(len(kinds))
    held = np.zeros((len(kinds), len(chosen)), np.uint8)
    for k, i in enumerate(chosen):
        held[lookup[texts[i]], k] = 1
    norms = np.sqrt(np.maximum([len(texts[i]) for i in chosen], 1)).astype(np.float32)
    model = Model(languages, orders, lookup, held, norms, nothing, nothing.ravel())
    k_nm = np.concatenate([model.kernel([t]) for t in texts]).astype(np.float64)
    k_mm = k_nm[chosen]
    values, vectors = np.linalg.eigh((k_mm + k_mm.T) / 2)
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    mapped = np.hstack([k_nm @ root, np.ones((len(texts), 1))])
    signs = np.where(np.array(labels)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    solved = np.linalg.solve(mapped.T @ mapped + ridge * np.eye(mapped.shape[1]), mapped.T @ signs)
    model.weights = (root @ solved[:-1]).astype(np.float32)
    model.bias = solved[-1].astype(np.float32)
    return model


def labelled_sample(docs: DataFrame, per_language: int = 400, orders: int = 3) -> tuple[list[np.ndarray], list[str]]:
    """N-grams and labels of at most ``per_language`` distinct texts of each language, of rows that are not held out.

    Distinct texts are counted by language first; then a threshold on their hash lets about
    twice the bound through (all, where a language has few), and the smallest hashes stay.
    """
    lettered = F.col("text").rlike(r"\p{L}")
    usable = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & lettered)
    hashed = usable.select("lang", "text", F.pmod(F.xxhash64("text"), F.lit(1 << 40)).alias("h"))
    counts = {r["lang"]: r["n"] for r in hashed.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not counts:
        return [], []
    per_language = max(1, min(per_language, _SAMPLE // len(counts)))
    # a threshold that lets few through may let none through
    limits = [(lang, int(min(1.0, max(2 * per_language, per_language + 20) / max(n, 1)) * (1 << 40))) for lang, n in counts.items()]
    # one row for each language, on the driver anyhow; without the broadcast all texts would be shuffled by language
    limit = F.broadcast(docs.sparkSession.createDataFrame(limits, "lang string, most long"))
    low = hashed.join(limit, "lang").where(F.col("h") < F.col("most")).dropDuplicates(["lang", "h"])
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = low.withColumn("nth", nth).where(F.col("nth") <= per_language).select("lang", "h", "text")

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [grams(t.as_py(), orders) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("h"), pa.array([g.astype("<i4").tobytes() for g in found], pa.binary())], ["lang", "h", "grams"])

    rows = sorted(map_arrow(chosen, reduce, "lang string, h long, grams binary").collect(), key=lambda r: (r["lang"], r["h"]))
    return [np.frombuffer(r["grams"], "<i4").astype(np.int64) for r in rows], [r["lang"] for r in rows]


def predict(docs: DataFrame, model: Model, keep: Sequence[str] = ("doc_id",), batch: int = 256) -> DataFrame:
    """``keep`` columns with ``lang_pred`` and ``score``, from ``text`` alone."""
    from pyspark.sql.types import DoubleType, StringType, StructType

    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = list(keep)
    schema = StructType([docs.schema[c] for c in keep]).add("lang_pred", StringType()).add("score", DoubleType())

    at_text = keep.index("text") if "text" in keep else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                texts = part.column(at_text).to_pylist()
                lang, score = [UNDETERMINED] * len(texts), [0.0] * len(texts)
                there = [i for i, t in enumerate(texts) if t and m.languages and any(map(str.isalpha, t))]
                if there:
                    values = m.scores([texts[i] for i in there])
                    best = values.argmax(1)
                    for i, k, v in zip(there, best.tolist(), values[np.arange(len(there)), best].tolist(), strict=True):
                        lang[i], score[i] = m.languages[k], float(min(1.0, max(0.0, (v + 1) / 2)))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*keep, "lang_pred", "score"])

    return map_arrow(docs.select(*keep, *([] if "text" in keep else ["text"])), run, schema)


def train(docs: DataFrame, per_language: int = 400, landmarks: int = 192) -> Model:
    return fit(*labelled_sample(docs, per_language), landmarks=landmarks)


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs)
    return predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
