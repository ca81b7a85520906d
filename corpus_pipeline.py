"""A training corpus from the table ``documents``, in five stages.

Each stage takes (spark, docs, sf_dir) and returns rows with the columns of ``documents``,
the last one the pieces of packed sequences.  A stage sees only what its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from snapquarry.llm import langid, mixing, ngram_join, packing, pii
from snapquarry.llm.shared import materialise, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: In production the key comes from a secret store.
PII_KEY = "snapquarry"


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``lang`` becomes the predicted language; texts that are null or hold no letter go."""
    named = langid.predict(docs.select(*COLUMNS), langid.train(docs), keep=COLUMNS)
    return named.where(F.col("lang_pred") != langid.UNDETERMINED).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest ``doc_id`` (nulls last).

    A verdict is joined by id and text; of rows that are equal in both, one stays if theirs is the one kept.
    """
    judged = ngram_join.join(docs.select("doc_id", "text"))
    by_row = judged.groupBy("doc_id", "text_hash").agg(F.sum(F.col("kept").cast("long")).alias("stay"), F.count("*").alias("n"))
    # rows that go, wholly or in part; the others' texts need not move
    marked = materialise(by_row.where("stay < n").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "stay"), "pipeline-marked")
    hashed = docs.select(*COLUMNS, ngram_join.text_hash(F.col("text")).alias("_hash"))
    may_go = ngram_join.possible_values(marked, "hash")(F.col("_hash"))
    judged_rows = hashed.where(may_go).join(marked, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("_hash") == F.col("hash")), "left")
    nth = F.row_number().over(Window.partitionBy("doc_id", "_hash").orderBy("source", "lang", "n_chars"))
    stay = judged_rows.withColumn("_nth", nth).where("stay IS NULL OR _nth <= stay")
    return hashed.where(~may_go).select(*COLUMNS).unionByName(stay.select(*COLUMNS))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in ``text`` gives way to surrogates; ``n_chars`` follows."""
    return pii.pseudonymise(docs.select(*COLUMNS), PII_KEY).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.take(docs.select(*COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1,024 tokens."""
    import public_tokenizers

    return packing.pack(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


STAGES = [
    ("language ID", identify_languages),
    ("n-gram Jaccard join", drop_near_copies),
    ("surrogates", replace_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Language ID, the exact join's pruning and tokenisation have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"pipeline-{k}")
    return docs
