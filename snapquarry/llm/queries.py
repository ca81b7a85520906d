"""Queries of the training-data operators and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import itq, langid, licenses, mixing, ngram_join, packing, pii, prefix_forest, token_files, warc


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_langid": langid.op1_langid,
    "op2_warc_fixity": warc.op2_warc_fixity,
    "op3_surrogates": pii.op3_surrogates,
    "op4_prefix_forest": prefix_forest.op4_prefix_forest,
    "op5_token_files": token_files.op5_token_files,
    "op6_packing": packing.op6_packing,
    "op7_ngram_join": ngram_join.op7_ngram_join,
    "op8_mixing": mixing.op8_mixing,
    "op9_itq": itq.op9_itq,
    "op10_licenses": licenses.op10_licenses,
    "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {
    "op2_warc_fixity": warc.ORACLE,
    "op7_ngram_join": ngram_join.ORACLE,
    "op8_mixing": mixing.ORACLE,
    "op9_itq": itq.ORACLE,
    "op10_licenses": licenses.ORACLE,
}
