"""SQL over a catalog: views, a read-only gate, aliases for other dialects' names, and text output."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

#: Functions of other dialects as SQL functions of the session.
ALIASES = {
    "json_extract_string": "(j STRING, p STRING) RETURNS STRING RETURN get_json_object(j, p)",
    "regexp_matches": "(s STRING, p STRING) RETURNS BOOLEAN RETURN s RLIKE p",
    "list_contains": "(a ARRAY<STRING>, x STRING) RETURNS BOOLEAN RETURN array_contains(a, x)",
    "starts_with": "(s STRING, p STRING) RETURNS BOOLEAN RETURN startswith(s, p)",
    "epoch_ns": "(t TIMESTAMP) RETURNS BIGINT RETURN unix_micros(t) * 1000",
}
_COMMENT = re.compile(r"--[^\n]*|/\*.*?\*/", re.S)


class NotReadOnly(ValueError):
    pass


def register(spark: SparkSession, tables: Mapping[str, DataFrame]) -> list[str]:
    """Make views; a table that cannot be read is left out.  Returns the names of the views."""
    done = []
    for name, df in tables.items():
        try:
            df.schema  # noqa: B018  resolves the files
        except Exception as error:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER" not in str(error):
                raise
            continue
        df.createOrReplaceTempView(name)
        done.append(name)
    for name, body in ALIASES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return done


def _writes(spark: SparkSession, plan: object) -> bool:
    """Whether a parsed plan is, or holds, a command or an insertion, which may follow a WITH or FROM."""
    command = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.Command")
    if command.isInstance(plan) or plan.getClass().getSimpleName().startswith("Insert"):
        return True
    children = plan.children()
    return any(_writes(spark, children.apply(i)) for i in range(children.size()))


def query(spark: SparkSession, text: str) -> DataFrame:
    """Run one statement that reads.  Double quotes name columns, as in standard SQL."""
    first = re.match(r"[\s(]*(\w+)", _COMMENT.sub(" ", text))
    word = first[1].upper() if first else ""
    setting = "spark.sql.ansi.doubleQuotedIdentifiers"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "true")
    try:
        if word in ("SELECT", "WITH", "FROM", "VALUES", "TABLE"):
            allowed = not _writes(spark, spark._jsparkSession.sessionState().sqlParser().parsePlan(text))
        else:
            allowed = word in ("DESCRIBE", "SHOW", "EXPLAIN")
        if not allowed:
            raise NotReadOnly("only statements that read are accepted")
        return spark.sql(text)
    finally:
        spark.conf.set(setting, before)


def cell(value: object) -> str:
    if value is None:
        return ""
    if isinstance(value, bytes | bytearray):
        return bytes(value).decode("utf-8", "replace")
    if isinstance(value, bool):
        return str(value).lower()
    return str(value)


def render(df: DataFrame) -> str:
    """A header and rows in aligned columns."""
    rows = [df.columns, *([cell(v) for v in r] for r in df.toLocalIterator())]
    widths = [max(len(r[i]) for r in rows) for i in range(len(df.columns))]
    return "".join("  ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)).rstrip() + "\n" for r in rows)
