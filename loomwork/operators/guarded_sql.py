"""Read-only SQL for ad-hoc questions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROW_LIMIT = 100_000


# Quoted text first, so that what looks like a comment in it stays.
PIECES = re.compile(r"""('(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|`(?:[^`]|``)*`)|/\*.*?\*/|--[^\n]*""", re.S)


def checked(text: str) -> str:
    """The statement without comments and the last semicolon; ValueError if it does not begin with SELECT."""
    bare = PIECES.sub(lambda m: m[1] or " ", text).strip().rstrip(";").strip()
    if not re.match(r"select\b", bare, re.I):
        raise ValueError("only SELECT statements are allowed")
    return bare


def shown(rows: DataFrame) -> DataFrame:
    """Binary values by their size, all else as it is."""
    name = lambda c: F.col("`" + c.replace("`", "``") + "`")
    size = lambda c: F.concat(F.lit("<BLOB "), F.octet_length(name(c)).cast("string"), F.lit(" B>")).alias(c)
    return rows.select(*[size(c) if kind == "binary" else name(c) for c, kind in rows.dtypes])


def select(spark: SparkSession, text: str, limit: int = ROW_LIMIT) -> DataFrame:
    """The rows of a single SELECT, at most ``limit``; binary values are shown by their size."""
    return shown(spark.sql(checked(text))).limit(limit)


def answer(spark: SparkSession, text: str, limit: int = ROW_LIMIT) -> tuple[DataFrame, int, str | None]:
    """(rows, how many the statement has, a warning if they are more than ``limit``)."""
    rows = spark.sql(checked(text))
    n = rows.count()
    warning = f"Result truncated to {limit:,} of {n:,} rows." if n > limit else None
    return shown(rows).limit(limit), n, warning
