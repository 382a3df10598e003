"""What several of these operators share: words, row keys, column clashes, the shared folder as a path."""

from __future__ import annotations

import re
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quizspark.plans.storage import new_path

#: A word is a run without ASCII white space. ``bytes.split`` cuts at the same six characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without columns an operator is about to add, whatever their case."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def python_words(text: str | None) -> list[bytes]:
    """A-Z lower-cased words of a text as UTF-8; bytes methods know ASCII only, which is the definition."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shared_path(spark: SparkSession, label: str) -> str:
    """A new folder in the shared folder as a path that Python's ``open`` takes.

    Memory-mapped files need a mounted folder; an object store has to be mounted first.
    """
    uri = new_path(spark, label)
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", uri):
        return uri
    parts = urlparse(uri)
    if parts.scheme != "file":
        raise ValueError(f"{label} needs spark.checkpoint.dir on a mounted path, not {parts.scheme}:")
    return unquote(parts.path)


