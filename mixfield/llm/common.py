"""Shared pieces of the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mixfield.operators.storage import written

__all__ = ["WORD", "fresh", "smallest", "table", "word_count", "written"]

#: A word, as a regular expression that Spark's JVM side understands.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    # Each word leaves one character and each separator none, so no array of words is built.
    return F.coalesce(F.length(F.regexp_replace(F.regexp_replace(text, WORD, "x"), r"[\x20\x09-\x0D]+", "")), F.lit(0)).cast("long")


def smallest(rows: DataFrame, n: int, *key: str) -> DataFrame:
    """``n`` of ``rows`` with the smallest hash of ``key``, ties by the key; all if there are no more.

    Rows above a threshold that leaves a little more than ``n`` in expectation go first, so that the partitions together send some ``n`` rows to be
    ordered, not ``n`` each. Where the threshold leaves fewer by chance (one draw in a billion), or one key has many rows, so many are returned.
    """
    place = F.xxhash64(*key)
    count = rows.count()
    share = (n + 6 * n**0.5 + 10) / max(count, 1)
    if share < 1:
        rows = rows.where(F.pmod(place, F.lit(1 << 40)) < int(share * (1 << 40)))
    return rows.orderBy(F.pmod(place, F.lit(1 << 40)), *key).limit(n)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as it takes to differ from all columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out
