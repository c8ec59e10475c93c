"""Helpers on the document tables that the operators of this subpackage share."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the `documents` table.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Rows of a table that are ranked together, at most about so many, and bits of the ranges' numbers that are summed together.
RANGE_ROWS = 500
STRETCH_BITS = 10
WHITE_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


#: Rows of one key are dealt over so many parts where they meet another table's row of that key.
PARTS = 16


def dealt(df: DataFrame, *columns: str) -> DataFrame:
    """df with `_part`, drawn from the columns: the side of a join on which one key may have very many rows."""
    return df.withColumn("_part", F.pmod(F.xxhash64(*columns), F.lit(PARTS)).cast("int"))


def for_each_part(df: DataFrame) -> DataFrame:
    """df once for each `_part`: the side of a join with one or few narrow rows a key."""
    return df.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))


def hash_range(key: str, rows: int) -> Column:
    """The number of the range that a 64-bit hash lies in; ranges follow each other as the hashes do, each with some RANGE_ROWS of so many rows."""
    bits = max(0, math.ceil(math.log2(max(rows / RANGE_ROWS, 1))))
    return F.shiftright(key, 64 - bits) if bits else F.lit(0).cast("long")


def meet(many: DataFrame, one: DataFrame, keys: list[str], by: list[str], how: str = "inner") -> DataFrame:
    """The join of many, which may have very many rows of one key, with one, which has one narrow row a key.

    The rows of a key are dealt over parts by the columns `by`, and each part
    that a key has is given its row.
    """
    many = dealt(many, *by)
    given = many.select(*keys, "_part").distinct().join(one, keys)
    return many.join(given, [*keys, "_part"], how).drop("_part")


def exclusive_sum(counts: DataFrame, keys: Iterable[str], order: Iterable[str], value: str, to: str) -> DataFrame:
    """Adds the sum of `value` over the rows before, within keys; for tables of aggregates only."""
    from pyspark.sql import Window

    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(to, F.coalesce(F.sum(value).over(before), F.lit(0)))


def before_range(counts: DataFrame, keys: list[str], number: str, value: str, to: str) -> DataFrame:
    """Adds the sum of `value` over the ranges with a lower number, within keys (nulls are a key): sums inside stretches of
    2**STRETCH_BITS numbers, and over whole stretches before, so that the ranges of one key don't meet in one task."""
    staged = counts.withColumn("_stretch", F.shiftright(number, STRETCH_BITS))
    inner = exclusive_sum(staged, [*keys, "_stretch"], [number], value, "_inner").alias("i")
    whole = exclusive_sum(staged.groupBy(*keys, "_stretch").agg(F.sum(value).alias("_n")), keys, ["_stretch"], "_n", "_outer").drop("_n").alias("o")
    same = F.col("i._stretch") == F.col("o._stretch")
    for key in keys:
        same = same & F.col(f"i.{key}").eqNullSafe(F.col(f"o.{key}"))
    return inner.join(whole.hint("merge"), same).select(*[f"i.{c}" for c in counts.columns], (F.col("_inner") + F.col("_outer")).alias(to))
