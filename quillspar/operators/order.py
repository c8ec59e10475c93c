"""Numbers, ranks and limits over a total order, without bringing all rows into one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspar.session import Workspace


def numbered(df: DataFrame, order: list[str | Column], name: str = "rank", start: int = 1) -> DataFrame:
    """df with consecutive numbers in the given order.

    Rows are sorted by ranges, each range numbers its own, and the ranges'
    lengths give where each begins. Written once between the two, because
    ranges are drawn anew each time they are computed.
    """
    space = Workspace(df.sparkSession)
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    ranged = space.write(ranged.withColumn("_range", F.shiftright("_id", 33)), "ranged")
    lengths = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = lengths.select("_range", before.alias("_start"))
    inner = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.join(starts, "_range").withColumn(name, (F.col("_start") + inner + start).cast("long")).drop("_id", "_range", "_start")


def labelled(df: DataFrame, order: list[str | Column], template: str = "CRYPTO-%03d", name: str = "id") -> DataFrame:
    """df with sequential ids in the given order."""
    return numbered(df, order, "_number").withColumn(name, F.format_string(template, "_number")).drop("_number")


def truncated(df: DataFrame, order: list[str | Column], keep: int) -> DataFrame:
    """The first rows in the order with `truncated`: whether there were more. The limit is the feature."""
    more = df.limit(keep + 1).count() > keep
    return df.orderBy(*order).limit(keep).withColumn("truncated", F.lit(more))


def top_per_group(df: DataFrame, keys: list[str], order: list[str | Column], k: int, name: str = "place") -> DataFrame:
    """The first k rows of each group in the order, with their place from 1."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col(name) <= k)


def budgeted(df: DataFrame, kind: str, kinds: list[str], order: list[str | Column], budget: int, most: dict[str, int] | None = None, name: str = "place") -> tuple[DataFrame, DataFrame]:
    """The first rows up to a budget, class by class, and what each class leaves out. The limit is the feature.

    Classes (values of column `kind`, in the order of kinds; others take no
    part) fill the budget one after the other, each by its own order and up to
    its number in `most`. Returns the rows with their place in the whole
    selection, from 1, and one row for each class: (kind, total, kept,
    left_out). A class is cut before it is ranked: each partition gives on at
    most as many of its rows as it may keep, so rows are never sorted as a whole.
    """
    spark, most = df.sparkSession, most or {}
    table = spark.createDataFrame([(k, i, min(budget, most.get(k, budget))) for i, k in enumerate(kinds)], f"`{kind}` string, _turn int, _most long")
    totals = table.join(df.groupBy(kind).agg(F.count("*").alias("total")), kind, "left").fillna(0, ["total"])
    # One row for each class: what the classes before may take comes off the budget.
    may = F.least("total", "_most")
    before = F.coalesce(F.sum(may).over(Window.orderBy("_turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = totals.withColumn("_before", F.least(before, F.lit(budget))).withColumn("kept", F.least(may, F.lit(budget) - F.col("_before")))
    shares = taken.select(kind, "total", "kept", (F.col("total") - F.col("kept")).alias("left_out"))
    cut = [df.where(F.col(kind) == k).orderBy(*order).limit(min(budget, most.get(k, budget))) for k in kinds]
    first = top_per_group(reduce(DataFrame.unionByName, cut), [kind], order, budget, "_place")
    rows = first.join(F.broadcast(taken.select(kind, "kept", "_before")), kind).where(F.col("_place") <= F.col("kept"))  # a row a class
    return rows.withColumn(name, (F.col("_before") + F.col("_place")).cast("long")).select(*df.columns, name), shares
