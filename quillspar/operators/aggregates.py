"""Aggregations: closed histograms, facets, roll-ups of nodes and edges, modes and accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def closed_histogram(df: DataFrame, value: str, domain: list[str], keys: list[str] | None = None) -> DataFrame:
    """(keys, value, n) for every value of a closed domain, 0 where none occurs."""
    keys = keys or []
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    groups = df.select(*keys).distinct() if keys else df.sparkSession.range(1)
    full = groups.select(*keys, F.explode(F.array(*map(F.lit, domain))).alias(value))
    return full.join(counts, [*keys, value], "left").select(*keys, value, F.coalesce("_n", F.lit(0)).alias("n"))


def facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, value): the distinct non-empty values of each column, one row each."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(pairs.alias("p")).select("p.*").where("value IS NOT NULL AND value <> ''").distinct()


def conditional_totals(df: DataFrame, conditions: dict[str, Column], distinct: dict[str, str] | None = None) -> DataFrame:
    """One row: how many rows meet each condition, and how many distinct values some columns have."""
    return df.agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in conditions.items()], *[F.count_distinct(c).alias(n) for n, c in (distinct or {}).items()])


def first_seen_mode(df: DataFrame, keys: list[str], value: str, seen: str) -> DataFrame:
    """The most frequent value of each group; among equals the one seen first."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(seen).alias("first_seen"))
    return counts.groupBy(*keys).agg(F.max_by(F.struct(value, "n"), F.struct("n", (-F.col("first_seen")).alias("first"))).alias("_m")).select(*keys, F.col(f"_m.{value}").alias(value), "_m.n")


def merged_edges(df: DataFrame, keys: list[str], confirmed: str, basis: str, order: str, evidence: list[str], keep: int = 5) -> DataFrame:
    """One edge for each key: confirmed if any is; the basis of the first of the winning class; the smallest distinct evidence; all counted.

    The evidence set is cut while it is collected: distinct evidence is ranked
    by a window after the partial sums, so no edge gathers all of it.
    """
    from quillspar.operators.order import top_per_group

    summed = df.groupBy(*keys).agg(
        F.bool_or(confirmed).alias("confirmed"), F.max_by(basis, F.struct(F.col(confirmed).cast("int"), -F.col(order))).alias("basis"), F.count("*").alias("evidence_count")
    )
    top = top_per_group(df.select(*keys, *evidence).distinct(), keys, list(evidence), keep)
    listed = top.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*evidence))).alias("evidence"))  # at most `keep` each
    return summed.join(listed, keys)


def node_rollup(df: DataFrame, node: str, flag: Column, band: str, bands: list[str], member: str) -> DataFrame:
    """Per node: rows, whether any has the flag, its worst band (first in bands) and distinct members."""
    rank = F.array_position(F.array(*map(F.lit, bands)), F.col(band))
    worst = F.element_at(F.array(*map(F.lit, bands)), F.min(rank).cast("int"))
    return df.groupBy(node).agg(F.count("*").alias("n"), F.bool_or(flag).alias("flagged"), worst.alias("worst_band"), F.count_distinct(member).alias("members"))


def accuracy(df: DataFrame, expected: Column, found: Column, kind: str) -> DataFrame:
    """(kind, tp, fp, fn, precision, recall, f1) over all rows (kind null) and each kind; a measure of nothing is 1."""
    one = lambda top, low: F.when(low == 0, F.lit(1.0)).otherwise(top / low)
    sums = df.rollup(kind).agg(F.count_if(expected & found).alias("tp"), F.count_if(~expected & found).alias("fp"), F.count_if(expected & ~found).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.withColumn("precision", one(tp, tp + fp)).withColumn("recall", one(tp, tp + fn)).withColumn("f1", one(2 * tp, 2 * tp + fp + fn))


def first_seen_union(df: DataFrame, keys: list[str], items: str, order: list[str], name: str | None = None) -> DataFrame:
    """(keys, items): the distinct items of each group's arrays, in the order in which they were first seen; `order` puts the rows in order.

    An item's first place is a minimum, so that partial sums merge in any
    order, and a frequent item is one row before groups meet. Groups are as
    large as their sets. Null arrays and items say nothing; a group without any
    has an empty set.
    """
    places = df.select(*keys, F.struct(*order).alias("_row"), F.posexplode_outer(items).alias("_at", "_item"))
    first = places.groupBy(*keys, "_item").agg(F.min(F.struct("_row", "_at")).alias("_first"))
    kept = F.collect_list(F.when(F.col("_item").isNotNull(), F.struct("_first", "_item")))
    return first.groupBy(*keys).agg(F.transform(F.array_sort(kept), lambda x: x["_item"]).alias(name or items))
