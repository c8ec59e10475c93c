"""Joins whose match is a pattern, a prefix, a suffix, a preference or a position.

The rule side of each is a table of rules: small and known before the query
runs. It is broadcast below BROADCAST_RULES rows and joined as Spark sees fit
beyond that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

#: Rules up to this count are sent to every executor.
BROADCAST_RULES = 20_000


def small(rules: DataFrame) -> DataFrame:
    """rules with a broadcast hint if they are few; the count is of a rule table and stops at the bound."""
    return F.broadcast(rules) if rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES else rules


def rule_rows(rules: DataFrame) -> list[Row]:
    """The rows of a rule table: configuration, of a bounded number."""
    found = rules.limit(BROADCAST_RULES + 1).collect()
    if len(found) > BROADCAST_RULES:
        raise ValueError(f"more than {BROADCAST_RULES} rules")
    return found


def glob_key(value: str | Column) -> Column:
    """What patterns are compared with: lower case without white space."""
    return F.regexp_replace(F.lower(F.col(value) if isinstance(value, str) else value), r"\s+", "")


def glob_matches(value: Column, pattern: Column) -> Column:
    """`text`, `text*`, `*text`, `*text*` and `*`; an empty pattern matches the empty value only."""
    body = F.regexp_replace(pattern, r"^\*|\*$", "")
    head, tail = pattern.startswith("*"), pattern.endswith("*")
    return (
        F.when(pattern == "*", F.lit(True))
        .when(head & tail, value.contains(body))
        .when(tail, value.startswith(body))
        .when(head, value.endswith(body))
        .otherwise(value == pattern)
    )


def first_glob(df: DataFrame, value: str, keys: list[str], rules: DataFrame, pattern: str = "pattern", order: str = "ord", take: list[str] | None = None) -> DataFrame:
    """df's keys and value with the columns of the first rule in order whose pattern matches; no row where none does."""
    take = take or [c for c in rules.columns if c not in (pattern, order)]
    patterns = rules.select(glob_key(pattern).alias("_pattern"), F.col(order).alias("_ord"), *[F.col(c).alias(f"_r_{c}") for c in take])
    # Distinct values are matched, not rows: a value that many rows share is tried once.
    values = df.select(value).distinct().withColumn("_key", glob_key(value))
    # Whole texts, beginnings and ends are found by equality, however many rules there are; only `*text*` is tried by each.
    head, tail = F.col("_pattern").startswith("*"), F.col("_pattern").endswith("*")
    kind = F.when(head & tail, "inside").when(tail, "begins").when(head, "ends").otherwise("whole")
    patterns = patterns.withColumn("_kind", kind).withColumn("_text", F.regexp_replace("_pattern", r"^\*|\*$", ""))
    lengths: dict[str, list[int]] = {"begins": [], "ends": []}
    for row in patterns.where("_kind IN ('begins', 'ends')").select("_kind", F.length("_text").alias("n")).distinct().limit(BROADCAST_RULES).collect():
        lengths[row["_kind"]].append(row["n"])
    probe = lambda kind, text: F.struct(F.lit(kind).alias("_kind"), text.alias("_text"))
    key = F.col("_key")
    probes = [probe("whole", key), *[probe("begins", F.left(key, F.lit(n))) for n in sorted(lengths["begins"])], *[probe("ends", F.right(key, F.lit(n))) for n in sorted(lengths["ends"])]]
    tried = values.select(value, F.explode(F.array_distinct(F.array(*probes))).alias("_p")).select(value, "_p.*")
    result = [value, "_ord", *[f"_r_{c}" for c in take]]
    hits = tried.join(small(patterns), ["_kind", "_text"]).select(*result)
    hits = hits.unionByName(values.join(small(patterns.where("_kind = 'inside'")), F.contains("_key", "_text")).select(*result))
    best = hits.groupBy(value).agg(F.min_by(F.struct(*[F.col(f"_r_{c}").alias(c) for c in take]), "_ord").alias("_best"))
    return df.select(*dict.fromkeys([*keys, value])).join(best, value).select(*dict.fromkeys([*keys, value]), *[F.col(f"_best.{c}").alias(c) for c in take])


def longest_prefix(df: DataFrame, path: str, prefixes: DataFrame, prefix: str, take: list[str], order: str = "ord", separator: str = "/") -> DataFrame:
    """df with the columns of the longest prefix that is the path, or its folder, or empty; nulls where none is.

    Equal prefixes: the one first in order. Each path gives its own folder
    prefixes, so that the join is an equality and grows with paths, not with
    paths times prefixes.
    """
    once = prefixes.groupBy(F.col(prefix).alias("_prefix")).agg(F.min_by(F.struct(*take), order).alias("_hit"))
    parts = F.split(path, separator)
    steps = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), separator))
    paths = df.select(path).distinct().withColumn("_prefix", F.explode(F.array_distinct(F.array_union(F.array(F.lit("")), steps))))
    best = paths.join(small(once), "_prefix").groupBy(path).agg(F.max_by("_hit", F.length("_prefix")).alias("_best"))
    return df.join(best, path, "left").select(*df.columns, *[F.col(f"_best.{c}").alias(c) for c in take])


def first_candidate(df: DataFrame, candidates: str, targets: DataFrame, target: str) -> DataFrame:
    """df with `found` and `place`: the first of its array of candidates that is a target; nulls where none is."""
    names = df.columns
    rows = df.withColumn("_row", F.monotonically_increasing_id()) if "_row" not in names else df
    tried = rows.select("_row", F.posexplode(candidates).alias("_place", "_try"))
    hits = tried.join(targets.select(F.col(target).alias("_try")).distinct(), "_try")
    best = hits.groupBy("_row").agg(F.min(F.struct("_place", "_try")).alias("_best"))
    return rows.join(best, "_row", "left").select(*names, F.col("_best._try").alias("found"), F.col("_best._place").alias("place"))


def by_suffix(df: DataFrame, wanted: str, keys: list[str], targets: DataFrame, path: str, separator: str = "/") -> DataFrame:
    """keys, wanted, n_targets, target and resolution of targets whose path ends with the wanted one on a whole segment.

    resolution is `resolved` for one target, `ambiguous` for more (target is
    then the first by code point) and `unresolved` for none.
    """
    parts = F.split(path, separator)
    suffixes = targets.select(F.col(path).alias("_target"), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), separator))).alias("_suffix")).distinct()
    asked = df.select(wanted).distinct()
    found = asked.join(suffixes, asked[wanted] == suffixes["_suffix"]).groupBy(wanted).agg(F.count("*").alias("n_targets"), F.min("_target").alias("target"))
    out = df.select(*dict.fromkeys([*keys, wanted])).join(found, wanted, "left").withColumn("n_targets", F.coalesce("n_targets", F.lit(0)))
    kind = F.when(F.col("n_targets") == 0, "unresolved").when(F.col("n_targets") == 1, "resolved").otherwise("ambiguous")
    return out.select(*dict.fromkeys([*keys, wanted]), "n_targets", "target", kind.alias("resolution"))


def last_before(events: DataFrame, keys: list[str], at: list[str], is_mark: Column, mark: Column, name: str) -> DataFrame:
    """events with the latest mark at or before each, within keys (an as-of join backwards as one window)."""
    window = Window.partitionBy(*keys).orderBy(*at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn(name, F.last(F.when(is_mark, mark), ignorenulls=True).over(window))


def snippet(df: DataFrame, text: str, line: str, around: int = 3) -> DataFrame:
    """df with `start_line` and `snippet`: the lines around a line number (from 1), as one text."""
    lines = F.split(text, "\n")
    start = F.greatest(F.lit(1), F.col(line) - around)
    return df.withColumn("start_line", start).withColumn("snippet", F.array_join(F.slice(lines, start, F.col(line) + around - start + 1), "\n"))
