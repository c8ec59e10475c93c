"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact length. A source's target is met by
whole passes over the source and, for the budget that remains, a subset of its
documents: a seeded share of each length first, up to a window of a few of the
source's longest documents, then a bounded-knapsack dynamic programme over the
lengths that are left, tried in a seeded order, fits what is still missing.
Only counts by length enter the programme; which documents of a length are
taken is a matter of their seeded rank.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspar.llm.tables import before_range, hash_range
from quillspar.llm.textkernel import mix
from quillspar.operators.order import numbered
from quillspar.session import Workspace, ship

#: So many of a source's longest documents make the window that the dynamic programme fits, in every source.
WINDOW_DOCUMENTS = 8
#: Sums that the programme keeps. Smaller budgets are tabled, for larger ones the sums are listed: both exact up to here.
SUMS = 1 << 17
#: Lengths and copies that are tried once sums are too many to keep all.
STEPS = 256
#: No document is taken more often.
MAX_REPEATS = 3
WORD = r"[^\x20\x09-\x0D]+"


def _drawn(lengths: np.ndarray, seed: int) -> np.ndarray:
    """A number in [0, 1) for each length."""
    with np.errstate(over="ignore"):
        return mix(lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) / 2.0**64


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int = 29) -> np.ndarray:
    """How many of each length to take for the largest sum <= budget (bounded subset sum).

    A table over sums keeps, for each length in turn, how few of it reach a
    sum; O(lengths * budget) additions, done by numpy over blocks of one length.
    """
    take = np.zeros(len(lengths), np.int64)
    use = np.flatnonzero((lengths > 0) & (lengths <= budget) & (counts > 0))
    use = use[np.argsort(_drawn(lengths[use], seed), kind="stable")]
    if budget <= 0 or not len(use):
        return take
    reach = np.zeros(budget + 1, bool)
    reach[0] = True
    how = np.full(budget + 1, -1, np.int32)  # the length that first reached this sum
    used = np.zeros(budget + 1, np.int32)  # and how many of it
    for i in use.tolist():
        size, most = int(lengths[i]), int(min(counts[i], budget // lengths[i]))
        base, done = reach.copy(), 1
        while done <= most:  # sums with `done` copies on top of what others reached
            new = np.zeros_like(reach)
            new[done * size :] = base[: budget + 1 - done * size]
            new &= ~reach
            if not new.any():
                break
            reach |= new
            how[new], used[new] = i, done
            done += 1
        if reach[budget]:
            break
    at = int(np.flatnonzero(reach)[-1])
    while at:
        i = int(how[at])
        take[i] += used[at]
        at -= int(used[at]) * int(lengths[i])
    return take


def fit_sums(lengths: np.ndarray, counts: np.ndarray, budget: int, most: int = SUMS, seed: int = 29) -> np.ndarray:
    """As fit_budget, for budgets of any size: sums are listed, not tabled.

    Up to `most` sums the answer is exact. Beyond, one sum is kept in each of
    `most` stretches of the budget, and the largest, for STEPS further steps.
    """
    take = np.zeros(len(lengths), np.int64)
    use = np.flatnonzero((lengths > 0) & (lengths <= budget) & (counts > 0))
    sums, before, how, used = np.zeros(1, np.int64), np.full(1, -1), np.full(1, -1), np.zeros(1, np.int64)
    goal = budget - budget % int(np.gcd.reduce(lengths[use])) if len(use) else 0  # no sum lies between
    width, full, top, steps = budget // most + 1, None, 0, 0  # full: the stretches that hold a sum, once sums are too many
    for i in use[np.argsort(_drawn(lengths[use], seed), kind="stable")].tolist():
        size, base = int(lengths[i]), len(sums)
        for copies in range(1, int(min(counts[i], budget // size)) + 1):
            values, origin = np.unique(sums[:base] + copies * size, return_index=True)
            values, origin = values[values <= budget], origin[: int((values <= budget).sum())]
            if full is None:
                fresh = np.flatnonzero(~np.isin(values, sums))
            else:
                _, first = np.unique(values // width, return_index=True)
                fresh = first[~full[values[first] // width]]
                if len(values) and values[-1] > top and values[-1] not in values[fresh]:
                    fresh = np.append(fresh, len(values) - 1)
            steps += full is not None
            if not len(fresh):
                break
            values, origin = values[fresh], origin[fresh]
            sums, before = np.append(sums, values), np.append(before, origin)
            how, used = np.append(how, np.full(len(values), i)), np.append(used, np.full(len(values), copies))
            top = max(top, int(values.max()))
            if full is None and len(sums) > most:
                full = np.zeros(most + 1, bool)
                full[sums // width] = True
            elif full is not None:
                full[values // width] = True
            if top == goal:
                break
        if top == goal or steps > STEPS:
            break
    at = int(np.argmax(sums))
    while before[at] >= 0:
        take[how[at]] += used[at]
        at = int(before[at])
    return take


def _fitted(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int) -> np.ndarray:
    return fit_budget(lengths, counts, budget, seed) if budget <= SUMS else fit_sums(lengths, counts, budget, seed=seed)


def _coarse(lengths: np.ndarray, counts: np.ndarray, budget: float, seed: int) -> np.ndarray:
    """How many of each length make the same share of all and sum up to the budget, or less by no more than one document.

    A share that isn't whole is rounded up for lengths in a seeded order, those with the larger fractions sooner.
    """
    take = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or not total:
        return take
    ideal = np.where(lengths > 0, counts * min(1.0, budget / total), 0.0)
    take = np.floor(ideal).astype(np.int64)
    order = np.argsort(_drawn(lengths, seed) - (ideal - take), kind="stable")
    order = order[(lengths[order] > 0) & (take[order] < counts[order])]
    fits = np.cumsum(lengths[order]) <= budget - int((lengths * take).sum())
    take[order[fits]] += 1
    return take


def plan_source(lengths: np.ndarray, counts: np.ndarray, target: int, seed: int = 29) -> tuple[int, np.ndarray]:
    """(whole passes, further takes by length) for one source.

    A source whose documents, each taken once more at most, don't sum up to
    its target may take a smaller share of all first and then some documents
    more than once, each up to MAX_REPEATS times.
    """
    total = int((lengths * counts).sum())
    if total <= 0:
        return 0, np.zeros(len(lengths), np.int64)
    passes = min(MAX_REPEATS, target // total)
    rest = target - passes * total if passes < MAX_REPEATS else 0
    window = WINDOW_DOCUMENTS * int(lengths.max())
    extra = _coarse(lengths, counts, rest - window, seed)
    extra = extra + _fitted(lengths, counts - extra, rest - int((lengths * extra).sum()), seed)
    missing = rest - int((lengths * extra).sum())
    if target - target % int(np.gcd.reduce(lengths)) > target - missing and passes < MAX_REPEATS:
        other = _coarse(lengths, counts * MAX_REPEATS, target - window, seed)
        other = other + _fitted(lengths, counts * MAX_REPEATS - other, target - int((lengths * other).sum()), seed)
        if target - int((lengths * other).sum()) < missing:
            return 0, other
    return passes, extra


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) -> (source, source_size, target): weights 1, 2, 3, repeating, by code point, null last.

    All sizes are shared out by weight; a target stops at 3 times its source's
    size and the excess is shared again among the others until none is above:
    target = min(cap, weight * level), where each round's level is what the
    capped sources leave, over the others' weight. Sources may be very many
    (hosts, say): they are numbered by ranges, and a round is one sum over them.
    """
    space = Workspace(sizes.sparkSession)
    weighted = numbered(sizes, [F.col("source").asc_nulls_last()], "rank").select("source", "source_size", ((F.col("rank") - 1) % 3 + 1).alias("weight"))
    weighted = space.write(weighted.withColumn("cap", F.lit(MAX_REPEATS) * F.col("source_size")), "weighted")
    total = weighted.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        above = F.col("cap") < F.lit(level) * F.col("weight")
        known = weighted.agg(F.count(F.when(above, 1)), F.sum(F.when(above, F.col("cap")).otherwise(0)), F.sum(F.when(above, 0).otherwise(F.col("weight")))).first()
        if known[0] == capped or not known[2]:
            return weighted.select("source", "source_size", F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight")).alias("target"))
        capped, level = known[0], (total - known[1]) / known[2]


def mixed_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 29) -> DataFrame:
    """Per row: id, size (words), source_size, target (of its source) and taken (words, repeats counted).

    taken is a multiple of size, up to three times it; a source's sum of taken
    misses its target by less than what its lengths allow. Reruns give the
    same rows, for all choices follow from ids and the seed. A null or wordless
    text has size 0 and is never taken; null sources are one source; rows that
    repeat an id are documents of their own. Other columns are not read.
    """
    return _taken(docs, id_col, text_col, source_col, seed).drop("source").withColumnRenamed("id", id_col)


def _taken(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    spark = docs.sparkSession
    ship(spark)
    space = Workspace(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), _size(text_col).alias("size")).withColumn("key", F.xxhash64(F.lit(seed), "id"))
    rows = space.write(rows, "sizes")
    rows = rows.withColumn("bucket", hash_range("key", rows.count()))
    buckets = space.write(rows.groupBy("source", "size", "bucket").agg(F.count("*").alias("n")), "buckets")
    lengths = buckets.groupBy("source", "size").agg(F.sum("n").alias("n"))
    targets = space.write(source_targets(lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))), "targets")

    def plan(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size")
        passes, extra = plan_source(group["size"].to_numpy(np.int64), group["n"].to_numpy(np.int64), round(float(group["target"].iloc[0])), seed)
        return pd.DataFrame({column: group[column] for column in ("source", "size", "n", "source_size", "target")} | {"passes": passes, "extra": extra})

    # One row for each length of a source: as many as lengths, however many documents. Neither these tables nor those of
    # buckets are broadcast, for lengths and sources grow with the input.
    counted = lengths.alias("l").join(targets.hint("merge").alias("t"), F.col("l.source").eqNullSafe(F.col("t.source"))).select("l.source", "size", "n", "source_size", "target")
    source_type = docs.schema[source_col].dataType.simpleString()
    plans = space.write(counted.groupBy("source").applyInPandas(plan, f"source {source_type}, size long, n long, source_size long, target double, passes long, extra long"), "plans")

    before = before_range(buckets, ["source", "size"], "bucket", "n", "before").drop("n").alias("b")
    offsets = before.join(plans.hint("merge").alias("p"), F.col("b.source").eqNullSafe(F.col("p.source")) & (F.col("b.size") == F.col("p.size")))
    offsets = offsets.select("b.source", "b.size", "bucket", "before", "n", "source_size", "target", "passes", "extra").alias("o")
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("key", "id"))).alias("r")
    placed = placed.join(offsets.hint("merge"), F.col("r.source").eqNullSafe(F.col("o.source")) & (F.col("r.size") == F.col("o.size")) & (F.col("r.bucket") == F.col("o.bucket")))
    copies = F.col("passes") + F.expr("extra div n") + (F.col("before") + F.col("place") <= F.expr("extra % n")).cast("long")
    return placed.select("id", "r.source", "r.size", "source_size", "target", (copies * F.col("r.size")).alias("taken"))


def _size(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 29) -> DataFrame:
    """docs with each row as often as the mix takes it (0 to 3 times); columns, whatever their names, and their order stay.

    Rows that share an id (or have none), a source and a size share what the
    mix takes of them: it is dealt out to them in turn, in the order of their
    texts' hashes, so that their sum is the mix's.
    """
    space = Workspace(docs.sparkSession)
    # A struct is never null itself and its nulls compare as equal.
    taken = _taken(docs, id_col, text_col, source_col, seed).where("size > 0").groupBy(F.struct("id", "source", "size").alias("name"))
    copies = space.write(taken.agg(F.sum(F.expr("taken div size")).alias("copies"), F.count("*").alias("sharers")).where("copies > 0"), "copies")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.struct(F.col(id_col).alias("id"), F.col(source_col).alias("source"), _size(text_col).alias("size")).alias("name"))
    rows = rows.join(copies.hint("merge"), "name")
    if copies.where("sharers > 1").isEmpty():
        every = rows.select("row", "copies")
    else:
        turn = F.row_number().over(Window.partitionBy("name").orderBy(F.xxhash64(F.col("row")[text_col])))
        every = rows.withColumn("turn", turn).select("row", (F.expr("copies div sharers") + (F.col("turn") <= F.expr("copies % sharers")).cast("long")).alias("copies")).where("copies > 0")
    return every.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
