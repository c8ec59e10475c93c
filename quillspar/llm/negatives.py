"""Hard-negative mining by a secondary sort.

Anchors meet all rows in cells of a bounded block of rows and a bounded block
of anchors. A cell gives out, for each of its anchors, the few rows that may
matter: its best rows of the same label, and, once the positives are known, the
best rows of other labels inside each positive's window. Their scores are
packed into keys (anchor, descending score, kind, id); pairs are dealt out by
anchor and sorted by key inside each partition, so that one pass over a
partition meets an anchor's pairs in order of score: a positive opens a window,
negatives are given out for all windows that are open, and no anchor's pairs
are held.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspar.operators.order import top_per_group
from quillspar.session import Workspace, ship

POSITIVES = 5
NEGATIVES = 10
#: A negative's score lies between these percentages of the positive's.
WINDOW = (30, 90)
#: Components are taken as floor(SCALE * x).
SCALE = 256
#: Most rows and anchors that meet in one cell, and anchors that are scored at once.
CELL_ROWS = 1 << 13
CELL_ANCHORS = 1 << 11
AT_ONCE = 256
_FLIP = 1 << 63


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, vector) of the rows that take part: nothing is null, and all components are finite."""
    double = F.transform(vector_col, lambda x: x.cast("double"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), double.alias("vector"))
    return rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & F.coalesce(F.forall("vector", finite), F.lit(False)))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Whole-numbered components, one row each; shorter vectors are filled up with 0."""
    lists = column.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = np.floor(SCALE * lists.flatten().to_numpy(zero_copy_only=False))
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products; beyond 64 bits the nearest that they hold."""
    bound = np.abs(anchors).max(initial=0) * np.abs(rows).max(initial=0) * max(1, rows.shape[1])
    if bound < 2.0**53:  # all sums are whole doubles
        return (anchors @ rows.T).astype(np.int64)
    if bound < 2.0**62:
        return anchors.astype(np.int64) @ rows.astype(np.int64).T
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(anchors) @ whole(rows).T, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _best(score: np.ndarray, most: int) -> np.ndarray:
    """Places of the highest scores, the first among equals."""
    if len(score) > most:
        kept = np.flatnonzero(score >= np.partition(score, len(score) - most)[len(score) - most])
        return kept[np.argsort(-score[kept], kind="stable")[:most]]
    return np.argsort(-score, kind="stable")


def window_of(positive: int) -> tuple[int, int]:
    """Lowest and highest score of a negative: WINDOW per cent of the positive's; empty (lowest above highest) below 0."""
    return -(-WINDOW[0] * positive // 100), WINDOW[1] * positive // 100


def _cells(rows: DataFrame, anchors: DataFrame, row_parts: int, anchor_parts: int, choose) -> DataFrame:
    """(anchor, score, id): choose(scores, same label, other id, anchor's row) names the places that a cell gives out for an anchor.

    Each block of rows meets each block of anchors in one cell; both have a bounded size, however many there are.
    """
    each = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    left = rows.select("id", "label", "vector", "row_part", each(anchor_parts, "anchor_part"))
    right = anchors.select("id", "label", "vector", *[c for c in anchors.columns if c == "positives"], each(row_parts, "row_part"), "anchor_part")

    def meet(own: pa.Table, asked: pa.Table) -> pa.Table:
        width = max([0, *(int(t["vector"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False).max(initial=0)) for t in (own, asked) if t.num_rows)])
        out: list[tuple[np.ndarray, ...]] = []
        if own.num_rows and asked.num_rows:
            own = own.sort_by("id")
            ids, labels, vectors = own["id"].to_numpy(), own["label"].to_numpy(), _matrix(own["vector"], width)
            names, kinds, queries = asked["id"].to_numpy(), asked["label"].to_numpy(), _matrix(asked["vector"], width)
            given = asked["positives"].to_pylist() if "positives" in asked.column_names else [None] * len(names)
            for lo in range(0, len(names), AT_ONCE):
                block = scores(queries[lo : lo + AT_ONCE], vectors)
                for i, score in enumerate(block, lo):
                    at = choose(score, labels == kinds[i], ids != names[i], given[i])
                    out.append((np.full(len(at), names[i]), score[at], ids[at]))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["anchor", "score", "id"])

    keys = ["row_part", "anchor_part"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "anchor long, score long, id long")


def _positives(score: np.ndarray, same: np.ndarray, other: np.ndarray, _) -> np.ndarray:
    at = np.flatnonzero(same & other)
    return at[_best(score[at], POSITIVES)]


def _negatives(score: np.ndarray, same: np.ndarray, other: np.ndarray, positives: list[int] | None) -> np.ndarray:
    at = np.flatnonzero(~same & other)
    found = [np.zeros(0, np.int64)]
    for low, high in {window_of(p) for p in positives or []}:
        inside = at[(score[at] >= low) & (score[at] <= high)]
        found.append(inside[_best(score[inside], NEGATIVES)])
    return np.unique(np.concatenate(found))


def packed(anchor: np.ndarray, score: np.ndarray, negative: np.ndarray, ids: np.ndarray) -> pa.Array:
    """25-byte keys that sort, as bytes, by anchor, score from the highest, positives first, and id."""
    out = np.zeros(len(ids), np.dtype([("anchor", ">u8"), ("score", ">u8"), ("kind", "u1"), ("id", ">u8")]))
    flip = np.uint64(_FLIP)
    out["anchor"], out["score"] = anchor.astype(np.int64).view(np.uint64) ^ flip, ~(score.astype(np.int64).view(np.uint64) ^ flip)
    out["kind"], out["id"] = negative, ids.astype(np.int64).view(np.uint64) ^ flip
    return pa.array(out.tobytes(), pa.binary()) if not len(out) else pa.Array.from_buffers(pa.binary(25), len(out), [None, pa.py_buffer(out.tobytes())]).cast(pa.binary())


def unpacked(keys: pa.Array) -> tuple[list[int], list[int], list[int], list[int]]:
    """anchor, score, whether negative, id of such keys."""
    found = np.frombuffer(b"".join(keys.to_pylist()), np.dtype([("anchor", ">u8"), ("score", ">u8"), ("kind", "u1"), ("id", ">u8")]))
    flip = np.uint64(_FLIP)
    signed = lambda x: (x.astype(np.uint64) ^ flip).view(np.int64).tolist()
    return signed(found["anchor"]), signed(~found["score"].astype(np.uint64)), found["kind"].tolist(), signed(found["id"])


_MINED = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        anchor, score, negative, ids = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        yield pa.RecordBatch.from_arrays([batch.column(0), packed(anchor, score, negative, ids)], names=["anchor", "key"])


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of one partition, in order -> mined rows. What is held: the open windows of one anchor, POSITIVES at most."""
    current, windows, rows = None, [], []

    def flushed() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(_MINED)
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "rank" else pa.int64()) for n, c in zip(_MINED, columns, strict=True)], names=list(_MINED))

    for batch in batches:
        for anchor, score, negative, name in zip(*unpacked(batch.column(1)), strict=True):
            if anchor != current:
                current, windows = anchor, []
            if not negative:
                low, high = window_of(score)
                if low <= high:
                    windows.append([name, score, low, high, 0])
                continue
            for window in windows:
                positive, top, low, high, given = window
                if low <= score <= high and given < NEGATIVES:
                    window[4] = given + 1
                    rows.append((anchor, positive, given + 1, name, top, score))
            # Scores only fall from here.
            windows = [w for w in windows if score >= w[2] and w[4] < NEGATIVES]
        if len(rows) >= 10_000:
            yield flushed()
    yield flushed()


def hard_negatives(rows: DataFrame, every: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from (id, label, vector), see usable().

    Anchors are the rows whose id is divisible by `every`; positives their
    POSITIVES best other rows of the same label; for each, the first NEGATIVES
    rows of other labels whose scores lie in WINDOW per cent of the positive's.
    Higher scores come first, ties by smaller id. A positive of negative score
    has no negatives. Rows with the anchor's own id are never its partners;
    otherwise a repeated row is a row of its own, and of several anchors with
    one id the smallest (label, vector) counts. Vectors of different lengths
    are compared as if the shorter one went on with zeros.
    """
    spark = rows.sparkSession
    ship(spark)
    space = Workspace(spark)
    rows = space.write(rows.select("id", "label", "vector", F.xxhash64(F.monotonically_increasing_id()).alias("dealt")), "rows")
    asked = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("label", "vector")).alias("a")).select("id", "a.*")
    row_parts = max(1, math.ceil(rows.count() / (0.8 * CELL_ROWS)))
    asked = space.write(asked, "anchors")
    anchor_parts = max(1, math.ceil(asked.count() / (0.8 * CELL_ANCHORS)))
    rows = rows.withColumn("row_part", F.pmod("dealt", F.lit(row_parts)).cast("int"))
    asked = asked.withColumn("anchor_part", F.pmod(F.xxhash64("id"), F.lit(anchor_parts)).cast("int"))
    positives = space.write(top_per_group(_cells(rows, asked, row_parts, anchor_parts, _positives), ["anchor"], [F.desc("score"), "id"], POSITIVES).drop("place"), "positives")
    # POSITIVES numbers for each anchor at most.
    known = asked.join(positives.groupBy(F.col("anchor").alias("id")).agg(F.collect_list("score").alias("positives")), "id")
    negatives = _cells(rows, known, row_parts, anchor_parts, _negatives)
    pairs = positives.withColumn("negative", F.lit(0)).unionByName(negatives.withColumn("negative", F.lit(1))).select("anchor", "score", "negative", "id")
    keyed = pairs.mapInArrow(_keys, "anchor long, key binary").repartition("anchor").sortWithinPartitions("key")
    return keyed.mapInArrow(_stream, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


HARD_NEGATIVES_SQL = r"""
    WITH v AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
      FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
      SELECT a.vec_id AS anchor_id, v.vec_id AS id, a.label = v.label AS same, CAST(list_inner_product(a.e, v.e) AS BIGINT) AS score
      FROM v a JOIN v ON a.vec_id % 100 = 0 AND a.vec_id <> v.vec_id
    ), p AS (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS place FROM s WHERE same) WHERE place <= 5
    ), n AS (
      SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS place, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
    )
    SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE place <= 10
"""
