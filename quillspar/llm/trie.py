"""Prefix trie of conversations as shards of minimal-perfect-hash node tables.

Conversations are rebuilt, their turns hashed, and each prefix named by a
digest of 128 bits: two lanes, each the exclusive or of its turns' hashes with
their depths, so that a prefix's parent is known from its own last turn.
Shards hold whole families of conversations (or stretches of very long ones). A
shard enumerates its distinct digests, gives each a slot by a minimal perfect
hash and scatters counts into flat arrays; nodes are the sums over shards. What
a node adds to its ancestors (a leaf, saved tokens) is then put into the one
shard of its smallest member, whose path holds all its ancestors, and added up
through the parents' slots, deepest first; the shards' sums make the subtrees'.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspar.llm.tables import meet
from quillspar.llm.textkernel import mix
from quillspar.session import Workspace, ship

#: Conversations of one hundred share the start of the first of them.
FAMILY = 100
#: At most so many turns of the first one are shared, less one.
SHARED = 6
#: Rows that a shard holds, about so many; and turns of one conversation that stay in one shard.
SHARD_ROWS = 1 << 16
STRETCH = 1 << 10
#: Ids that make one text on their way to a node's digest of them.
CHUNK_IDS = 1 << 12
_NO_TURN = "00" * 32


class NodeTable:
    """Slots 0 to n - 1 for n distinct digests.

    Each level hashes what is left into twice as many places; whoever has a
    place alone takes it, and its slot is its rank among all that are taken.
    Digests are kept by slot: what was not among them is told by comparison.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        left, done, slots = np.arange(len(a)), 0, np.full(len(a), -1)
        while len(left):
            at = self._places(a[left], b[left], len(self.levels), 2 * len(left))
            taken = np.bincount(at, minlength=2 * len(left)) == 1
            ranks = np.cumsum(taken) - 1 + done
            alone = taken[at]
            slots[left[alone]] = ranks[at[alone]]
            self.levels.append((taken, ranks))
            done += int(alone.sum())
            left = left[~alone]
        self.a, self.b = np.empty_like(a), np.empty_like(b)
        self.a[slots], self.b[slots] = a, b

    @staticmethod
    def _places(a: np.ndarray, b: np.ndarray, level: int, width: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix(a.view(np.uint64) ^ mix(b.view(np.uint64) + np.uint64((2 * level + 1) * 0x9E3779B97F4A7C15 % 2**64))) % np.uint64(width)).astype(np.int64)

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each digest; -1 for digests that the table doesn't hold."""
        out, left = np.full(len(a), -1), np.arange(len(a))
        for level, (taken, ranks) in enumerate(self.levels):
            at = self._places(a[left], b[left], level, len(taken))
            out[left[taken[at]]] = ranks[at[taken[at]]]
            left = left[~taken[at]]
        if len(self.a):
            out[(self.a[out] != a) | (self.b[out] != b)] = -1
        return out


def _distinct(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of one row for each distinct digest."""
    order = np.lexsort((b, a))
    new = np.ones(len(a), bool)
    new[1:] = (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)
    return order[new]


def _ints(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table[n].to_numpy().astype(np.int64, copy=False) for n in names]


_LOCAL = ["shard", "a", "b", "up_a", "up_b", "depth", "turn", "points", "n", "least", "clash"]


def enumerated(rows: pa.Table) -> pa.Table:
    """Prefix rows of one shard -> its nodes: digest, parent's digest, depth, last turn, its code points, members and the smallest; and whether rows of one digest disagree."""
    rows = rows.sort_by([("conv", "ascending"), ("stretch", "ascending"), ("depth", "ascending")])
    shard, conv, stretch, depth, ha, hb, before_a, before_b, points = _ints(rows, "shard", "conv", "stretch", "depth", "ha", "hb", "before_a", "before_b", "points")
    turn = np.frombuffer(b"".join(rows["turn"].to_pylist()), "<i8").reshape(-1, 4)
    first = np.ones(len(conv), bool)
    first[1:] = (np.diff(conv) != 0) | (np.diff(stretch) != 0)
    start = np.flatnonzero(first)[np.cumsum(first) - 1]
    lanes = []
    for h, before in ((ha, before_a), (hb, before_b)):
        run = np.bitwise_xor.accumulate(h)
        lanes.append(run ^ run[start] ^ h[start] ^ before)
    a, b = lanes
    up_a, up_b = a ^ ha, b ^ hb
    one = _distinct(a, b)
    table = NodeTable(a[one], b[one])
    slot = table.slots(a, b)
    n = len(one)
    row = np.empty(n, np.int64)
    row[slot[::-1]] = np.arange(len(slot))[::-1]  # the slot's first row, whose conversation is the smallest
    of = row[slot]
    wrong = (up_a != up_a[of]) | (up_b != up_b[of]) | (depth != depth[of]) | (turn != turn[of]).any(axis=1)
    clash = np.zeros(n, bool)
    np.logical_or.at(clash, slot, wrong)
    columns = [shard[row], table.a, table.b, up_a[row], up_b[row], depth[row], None, points[row], np.bincount(slot, minlength=n), conv[row], clash]
    return pa.table([rows["turn"].take(pa.array(row)) if c is None else pa.array(c) for c in columns], names=_LOCAL)


def accumulated(rows: pa.Table, stretch: int) -> pa.Table:
    """Nodes of one shard (own false) and what nodes add (own true) -> per node the sums over its subtree in this shard, where they aren't 0."""
    own = rows["own"].to_numpy()
    a, b, up_a, up_b, depth, leaves, saved = _ints(rows, "a", "b", "up_a", "up_b", "depth", "leaves", "saved")
    at = np.flatnonzero(~own)
    table = NodeTable(a[at], b[at])
    slot = table.slots(a[at], b[at])
    n = len(at)
    parent, level = np.full(n, -1), np.zeros(n, np.int64)
    parent[slot], level[slot] = table.slots(up_a[at], up_b[at]), depth[at]
    parent[(level == 0) | ((level > 1) & (level % stretch == 1))] = -1  # what a stretch hands on to the one before comes with what nodes add
    to, given = table.slots(a[own], b[own]), np.flatnonzero(own)
    sums = [np.zeros(n, np.int64), np.zeros(n, np.int64)]
    for total, adds in zip(sums, (leaves, saved), strict=True):
        np.add.at(total, to, adds[given])
    order = np.argsort(-level, kind="stable")
    order = order[parent[order] >= 0]
    for same in np.split(order, np.flatnonzero(np.diff(level[order])) + 1):
        for total in sums:
            np.add.at(total, parent[same], total[same])
    some = np.flatnonzero((sums[0] != 0) | (sums[1] != 0))
    return pa.table([table.a[some], table.b[some], sums[0][some], sums[1][some]], names=["a", "b", "leaves", "saved"])


def shared_turns(conv: Column) -> Column:
    """How many turns a conversation takes from the first of its family."""
    return (F.crc32(conv.cast("string").cast("binary")) % SHARED).cast("long")


def _stretch(depth: Column) -> Column:
    return F.expr("0").cast("long") + F.floor(F.greatest(depth - 1, F.lit(0)) / STRETCH)


def rebuilt(space: Workspace, conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(conv, base, depth, turn, points) of all rebuilt turns, and (conv, base, n) of all conversations.

    Turns are put in order by ranges and numbered inside each conversation
    from what lies in the ranges before, so that a long one isn't one group.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((role_col, "role"), (text_col, "text")))
    turns = conversations.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("at"), role, text)
    order = ["conv", F.col("at").asc_nulls_first(), "role", "text"]
    key = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    ranged = turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", key.alias("turn"), F.length("text").cast("long").alias("points"), F.monotonically_increasing_id().alias("number"))
    ranged = space.write(ranged.withColumn("range", F.shiftright("number", 33)), "turns")
    counts = ranged.groupBy("conv", "range").agg(F.count("*").alias("n"), F.min("number").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = space.write(counts.withColumn("before", before), "counts")
    placed = ranged.join(counts.select("conv", "range", "first", "before").hint("merge"), ["conv", "range"]).select("conv", (F.col("number") - F.col("first") + F.col("before") + 1).alias("place"), "turn", "points")

    base = F.col("conv") - F.col("conv") % FAMILY
    lengths = counts.groupBy("conv").agg(F.sum("n").alias("n"))
    firsts = lengths.where(F.col("conv") % FAMILY == 0).select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    taken = F.least(shared_turns(F.col("conv")), F.coalesce("base_n", F.lit(0)))
    convs = lengths.withColumn("base", base).join(firsts.hint("merge"), "base", "left").select("conv", "base", taken.alias("taken"), (taken + F.greatest(F.col("n") - shared_turns(F.col("conv")), F.lit(0))).alias("n"))
    convs = space.write(convs, "convs")
    starts = placed.where((F.col("conv") % FAMILY == 0) & (F.col("place") < SHARED)).withColumnRenamed("conv", "base")  # a few for each family
    heads = convs.join(starts.hint("merge"), "base").where(F.col("place") <= F.col("taken")).select("conv", F.col("place").alias("depth"), "turn", "points")
    rest = placed.where(F.col("place") > shared_turns(F.col("conv")))
    tails = meet(rest, convs.select("conv", "taken"), ["conv"], ["place"]).select("conv", (F.col("place") - shared_turns(F.col("conv")) + F.col("taken")).alias("depth"), "turn", "points")
    return space.write(heads.unionByName(tails).withColumn("base", base), "rebuilt"), convs.drop("taken")


def _prefixes(space: Workspace, rows: DataFrame, convs: DataFrame, attempt: int, bits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Prefix rows dealt to shards, (conv, stretch, before_a, before_b) of later stretches, and (conv, a, b) of whole conversations."""
    lane = lambda i: F.xxhash64(F.lit(2 * attempt + i), "turn", "depth").bitwiseAND(F.lit((1 << bits) - 1 if bits < 64 else -1))
    rows = rows.withColumns({"ha": lane(0), "hb": lane(1), "stretch": _stretch(F.col("depth"))})
    root = convs.select("conv", "base", F.lit(0).cast("long").alias("depth"), F.unhex(F.lit(_NO_TURN)).alias("turn"), *[F.lit(0).cast("long").alias(c) for c in ("points", "ha", "hb", "stretch")])
    long = convs.where(F.col("n") > STRETCH).select("conv")
    sums = rows.join(long.hint("merge"), "conv", "left_semi").groupBy("conv", "stretch").agg(F.bit_xor("ha").alias("xa"), F.bit_xor("hb").alias("xb"))
    before = Window.partitionBy("conv").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = space.write(sums.select("conv", "stretch", F.bit_xor("xa").over(before).alias("before_a"), F.bit_xor("xb").over(before).alias("before_b")).where("stretch > 0"), f"offsets{attempt}")
    every = rows.select(*root.columns).unionByName(root)
    ends = every.groupBy("conv").agg(F.bit_xor("ha").alias("a"), F.bit_xor("hb").alias("b"))
    shards = max(1, math.ceil((rows.count() + convs.count()) / SHARD_ROWS))
    early = every.where("stretch = 0").withColumn("before_a", F.lit(0).cast("long")).withColumn("before_b", F.lit(0).cast("long"))
    late = every.where("stretch > 0").join(offsets.hint("merge"), ["conv", "stretch"])
    return early.unionByName(late).withColumn("shard", _shard(F.col("base"), F.col("stretch"), shards)), offsets, ends, shards


def _shard(base: Column, stretch: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(base, stretch), F.lit(shards)).cast("long")


def ends_digests(ends: DataFrame) -> DataFrame:
    """(a, b, conv) -> (a, b, ends): lower-case SHA-256 of each node's ids, ascending and joined by commas.

    Ids are sorted by ranges, so those of one node may lie in many; each range
    joins its own into texts of CHUNK_IDS, and a node's texts go through one
    running hash in their order.
    """

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, conv = (c.to_numpy() for c in batch.columns)
            new = np.ones(len(a), bool)
            new[1:] = (np.diff(a) != 0) | (np.diff(b) != 0)
            edges = [*np.flatnonzero(new).tolist(), len(a)]
            cuts = [(lo, min(hi, lo + CHUNK_IDS)) for first, hi in zip(edges[:-1], edges[1:], strict=True) for lo in range(first, hi, CHUNK_IDS)]
            at = np.array([lo for lo, _ in cuts], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a[at]), pa.array(b[at]), pa.array(conv[at]), pa.array([",".join(map(str, conv[lo:hi].tolist())) for lo, hi in cuts], pa.string())], names=["a", "b", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, running = None, None
        for batch in batches:
            out = []
            for a, b, ids in zip(*(batch.column(n).to_pylist() for n in ("a", "b", "ids")), strict=True):
                if (a, b) != current:
                    if current:
                        out.append((*current, running.hexdigest()))
                    current, running = (a, b), hashlib.sha256(ids.encode())
                else:
                    running.update(b"," + ids.encode())
            if out:
                yield _named(out)
        if current:
            yield _named([(*current, running.hexdigest())])

    def _named(rows: list[tuple]) -> pa.RecordBatch:
        a, b, ends = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(ends, pa.string())], names=["a", "b", "ends"])

    chunks = ends.select("a", "b", "conv").repartitionByRange("a", "b", "conv").sortWithinPartitions("a", "b", "conv").mapInArrow(texts, "a long, b long, first long, ids string")
    return chunks.repartition("a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(hashed, "a long, b long, ends string")


def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", bits: int = 64) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations.

    Turns go by `turn`, null first, then by role and text; a null role or text
    is empty. A conversation takes the first shared_turns() turns of the first
    of its hundred (none if there is no such) in place of as many of its own.
    A node is a distinct sequence of a conversation's first turns, from the
    root, the empty one. Columns: conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (over the
    subtree: members less one times the last text's code points), ends_sha256
    (of the ids of members that end here). Rows of a null conv_id belong to no
    conversation and take no part; an empty table has no node. bits: of each
    digest's lane; should two prefixes share a digest, all is hashed anew by
    other hashes of twice the bits (at most 64).
    """
    spark = conversations.sparkSession
    ship(spark)
    space = Workspace(spark)
    rows, convs = rebuilt(space, conversations, conv_col, turn_col, role_col, text_col)
    kinds = {"clash": "boolean", "turn": "binary"}
    attempt = 0
    while True:
        prefixes, offsets, ends, shards = _prefixes(space, rows, convs, attempt, bits)
        local = prefixes.groupBy("shard").applyInArrow(enumerated, ", ".join(f"{n} {kinds.get(n, 'long')}" for n in _LOCAL))
        local = space.write(local, f"local{attempt}")
        same = F.struct("up_a", "up_b", "depth", "turn")
        nodes = local.groupBy("a", "b").agg(F.min(same).alias("one"), F.max(same).alias("other"), F.min("least").alias("conv"), F.sum("n").alias("n_convs"), F.max("points").alias("points"), F.bool_or("clash").alias("clash"))
        nodes = nodes.select("a", "b", "one.up_a", "one.up_b", "one.depth", "conv", "n_convs", "points", (F.col("clash") | (F.col("one") != F.col("other"))).alias("clash"))
        nodes = space.write(nodes, f"nodes{attempt}")
        if nodes.where("clash").isEmpty():
            break
        attempt, bits = attempt + 1, min(64, 2 * bits)

    above = nodes.where("depth > 0")
    children = above.groupBy(F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children.hint("merge"), ["a", "b"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = space.write(nodes, "counted")
    adds = nodes.select("a", "b", "conv", _stretch(F.col("depth")).alias("stretch"), (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("points")).alias("saved"))
    # What later stretches of a long conversation add goes on from the last prefix of each stretch before.
    later = adds.where("stretch > 0").groupBy("conv", "stretch").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    stops = offsets.select("conv", (F.col("stretch") - 1).alias("stretch"), F.col("before_a").alias("a"), F.col("before_b").alias("b"))
    none = F.lit(None).cast("long")
    both = later.select("conv", "stretch", "leaves", "saved", none.alias("a"), none.alias("b")).unionByName(stops.select("conv", "stretch", F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"), "a", "b"))
    beyond = Window.partitionBy("conv").orderBy(F.desc("stretch")).rangeBetween(Window.unboundedPreceding, -1)
    carried = both.select("conv", "stretch", "a", "b", F.sum("leaves").over(beyond).alias("leaves"), F.sum("saved").over(beyond).alias("saved")).where("a IS NOT NULL AND leaves IS NOT NULL")
    given = adds.where("leaves <> 0 OR saved <> 0").unionByName(carried.select(*adds.columns)).withColumn("shard", _shard(F.col("conv") - F.col("conv") % FAMILY, F.col("stretch"), shards))
    stretch = STRETCH

    def accumulate(rows: pa.Table) -> pa.Table:
        return accumulated(rows, stretch)

    zero = F.lit(0).cast("long")
    pieces = local.select("shard", F.lit(False).alias("own"), "a", "b", "up_a", "up_b", "depth", zero.alias("leaves"), zero.alias("saved"))
    pieces = pieces.unionByName(given.select("shard", F.lit(True).alias("own"), "a", "b", zero.alias("up_a"), zero.alias("up_b"), zero.alias("depth"), "leaves", "saved"))
    sums = pieces.groupBy("shard").applyInArrow(accumulate, "a long, b long, leaves long, saved long").groupBy("a", "b").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))

    parents = meet(nodes.where("depth > 0").select("a", "b", "up_a", "up_b"), nodes.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv").alias("parent_conv_id")), ["up_a", "up_b"], ["a"]).select("a", "b", "parent_conv_id")
    found = nodes.join(sums.hint("merge"), ["a", "b"]).join(parents.hint("merge"), ["a", "b"], "left").join(ends_digests(ends).hint("merge"), ["a", "b"], "left")
    nothing = F.lit(hashlib.sha256().hexdigest())
    return found.select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", nothing).alias("ends_sha256"))


PREFIX_TRIE_SQL = r"""
    WITH RECURSIVE t AS (
      SELECT conv_id AS c, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
      FROM conversations WHERE conv_id IS NOT NULL
    ), crc AS (
      SELECT c, CAST(c AS VARCHAR) AS s, 1 AS i, CAST(4294967295 AS BIGINT) AS v, 0 AS bit FROM (SELECT DISTINCT c FROM t)
      UNION ALL
      SELECT c, s, CASE WHEN bit = 8 THEN i + 1 ELSE i END,
             CASE WHEN bit = 0 THEN xor(v, CAST(ascii(s[i]) AS BIGINT)) ELSE xor(v >> 1, CASE WHEN v & 1 = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END) END,
             CASE WHEN bit = 8 THEN 0 ELSE bit + 1 END
      FROM crc WHERE i <= length(s)
    ), h AS (SELECT c, xor(v, CAST(4294967295 AS BIGINT)) % 6 AS h FROM crc WHERE i > length(s)
    ), r AS (
      SELECT h.c, t.x, t.p FROM h JOIN t ON t.c = h.c - h.c % 100 AND t.p <= h.h
      UNION ALL SELECT h.c, t.x, t.p + 1000000 FROM h JOIN t ON t.c = h.c AND t.p > h.h
    ), l AS (SELECT h.c, coalesce(list(r.x ORDER BY r.p) FILTER (WHERE r.p IS NOT NULL), []) AS xs FROM h LEFT JOIN r ON r.c = h.c GROUP BY h.c
    ), m AS (SELECT c, d, CASE WHEN d = 0 THEN [] ELSE xs[1:d] END AS pre, len(xs) = d AS ends FROM (SELECT c, xs, unnest(range(0, len(xs) + 1)) AS d FROM l)
    ), n AS (
      SELECT pre, d, min(c) AS conv_id, count(*) AS n_convs, CASE WHEN d = 0 THEN 0 ELSE length(pre[d].t) END AS points,
             sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
      FROM m GROUP BY pre, d
    ), k AS (
      SELECT n.conv_id, n.d, count(u.d) AS n_children, p.conv_id AS parent_conv_id FROM n
      LEFT JOIN n u ON u.d = n.d + 1 AND u.pre[1:n.d] = n.pre LEFT JOIN n p ON p.d = n.d - 1 AND p.pre = n.pre[1:n.d - 1] GROUP BY n.conv_id, n.d, p.conv_id
    ), s AS (
      SELECT n.conv_id, n.d, count(*) FILTER (WHERE k.n_children = 0) AS n_leaves, sum((u.n_convs - 1) * u.points) AS saved_tokens
      FROM n JOIN m ON m.d = n.d AND m.pre = n.pre JOIN n u ON u.conv_id = m.c AND u.d >= n.d JOIN k ON k.conv_id = u.conv_id AND k.d = u.d GROUP BY n.conv_id, n.d
    )
    SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, k.parent_conv_id, n.n_convs, k.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
    FROM n JOIN k ON k.conv_id = n.conv_id AND k.d = n.d JOIN s ON s.conv_id = n.conv_id AND s.d = n.d
"""
