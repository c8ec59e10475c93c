"""N-gram Jaccard join by vertical partitioning.

All shingles (as 64-bit hashes) stand in one global order: those of one
document only, then those of a few, then the frequent ones, each by hash. The
order is cut into fragments. Fragments are counted apart to find the class of
every shingle; later the overlap of a candidate pair is counted apart in each
fragment and summed per pair.

Texts with the same set of shingles are one node. A node can only have a
partner if enough of its shingles occur elsewhere; the few that can go on with
the shingles of their prefix, and nodes that share one are candidates. Only
classes of linked nodes are wanted, so pairs are spared inside a class: first
each node is compared with the block's member that has the fewest shingles of
its own, then only members of blocks that still hold several classes, across
classes, by all bounds on size and position. No possible link between classes
is left out, and no block's pairs are all written down.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quillspar.llm import textkernel
from quillspar.llm.components import components
from quillspar.llm.tables import dealt, for_each_part, meet
from quillspar.session import Workspace, ship

WORDS = 5
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Fragments that rare and that frequent shingles are cut into; pair overlaps are counted in each.
FRAGMENTS = 2
#: Shingles of so many rows are frequent: last in the global order.
FREQUENT = 32
#: Hash bits that are counted; shingles that agree in them count together, which can only weaken pruning.
COUNT_BITS = 40
#: Most bits of the index of the class bitmaps, which are broadcast: 16 MB each whatever the input.
CLASS_BITS = 27
#: Rows of a block that one task compares with the block's others.
BLOCK_ROWS = 256
#: Hashes that a task sorts at once, and that a counted fragment holds about.
RUN = 1 << 20


def least_overlap(n: int, percent: int = PERCENT) -> int:
    """Fewest shingles that a document of n shares with any partner."""
    return -(-percent * n // 100)


def _pair_overlap(a: Column, b: Column, percent: int) -> Column:
    """Fewest shared shingles of a linked pair: percent * (a + b) / (100 + percent), rounded up."""
    return F.ceil(percent * (a + b) / (100 + percent) - 1e-9)


def _node(found: np.ndarray) -> int:
    """64-bit identity of a set of shingles."""
    with np.errstate(over="ignore"):
        total = np.add.reduce(textkernel.mix(found + np.uint64(0x5851F42D4C957F2D)))
        return int(textkernel.mix(np.array([total + np.uint64(len(found)) * np.uint64(0x9E3779B97F4A7C15)], np.uint64)).view(np.int64)[0])


def _rows(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows, rows.schema["id"].dataType.simpleString()


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    for batch in batches:
        for lo, hi, data, offsets in textkernel.chunks(batch.column(1)):
            hashes, firsts = textkernel.word_hashes(data, offsets, textkernel.NON_SPACE)
            yield batch.column(0).slice(lo, hi - lo), textkernel.shingles(hashes, firsts, words)


def nodes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(id, n, node): the number of distinct shingles and the identity of their set; node is null where there are none."""
    rows, kind = _rows(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _sets(batches, words):
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in sets], pa.int64()), pa.array([_node(s) if len(s) else None for s in sets], pa.int64())], names=["id", "n", "node"])

    return rows.mapInArrow(textkernel.giving_back(run), f"id {kind}, n long, node long")


def _pack(keys: np.ndarray) -> bytes:
    """Sorted keys as zstd-compressed byte planes of their differences."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def class_bitmaps(docs: DataFrame, total: int, id_col: str, text_col: str, words: int = WORDS, frequent: int = FREQUENT) -> tuple[np.ndarray, np.ndarray, int]:
    """Bitmaps over the first bits of a shingle's hash: seen in two places at least, seen in `frequent` places; and their bits.

    Tasks sort and count their own shingles and send each fragment of the hash
    range its part in packed form, so a shingle costs a few bytes and a
    frequent one no more than a rare one. Shingles that meet in a bit count as
    repeated, which only weakens pruning.
    """
    bits = int(min(CLASS_BITS, max(16, math.ceil(math.log2(max(8 * total, 2))))))
    depth = int(min(bits, max(0, math.ceil(math.log2(max(total / RUN, 1))))))
    rows, _ = _rows(docs, id_col, text_col)

    def send(held: list[np.ndarray]) -> pa.RecordBatch:
        ordered = np.sort(np.concatenate(held) >> np.uint64(64 - COUNT_BITS))
        first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        keys, counts = ordered[first], np.diff(np.append(first, len(ordered)))
        edges = np.searchsorted(keys, np.arange((1 << depth) + 1, dtype=np.uint64) << np.uint64(COUNT_BITS - depth))
        full = np.flatnonzero(np.diff(edges))
        packed = [_pack(keys[edges[f] : edges[f + 1]]) for f in full]
        amounts = [zstandard.ZstdCompressor(level=1).compress(np.minimum(counts[edges[f] : edges[f + 1]], 255).astype(np.uint8).tobytes()) for f in full]
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(packed, pa.binary()), pa.array(amounts, pa.binary())], names=["fragment", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, _, data, offsets in textkernel.chunks(batch.column(1)):
                hashes, firsts = textkernel.word_hashes(data, offsets, textkernel.NON_SPACE)
                windows = textkernel.combine(hashes, list(range(words)))
                ends = np.repeat(firsts[1:], np.diff(firsts))[: len(windows)]
                found = [windows[np.arange(len(windows)) + words <= ends]]
                length = np.diff(firsts)
                short = np.flatnonzero((length > 0) & (length < words))
                if len(short):
                    found.append(np.concatenate([textkernel.combine(hashes[firsts[r] : firsts[r + 1]], list(range(length[r])), salt=int(length[r])) for r in short.tolist()]))
                held += found
                size += sum(map(len, found))
                if size >= 2 * RUN:
                    yield send(held)
                    held, size = [], 0
        if size:
            yield send(held)

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        keys = np.concatenate([_unpack(b.as_py()) for b in table["keys"]])
        counts = np.concatenate([np.frombuffer(zstandard.ZstdDecompressor().decompress(b.as_py()), np.uint8) for b in table["counts"]]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        sums = np.add.reduceat(counts, first)
        fragment = key[0].as_py()
        slots = (keys[first] >> np.uint64(COUNT_BITS - bits)).astype(np.int64) - (fragment << (bits - depth))
        out = []
        for least in (2, frequent):
            flags = np.zeros(max(8, 1 << (bits - depth)), bool)
            flags[slots[sums >= least]] = True
            out.append(pa.array([zstandard.ZstdCompressor(level=1).compress(np.packbits(flags, bitorder="little").tobytes())], pa.binary()))
        return pa.Table.from_arrays([pa.array([fragment], pa.int64()), *out], names=["fragment", "seen", "often"])

    sent = rows.mapInArrow(textkernel.giving_back(run), "fragment long, keys binary, counts binary")
    merged = sent.groupBy("fragment").applyInArrow(merge, "fragment long, seen binary, often binary")
    seen, often = (np.zeros(1 << bits >> 3, np.uint8) for _ in range(2))
    width = 1 << (bits - depth) >> 3
    for row in merged.toLocalIterator():  # the bitmaps' fixed size in all
        for to, blob in ((seen, row["seen"]), (often, row["often"])):
            part = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
            to[row["fragment"] * width : row["fragment"] * width + width] = part[:width]
    return seen, often, bits


def candidates(docs: DataFrame, bitmaps: tuple[np.ndarray, np.ndarray, int], id_col: str, text_col: str, words: int = WORDS, percent: int = PERCENT, fragments: int = FRAGMENTS) -> DataFrame:
    """(node, n, own, keys, parts) of documents that can have a partner.

    own: shingles that occur nowhere else, which stand first in the global
    order; keys: the rest of the prefix; parts: the other shingles, cut where
    the order goes from rare to frequent ones and at equal steps of the hash
    inside either, as sorted 64-bit numbers. A node that one task sees again
    isn't repeated.
    """
    seen, often, bits = bitmaps
    shared = docs.sparkSession.sparkContext.broadcast((seen, often))
    rows, _ = _rows(docs, id_col, text_col)
    part_type = pa.list_(pa.binary())

    def flagged(table: np.ndarray, slots: np.ndarray) -> np.ndarray:
        return (table[slots >> 3] >> (slots & 7).astype(np.uint8) & 1).astype(bool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, often = shared.value
        steps = np.array([(i << 64) // fragments for i in range(1, fragments)], np.uint64)
        given: set[int] = set()
        for _, sets in _sets(batches, words):
            out: list[tuple] = []
            if sets:
                every = np.concatenate(sets)
                slots = (every >> np.uint64(64 - bits)).astype(np.int64)
                known = flagged(seen, slots)
                frequent = np.zeros(len(every), bool)
                frequent[known] = flagged(often, slots[known])
                at = 0
            for s in sets:
                here, hot = known[at : at + len(s)], frequent[at : at + len(s)]
                at += len(s)
                n, least = len(s), least_overlap(len(s), percent)
                if not n or int(here.sum()) < least:
                    continue
                node = _node(s)
                if node in given:
                    continue
                if len(given) < 1 << 18:
                    given.add(node)
                own = n - int(here.sum())
                classes = (s[here & ~hot], s[hot])
                keys = np.concatenate(classes)[: n - least + 1 - own]
                parts = [part.tobytes() for c in classes for part in np.split(c, np.searchsorted(c, steps))]
                out.append((node, n, own, keys.view(np.int64), parts))
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.list_(pa.int64())), pa.array(columns[4], part_type)],
                    names=["node", "n", "own", "keys", "parts"],
                )

    return rows.mapInArrow(textkernel.giving_back(run), "node long, n long, own long, keys array<bigint>, parts array<binary>")


def verified(pairs: DataFrame, parts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of pairs(a, b, n_a, n_b), a written table, that are links: partial overlaps are counted in each fragment and summed per pair."""
    left = parts.select(F.col("node").alias("a"), "fragment", F.col("part").alias("part_a"))
    right = parts.select(F.col("node").alias("b"), "fragment", F.col("part").alias("part_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros(batch.num_rows, np.int64)
            for i, (x, y) in enumerate(zip(batch.column(4), batch.column(5), strict=True)):
                both = np.concatenate((np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)))
                both.sort()
                found[i] = np.count_nonzero(both[1:] == both[:-1])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(found)], names=["a", "b", "n_a", "n_b", "partial"])

    beside = meet(pairs, right, ["b"], ["a"]).join(left, ["a", "fragment"]).select("a", "b", "n_a", "n_b", "part_a", "part_b")
    sums = beside.mapInArrow(textkernel.giving_back(run), "a long, b long, n_a long, n_b long, partial long").groupBy("a", "b", "n_a", "n_b").agg(F.sum("partial").alias("shared"))
    return sums.where(100 * F.col("shared") >= percent * (F.col("n_a") + F.col("n_b") - F.col("shared"))).select("a", "b")


def _possible(n_a: Column, rest_a: Column, n_b: Column, rest_b: Column, percent: int) -> Column:
    """Whether sizes allow a link where at most rest_a and rest_b shingles of either can be shared."""
    return (100 * n_a >= percent * n_b) & (100 * n_b >= percent * n_a) & (F.least(rest_a, rest_b) >= _pair_overlap(n_a, n_b, percent))


def node_classes(docs: DataFrame, total: int, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(node, label) of the nodes that have a link, label being the same for all that links connect."""
    space = Workspace(docs.sparkSession)
    bitmaps = class_bitmaps(docs, total, id_col, text_col, words)
    able = space.write(candidates(docs, bitmaps, id_col, text_col, words, percent), "able")
    one = able.groupBy("node").agg(F.first("n").alias("n"), F.first("own").alias("own"), F.first("keys").alias("keys"), F.first("parts").alias("parts"))
    one = space.write(one, "nodes")
    space.drop("able")
    parts = one.select("node", F.posexplode("parts").alias("fragment", "part"))
    # rest: shingles from this place of the order on; of a pair's first common key, it bounds what they share
    keys = one.select("node", "n", "own", F.posexplode("keys").alias("at", "key")).select("key", "node", "n", (F.col("n") - F.col("own")).alias("usable"), (F.col("n") - F.col("own") - F.col("at")).alias("rest"), "own")

    leads = keys.groupBy("key").agg(F.min(F.struct("own", "node", "n", "usable")).alias("lead"), F.count("*").alias("size")).where("size > 1").select("key", "lead")
    first = meet(keys, leads, ["key"], ["node"]).where((F.col("node") != F.col("lead.node")) & _possible(F.col("n"), F.col("usable"), F.col("lead.n"), F.col("lead.usable"), percent))
    first = first.select(F.col("node").alias("a"), F.col("lead.node").alias("b"), F.col("n").alias("n_a"), F.col("lead.n").alias("n_b")).distinct()
    first = space.write(first, "first")
    links = space.write(verified(first, parts, percent), "links")
    classes = components(links)

    labelled = keys.join(classes, "node", "left").withColumn("label", F.coalesce("label", "node"))
    open_keys = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("n").alias("least_n"), F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("parts")).where("low <> high").select("key", "least_n", "parts")
    floor_n = F.greatest("least_n", F.ceil(F.col("n") * percent / 100))
    left_over = dealt(labelled, "node").join(for_each_part(open_keys), ["key", "_part"]).where(F.col("rest") >= _pair_overlap(F.col("n"), floor_n, percent))
    # Sizes of a linked pair differ by a factor of 100 / percent at most, so it lies in one band or in two that touch.
    band = F.floor(F.log(F.col("n").cast("double")) / (math.log(100 / percent) * (1 + 1e-9))) if percent < 100 else F.col("n")
    left_over = space.write(left_over.select("key", "node", "n", "rest", "label", "parts", band.cast("int").alias("band")), "open")
    # A block is cut into bands, and its rows are dealt over parts that each meet the whole band.
    x = left_over.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).alias("x")
    y = left_over.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("beside", F.explode(F.array(F.col("band"), F.col("band") - 1))).alias("y")
    across = (F.struct("x.n", "x.node") < F.struct("y.n", "y.node")) & (F.col("x.label") != F.col("y.label")) & _possible(F.col("x.n"), F.col("x.rest"), F.col("y.n"), F.col("y.rest"), percent)
    more = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.band") == F.col("y.beside")) & (F.col("x.part") == F.col("y.part")) & across)
    swap = F.col("x.node") > F.col("y.node")
    ends = lambda one, other, name: F.when(swap, F.col(other)).otherwise(F.col(one)).alias(name)
    more = more.select(ends("x.node", "y.node", "a"), ends("y.node", "x.node", "b"), ends("x.n", "y.n", "n_a"), ends("y.n", "x.n", "n_b")).distinct()
    more = more.join(first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    new = space.write(verified(space.write(more, "more"), parts, percent), "new_links")
    if new.isEmpty():
        return classes
    return components(links.unionByName(new))


def _placed(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """known (id, n, node) of every row, and placed (node, least_id, label) of every node."""
    ship(docs.sparkSession)
    textkernel.small_batches(docs.sparkSession)
    space = Workspace(docs.sparkSession)
    known = space.write(nodes(docs, id_col, text_col, words), "known")
    total = known.agg(F.sum("n")).first()[0] or 0
    classes = node_classes(docs, total, id_col, text_col, words, percent)
    least = known.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("least_id"))
    return known, least.join(classes, "node", "left").withColumn("label", F.coalesce("label", "node"))


def ngram_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row: id, n_shingles and component_id, the smallest id that links reach from it, itself included.

    A text's set holds the distinct shingles of `words` consecutive words
    (divided by ASCII white space, A-Z in lower case); a text with fewer words
    is one shingle. Two texts link when 100 * |both| >= percent * |either|.

    Null and wordless texts have an empty set, link with nothing and keep their
    own id. Rows with equal sets are linked; rows that repeat an id get the
    same answer as if they were two documents with that id. Shingles are
    compared by 64-bit hashes, sets of equal size by the hash of all of them.
    """
    known, placed = _placed(docs, id_col, text_col, words, percent)
    reached = placed.groupBy("label").agg(F.min("least_id").alias("component_id"))
    named = meet(placed, reached, ["label"], ["node"]).select("node", "component_id")
    # The copies of one set of shingles are many rows of one node.
    return meet(known, named, ["node"], ["id"], "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def _with_node(docs: DataFrame, text_col: str, words: int) -> DataFrame:
    """docs, all columns as they are, with `_node`, the identity of each row's set (null where it is empty)."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_node(s) if len(s) else None for _, sets in _sets(iter([pa.RecordBatch.from_arrays([batch.column(at)] * 2, names=["id", "text"])]), words) for s in sets]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=[*batch.schema.names, "_node"])

    return docs.mapInArrow(textkernel.giving_back(run), StructType([*docs.schema.fields, StructField("_node", LongType())]))


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each group that links connect: the one with the smallest id (null last), of equal ids that with the smallest identity of its set.

    Rows are judged one by one, whatever ids they have: of rows that repeat an
    id each stays or goes with its own text, and rows without an id go where
    their group has another row. Of rows with the id and the set of the one
    that stays, any one stays. Null and wordless texts link with nothing and
    all stay.
    """
    known, placed = _placed(docs, id_col, text_col, words, percent)
    first = F.min(F.struct(F.col("least_id").isNull().alias("none"), F.col("least_id").alias("id"), "node")).alias("first")
    stays = meet(placed, placed.groupBy("label").agg(first), ["label"], ["node"]).select("node", F.col("first.node").alias("_first"), F.col("first.id").alias("_first_id"))
    goes = (F.col("node") != F.col("_first")) | ~F.col("id").eqNullSafe(F.col("_first_id"))
    space = Workspace(docs.sparkSession)
    rows = known.where("node IS NOT NULL").groupBy("id", "node").agg(F.count("*").alias("many"))
    judged = space.write(meet(rows, stays, ["node"], ["id"]).select("id", "node", "many", goes.alias("goes")), "judged")
    # An id that one row has tells it; the others are told by id and set.
    shared = space.write(known.groupBy("id").count().where("id IS NULL OR count > 1").select(F.col("id").alias("_shared")), "shared")
    dropped = judged.where("goes").select(F.col("id").alias("_id"), F.col("node").alias("_of"))
    if shared.isEmpty():
        return docs.join(dropped, docs[id_col] == dropped["_id"], "left_anti")
    own = docs.join(shared, docs[id_col].eqNullSafe(shared["_shared"]), "left_anti")
    own = own.join(dropped, own[id_col] == dropped["_id"], "left_anti")
    told = _with_node(docs.join(shared, docs[id_col].eqNullSafe(shared["_shared"]), "left_semi"), text_col, words)
    told = told.join(dropped, told[id_col].eqNullSafe(dropped["_id"]) & (told["_node"] == dropped["_of"]), "left_anti")
    repeats = judged.where("NOT goes AND many > 1").select(F.col("id").alias("_id"), F.col("node").alias("_of"))
    same = told[id_col].eqNullSafe(repeats["_id"]) & (told["_node"] == repeats["_of"])
    once = told.join(repeats, same, "left_semi").dropDuplicates([id_col, "_node"])
    return own.unionByName(told.join(repeats, same, "left_anti").unionByName(once).drop("_node"))
