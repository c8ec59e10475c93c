"""Exact duplicates by an extendible-hash index on shared files, in DataFrame operations only.

Texts are equal when they are identical after each run of ASCII white space
became one space. A directory of 2**depth slots points, by the first bits of a
text's hash, to buckets. It begins with one bit; a bucket with more hashes than
it may hold is split by one more bit, and the directory doubles when that
bucket had as many bits as the directory. Every row finds its bucket through the directory; the task that
owns the bucket's key range compares whole texts, gives each different text of
a hash a place in the hash's chain, and tells which id stays. Rows then look
their chain entry up in their bucket.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspar.llm.tables import PARTS, WHITE_RUN, for_each_part, text_or_empty
from quillspar.session import Workspace

#: Hashes that a bucket may hold.
BUCKET_ENTRIES = 256
#: Bits beyond those that even hashes need, to which hashes are counted once; doublings up to there add these counts up.
SPARE_BITS = 2
#: A bucket with a hash of more rows than this is dealt over several tasks, whose results are merged.
SHARE_ROWS = 1 << 16
#: A directory of at most so many slots (some 32 MB) is sent to all tasks; a larger one is joined by slot.
BROADCAST_SLOTS = 1 << 20


def normalised(text: str | Column) -> Column:
    return F.regexp_replace(text_or_empty(text), WHITE_RUN, " ")


def _slot(depth: int) -> Column:
    return F.shiftrightunsigned("key", 64 - depth)


class Directory:
    """slots: (slot, bucket, local, shares), one row for each slot of the last doubling that any hash falls in.

    A bucket is named by the lowest hash of its range; `local` is the number
    of bits that all its hashes share; `shares` the tasks that its rows are
    dealt over, more than one only where a hash has very many rows.
    """

    def __init__(self, keys: DataFrame, space: Workspace, capacity: int, share_rows: int):
        """keys: (key, rows), one row for each hash."""
        total = keys.count()
        self.keys, self.doublings, self.depth = keys, 0, 1
        self.counted = min(64, max(1, math.ceil(math.log2(max(total / capacity, 1)))) + SPARE_BITS)
        self.cells = space.write(self._counted(self.counted), "cells")
        state = space.write(self._counts().select("*", self._bucket(F.lit(1)).alias("bucket"), F.lit(1).alias("local")), "directory0")
        while self.depth < 64:
            sizes = state.groupBy("bucket").agg(F.sum("entries").alias("entries"), F.min("low").alias("low"), F.max("high").alias("high"))
            overfull = sizes.where((F.col("entries") > capacity) & (F.col("low") != F.col("high"))).select("bucket", F.lit(1).alias("overfull"))
            if overfull.isEmpty():
                break
            # The buckets to split have as many bits as the directory: those with fewer didn't overflow when they had them.
            old = state.join(overfull, "bucket", "left").select(F.explode(F.array(F.col("slot") * 2, F.col("slot") * 2 + 1)).alias("slot"), "bucket", "local", "overfull")
            self.depth += 1
            self.doublings += 1
            doubled = self._counts().join(old, "slot")
            split = F.col("overfull").isNotNull()
            state = doubled.select("slot", "entries", "low", "high", "most", F.when(split, self._bucket(F.lit(self.depth))).otherwise(F.col("bucket")).alias("bucket"), F.when(split, F.lit(self.depth)).otherwise(F.col("local")).alias("local"))
            state = space.write(state, f"directory{self.doublings}")
        shares = state.groupBy("bucket").agg(F.ceil(F.max("most") / share_rows).cast("int").alias("shares"))
        self.slots = space.write(state.select("slot", "bucket", "local").join(shares, "bucket"), "directory")
        self.small = self.slots.count() <= BROADCAST_SLOTS

    def _counted(self, depth: int) -> DataFrame:
        return self.keys.groupBy(_slot(depth).alias("slot")).agg(F.count("*").alias("entries"), F.min("key").alias("low"), F.max("key").alias("high"), F.max("rows").alias("most"))

    def _counts(self) -> DataFrame:
        """What falls in each slot: the cells added up, or, deeper than these, the hashes counted anew."""
        if self.depth > self.counted:
            return self._counted(self.depth)
        slot = F.shiftrightunsigned("slot", self.counted - self.depth).alias("slot")
        return self.cells.groupBy(slot).agg(F.sum("entries").alias("entries"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("most").alias("most"))

    def _bucket(self, local: Column) -> Column:
        return F.call_function("shiftleft", F.col("slot"), (F.lit(64) - local).cast("int"))

    def route(self, rows: DataFrame) -> DataFrame:
        """rows (with their `key`) with bucket, shares and the share that each falls in."""
        slots = self.slots.select("slot", "bucket", "shares")
        rows = rows.withColumn("slot", _slot(self.depth))
        if self.small:
            found = rows.join(F.broadcast(slots), "slot").drop("slot")
        else:  # a frequent text is many rows of one slot
            part = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(PARTS)).cast("int")
            found = rows.withColumn("_part", part).join(for_each_part(slots), ["slot", "_part"]).drop("slot", "_part")
        return found.withColumn("share", F.when(F.col("shares") > 1, F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.col("shares"))).otherwise(F.lit(0)))


class ExactIndex:
    """The index of a document table: `directory`, and `entries` (bucket, key, chain, text_sha256, keep_id, group_size, shares) on shared files."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = BUCKET_ENTRIES, share_rows: int = SHARE_ROWS, hashed: Callable[[str], Column] = F.xxhash64):
        self.id_col = id_col
        space = Workspace(docs.sparkSession)
        texts = docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("text")).withColumn("key", hashed("text").cast("long"))
        self.postings = space.write(texts.select("id", "key", F.sha2("text", 256).alias("text_sha256")), "postings")
        keys = space.write(self.postings.groupBy("key").agg(F.count("*").alias("rows")), "keys")
        self.directory = Directory(keys, space, capacity, share_rows)
        # Owner tasks: whole texts meet by bucket and are compared there; nothing is shuffled again for that.
        owned = self.directory.route(texts).repartition("bucket", "share")
        same = owned.groupBy("bucket", "share", "shares", "key", "text").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
        # One row for each text and share; the texts of buckets with several shares go along and are compared once more.
        same = same.select("bucket", "shares", "key", F.sha2("text", 256).alias("text_sha256"), F.when(F.col("shares") > 1, F.col("text")).alias("text"), "keep_id", "group_size")
        merged = same.repartition("bucket", "key").groupBy("bucket", "shares", "key", "text_sha256", "text").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
        chain = F.row_number().over(Window.partitionBy("bucket", "key").orderBy(F.col("keep_id").asc_nulls_last(), "text_sha256"))
        self.entries = space.write(merged.withColumn("chain", chain).drop("text"), "entries")

    def classes(self) -> DataFrame:
        """Per row of the indexed table: id, keep_id, group_size, kept and text_sha256, from its entry in its bucket."""
        rows = self.directory.route(self.postings)
        entries = self.entries.select("bucket", "key", "text_sha256", "keep_id", "group_size", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
        found = rows.join(entries, ["bucket", "key", "share", "text_sha256"])
        kept = F.coalesce(F.col("id") == F.col("keep_id"), F.col("keep_id").isNull())
        return found.select(F.col("id").alias(self.id_col), "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256 (lower-case hex of the normalised text).

    Of equal texts the smallest id stays. Null and empty texts are equal to
    each other. Rows that repeat an id with the same text are one document
    written twice: both show kept where that id is the smallest. A null id
    stays only where the whole group has none. Texts are compared whole; other
    columns are not read.
    """
    return ExactIndex(docs, id_col, text_col, **options).classes()


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the rows whose text an earlier id has; all columns stay."""
    kept = exact_duplicates(docs, id_col, text_col, **options).where("kept").select(F.col(id_col).alias("_keep_id"), F.col("text_sha256").alias("_keep_sha")).distinct()
    same = docs[id_col].eqNullSafe(kept["_keep_id"]) & (F.sha2(normalised(docs[text_col]), 256) == kept["_keep_sha"])
    return docs.join(kept, same, "left_semi")
