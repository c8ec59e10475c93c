"""Benchmark decontamination by spaced-seed hashing.

Each mask names some positions of a window of words and ignores the others, so
a window with words replaced at ignored positions still has the same hash.
Hashes of the test passages and of all documents' windows are joined; a hit
lays the document's words beside the passage's, all of them, and the longest
stretch in which enough agree is the overlap.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspar.llm import textkernel
from quillspar.llm.tables import dealt, for_each_part, meet, text_or_empty
from quillspar.session import Workspace, ship

# Windows compare the words at 1 and ignore those at 0. LONG, of six words each, serve all passages of six words or more,
# SHORT, of five words, also those of fewer than OVERLAP_WORDS; FIVE, of four words, those of five words; a passage of one
# to four words is searched whole. A test enumerates that no accepted overlap is left without a seed.
LONG = ("111111", "1110111", "110110011", "1011001011", "110101011")
SHORT = ("11111", "101111", "110111", "111011", "111101")
FIVE = ("1111", "10111", "11011", "11101")
WHOLE = ("1", "11", "111", "1111")
MASKS = LONG + SHORT + FIVE + WHOLE
#: Shortest accepted overlap in words (or the whole passage where it is shorter) and its largest share of replaced words.
OVERLAP_WORDS = 13
REPLACED_SHARE = 0.2
#: Words of a document that make one block on their way to the passages that they are compared with.
BLOCK_WORDS = 1 << 10
#: Least and most bits of the index of the filter that tasks ask before they give out a window: 1 to 4 MB. Benchmarks of
#: more than a million seeds make it let more windows through, which the join then drops. The same for texts with a hit.
FILTER_BITS = (23, 25)
TEXT_BITS = (20, 27)


def _positions(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


def _seeds(hashes: np.ndarray, mask: int) -> np.ndarray:
    return textkernel.combine(hashes, _positions(MASKS[mask]), salt=mask + 1)


def masks_of(n_words: int) -> range:
    """The masks that a passage of so many words is searched by."""
    long, short, five = len(LONG), len(LONG) + len(SHORT), len(LONG) + len(SHORT) + len(FIVE)
    if n_words > 5:
        return range(long if n_words >= OVERLAP_WORDS else short)
    return range(short, five) if n_words == 5 else range(five + n_words - 1, five + n_words)


def passage_seeds(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, key, words, mask, seed, place) with one row for each window and mask.

    key is a 64-bit hash of the passage's words: rows that share an id, or have
    none, keep keys of their own. words, the hashes of the passage, stand on its
    first row only.
    """
    rows = items.select(F.col(id_col).alias("item_id"), F.lower(text_or_empty(text_col)).alias("text"))
    kind = rows.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in textkernel.chunks(batch.column(1)):
                hashes, firsts = textkernel.word_hashes(data, offsets, textkernel.ALNUM)
                names = batch.column(0).slice(lo, hi - lo)
                for row in range(hi - lo):
                    words = hashes[firsts[row] : firsts[row + 1]]
                    if not len(words):
                        continue
                    used = masks_of(len(words))
                    found = [_seeds(words, m) for m in used]
                    seeds = np.concatenate(found)
                    places = np.concatenate([np.arange(len(f)) for f in found])
                    masks = np.repeat(np.array(used, np.int32), [len(f) for f in found])
                    n = len(seeds)
                    same = pa.array(np.zeros(n, np.int32))
                    key = textkernel.combine(words, list(range(len(words))), salt=len(words)).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [names.slice(row, 1).take(same), pa.array(key).take(same), pa.array([words.view(np.int64)] + [None] * (n - 1), pa.list_(pa.int64())), pa.array(masks), pa.array(seeds.view(np.int64)), pa.array(places.astype(np.int32))],
                        names=["item_id", "key", "words", "mask", "seed", "place"],
                    )

    return rows.mapInArrow(run, f"item_id {kind}, key long, words array<bigint>, mask int, seed long, place int")


def _filter(seeds: DataFrame, bits: tuple[int, int] = FILTER_BITS) -> tuple[np.ndarray, int]:
    """A bitmap of which every value in the column `seed` sets two bits, and the bits of its index; what comes to the driver is bounded by its size."""
    width = min(max(bits[0], math.ceil(math.log2(max(32 * seeds.count(), 1)))), bits[1])
    first = F.shiftrightunsigned("seed", 64 - width)
    second = F.col("seed").bitwiseAND(F.lit((1 << width) - 1))
    slots = seeds.select(F.explode(F.array(first.cast("int"), second.cast("int"))).alias("slot")).distinct().toArrow()["slot"].to_numpy()
    table = np.zeros(1 << width, bool)
    table[slots] = True
    return np.packbits(table, bitorder="little"), width


def _ask(table: np.ndarray, width: int, seeds: np.ndarray) -> np.ndarray:
    """Places of the 64-bit values of which both bits are set."""
    bit = lambda slots: ((table[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1).astype(bool)
    at = np.flatnonzero(bit((seeds >> np.uint64(64 - width)).astype(np.int64)))
    return at[bit((seeds[at] & np.uint64((1 << width) - 1)).astype(np.int64))]


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, a, b, text): the text in lower case and 128 bits that name it, so that copies are searched as one text."""
    rows = docs.select(F.col(id_col).alias("id"), F.lower(text_or_empty(text_col)).alias("text"))
    return rows.select("id", F.xxhash64(F.lit(1), "text").alias("a"), F.xxhash64(F.lit(2), "text").alias("b"), "text")


def _hits(named: DataFrame, bitmap: tuple[np.ndarray, int], masks: list[int]) -> DataFrame:
    """(a, b, seed, at): windows of texts that the filter lets through."""
    bits, width = bitmap
    shared = named.sparkSession.sparkContext.broadcast(bits)
    whole = len(MASKS) - len(WHOLE)
    spans = np.array([len(m) for m in MASKS])

    def hits(hashes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and seeds of windows inside one document that pass; of a passage that is one window, its first place."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
        for m in masks:
            seeds = _seeds(hashes, m)
            at = _ask(shared.value, width, seeds)
            at = at[at + spans[m] <= ends[at]]
            if m >= whole and len(at):
                order = np.lexsort((at, seeds[at], ends[at]))
                by = at[order]
                at = by[np.concatenate(([True], (seeds[by[1:]] != seeds[by[:-1]]) | (ends[by[1:]] != ends[by[:-1]])))]
            found.append((at, seeds[at]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(i).to_numpy() for i in range(2))
            for lo, _, data, offsets in textkernel.chunks(batch.column(2)):
                hashes, firsts = textkernel.word_hashes(data, offsets, textkernel.ALNUM)
                at, seeds = hits(hashes, np.repeat(firsts[1:], np.diff(firsts)))
                row = np.searchsorted(firsts, at, side="right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(a[lo + row]), pa.array(b[lo + row]), pa.array(seeds.view(np.int64)), pa.array(at - firsts[row], pa.int64())], names=["a", "b", "seed", "at"])

    return named.select("a", "b", "text").mapInArrow(run, "a long, b long, seed long, at long")


def _blocks(named: DataFrame, bitmap: tuple[np.ndarray, int]) -> DataFrame:
    """Of the texts that the filter lets through: a row (id, a, b, null, null) for each document, and (null, a, b, block, words) for each stretch of BLOCK_WORDS words."""
    bits, width = bitmap
    shared = named.sparkSession.sparkContext.broadcast(bits)
    block_words = BLOCK_WORDS
    kind = named.schema["id"].dataType.simpleString()
    fields = ["id", "a", "b", "block", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _ask(shared.value, width, batch.column(1).to_numpy().view(np.uint64))
            batch = batch.take(pa.array(at))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64()))], names=fields)
            a, b = (batch.column(i).to_numpy() for i in (1, 2))
            _, one = np.unique(np.stack([a, b]), axis=1, return_index=True)
            batch, a, b = batch.take(pa.array(np.sort(one))), a[np.sort(one)], b[np.sort(one)]
            for lo, hi, data, offsets in textkernel.chunks(batch.column(3)):
                hashes, firsts = textkernel.word_hashes(data, offsets, textkernel.ALNUM)
                many = -(-np.diff(firsts) // block_words)
                row = np.repeat(np.arange(hi - lo), many)
                block = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                stops = np.append(firsts[row] + block * block_words, len(hashes)).astype(np.int32)
                words = pa.ListArray.from_arrays(pa.array(stops), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.nulls(len(row), batch.column(0).type), pa.array(a[lo + row]), pa.array(b[lo + row]), pa.array(block, pa.int64()), words], names=fields)

    return named.mapInArrow(run, f"id {kind}, a long, b long, block long, words array<bigint>")


def longest(same: np.ndarray, least: int, replaced: float = REPLACED_SHARE) -> tuple[int, int, int] | None:
    """(first, words, agreeing words) of the longest stretch of at least so many words of which at most such a share disagrees; the first of equally long ones."""
    if len(same) < least:
        return None
    share = round(replaced * 1_000_000)
    sums = np.zeros(len(same) + 1, np.int64)
    np.cumsum(np.where(same, share, share - 1_000_000), out=sums[1:])
    # A stretch is good if the sum doesn't fall over it: for each end, the first place whose sum is no higher.
    begins = np.searchsorted(-np.minimum.accumulate(sums), -sums, side="left")
    lengths = np.arange(len(sums)) - begins
    end = int(np.argmax(lengths))
    if lengths[end] < least:
        return None
    begin = int(begins[end])
    return begin, end - begin, int(same[begin:end].sum())


def overlap(doc: np.ndarray, item: np.ndarray, shift: int, least: int = OVERLAP_WORDS, replaced: float = REPLACED_SHARE) -> tuple[int, int, int] | None:
    """(first item word, words, agreeing words) of the longest accepted overlap with item word j beside doc word j + shift."""
    lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
    found = longest(doc[lo + shift : hi + shift] == item[lo:hi], max(1, min(least, len(item))), replaced) if hi > lo else None
    return found and (lo + found[0], *found[1:])


def _agreement(beside: DataFrame) -> DataFrame:
    """Each block of a text beside a passage -> the passage's first word there, how many words stand beside it and, as bits, which agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, items = batch.column(5), batch.column(6)
            shift, begin = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            firsts, sizes, bits = [], [], []
            for i in range(batch.num_rows):
                doc, item = words[i].values.to_numpy(), items[i].values.to_numpy()
                at = int(begin[i] - shift[i])  # the passage's word beside the block's first
                lo, hi = max(0, at), min(len(item), at + len(doc))
                same = doc[lo - at : hi - at] == item[lo:hi]
                firsts.append(lo)
                sizes.append(max(0, hi - lo))
                bits.append(np.packbits(same).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(firsts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary())], names=["a", "b", "key", "shift", "first", "size", "bits"])

    return beside.mapInArrow(run, "a long, b long, key long, shift long, first long, size long, bits binary")


def _longest_of(lines: DataFrame) -> DataFrame:
    """Each text, passage and shift with the passage's length and all its bits -> its longest accepted overlap, if there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, found = [], []
            for i, (shift, n, parts) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                same = np.concatenate([np.unpackbits(np.frombuffer(p["bits"], np.uint8), count=p["size"]) for p in parts])
                best = longest(same.astype(bool), min(OVERLAP_WORDS, n))
                if best:
                    kept.append(i)
                    found.append((parts[0]["first"] + best[0] + shift, best[1], best[2]))
            columns = list(zip(*found, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(kept, pa.int64())) for i in range(3)), *(pa.array(c, pa.int64()) for c in columns)], names=["a", "b", "key", "first_word", "n_words", "matched"])

    return lines.mapInArrow(run, "a long, b long, key long, first_word long, n_words long, matched long")


def contaminations(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item_id, first_word, n_words, matched): the longest overlap of each document and passage that share one.

    An overlap is a stretch of at least OVERLAP_WORDS words of the passage (all
    where it has fewer) beside as many of the document, of which at most
    REPLACED_SHARE differ; words are compared in lower case. Of equally long
    ones the first in the document counts, then that with more agreeing words.
    Null and empty texts overlap with nothing; a passage of a few words is
    searched as any other, so very short ones are better left out of the
    benchmark. Rows with one id count as one document. first_word counts the
    document's words from 0. Passages that share an item_id, null included, are
    searched each by itself; the longest of their overlaps stands for the id.

    Texts are read twice: for windows that hit a seed, and, where one did, for
    the words beside the passage's, block by block: each hit's shift is compared
    over the whole passage, however long, and rows hold one block or passage.
    """
    spark = docs.sparkSession
    ship(spark)
    space = Workspace(spark)
    named = _named(docs, id_col, text_col)
    passages = space.write(passage_seeds(items, item_id_col, item_text_col), "passages")
    masks = sorted(row["mask"] for row in passages.select("mask").distinct().collect())  # those of MASKS at most
    seeds = passages.select("key", "seed", "place").distinct()
    # A seed, or a passage, may be found in very many places: those are dealt over parts that each get the benchmark's few rows.
    hits = _hits(named, _filter(passages), masks).distinct()
    lines = dealt(hits, "a", "at").join(for_each_part(seeds), ["seed", "_part"]).select("a", "b", "key", (F.col("at") - F.col("place")).alias("shift")).distinct()
    lines = space.write(lines, "lines")
    texts = space.write(_blocks(named, _filter(lines.select(F.col("a").alias("seed")).distinct(), TEXT_BITS)), "texts")
    whole = passages.where("words IS NOT NULL")
    words = whole.groupBy("key").agg(F.first("words").alias("item"))  # one key, one array
    lengths = words.select("key", F.size("item").cast("long").alias("n"))
    size = F.lit(BLOCK_WORDS)
    ranged = F.sequence(F.floor(F.greatest("shift", F.lit(0)) / size), F.floor((F.col("shift") + F.col("n") - 1) / size))
    # Passages have one row each. Where Spark doesn't send them to all executors it splits those that are found in very many texts.
    pieces = lines.join(lengths, "key").select("a", "b", "key", "shift", F.explode(ranged).alias("block"))
    blocks = texts.where("block IS NOT NULL").groupBy("a", "b", "block").agg(F.first("words").alias("words"))
    beside = pieces.join(blocks.hint("merge"), ["a", "b", "block"]).join(words, "key")
    agreed = _agreement(beside.select("a", "b", "key", "shift", (F.col("block") * size).alias("begin"), "words", "item")).where("size > 0")
    # One row for each block of a passage's length.
    agreed = agreed.groupBy("a", "b", "key", "shift").agg(F.array_sort(F.collect_list(F.struct("first", "size", "bits"))).alias("parts"))
    agreed = agreed.join(lengths, "key").select("a", "b", "key", "shift", "n", "parts")
    best = F.max(F.struct("n_words", (-F.col("first_word")).alias("at"), "matched")).alias("best")
    columns = [(-F.col("best.at")).alias("first_word"), "best.n_words", "best.matched"]
    checked = _longest_of(agreed).groupBy("a", "b", "key").agg(best).select("a", "b", "key", *columns)
    checked = checked.join(whole.select("key", "item_id").distinct(), "key")
    checked = checked.groupBy("a", "b", "item_id").agg(best).select("a", "b", "item_id", *columns)
    rows = meet(texts.where("block IS NULL").select("id", "a", "b"), checked, ["a", "b"], ["id"])
    return rows.groupBy("id", "item_id").agg(best).select(F.col("id").alias(id_col), "item_id", *columns)


def decontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without those that overlap with a passage; each row is judged by its own text, whatever its id, and keeps its columns."""
    # Rows of one id and text are alike; a row without an id is told by its text.
    row = F.concat_ws(":", F.col(id_col).cast("string"), F.hex(F.xxhash64(text_col)))
    leaks = contaminations(docs.select(row.alias("row"), F.col(text_col).alias("text")), items, "row", **options).select("row").distinct()
    named = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), row.alias("row"))
    return named.join(leaks, "row", "left_anti").select("doc.*")
