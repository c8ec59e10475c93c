"""Token-ID output: documents in ascending id order, as wavelet-matrix shards on shared files."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspar.llm import wavelet
from quillspar.llm.tables import text_or_empty
from quillspar.llm.tokens import encoder
from quillspar.session import Workspace, ship

#: A shard is closed at the first document that brings it to so many ids.
SHARD_IDS = 1 << 20


def _with_ends(ids: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with one end id after each document's, and the sizes with it."""
    sizes = sizes + 1
    stops = np.cumsum(sizes) - 1
    out = np.full(len(ids) + len(sizes), end, np.uint32)
    own = np.ones(len(out), bool)
    own[stops] = False
    out[own] = ids
    return out, sizes


def write_tokens(docs: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text_col: str = "text", end: int = 0, shard_ids: int = SHARD_IDS) -> None:
    """Encodes all texts and writes shards to path, one shard in each file.

    Rows are dealt out in ranges of the id, so that shards follow each other in
    ascending id order (nulls first; equal ids stay together in any order).
    A shard row holds its place (part, shard), the ids and sizes of its
    documents and the wavelet matrix of their token ids, `end` after each
    document's. A null or empty text has the end id only. No document is
    split, so a shard has at most shard_ids ids besides its last document's.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).repartitionByRange("id").sortWithinPartitions("id")
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, shard = encoder(tokenizer, "ids"), TaskContext.get().partitionId(), 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        full = 0

        def close() -> pa.RecordBatch:
            names = pa.concat_arrays([h[0] for h in held])
            ids, sizes = (np.concatenate([h[i] for h in held]) for i in (1, 2))
            offsets = pa.array([0, len(names)], pa.int32())
            columns = [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([len(ids)], pa.int64()), pa.ListArray.from_arrays(offsets, names), pa.ListArray.from_arrays(offsets, pa.array(sizes)), pa.array([wavelet.build(ids)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["part", "shard", "n_ids", "ids", "sizes", "matrix"])

        for batch in batches:
            row = 0
            for ids, sizes in encode.ids(batch.column(1)):
                ids, sizes = _with_ends(ids, sizes, end)
                stops = np.cumsum(sizes)
                lo = 0
                while lo < len(sizes):
                    begin = int(stops[lo - 1]) if lo else 0
                    hi = min(len(sizes), int(np.searchsorted(stops, begin + shard_ids - full)) + 1)
                    held.append((batch.column(0).slice(row + lo, hi - lo), ids[begin : int(stops[hi - 1])], sizes[lo:hi]))
                    full += int(stops[hi - 1]) - begin
                    if full >= shard_ids:
                        yield close()
                        held, full, shard = [], 0, shard + 1
                    lo = hi
                row += len(sizes)
        if held:
            yield close()

    schema = f"part int, shard int, n_ids long, ids array<{kind}>, sizes array<bigint>, matrix binary"
    rows.mapInArrow(run, schema).write.option("maxRecordsPerFile", 1).option("compression", "uncompressed").parquet(path)


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Per document, from the files: id, start (ids of all documents before it), n_tokens, ids_crc32 (of its ids as little-endian 32-bit integers)."""
    ship(spark)
    shards = spark.read.parquet(path)
    sizes = shards.select("part", "shard", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    parts = parts.select("part", F.coalesce(F.sum("part_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_start"))
    inner = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("inner_start", F.coalesce(F.sum("n_ids").over(inner), F.lit(0))).join(parts, "part").select("part", "shard", (F.col("part_start") + F.col("inner_start")).alias("shard_start"))
    kind = shards.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = wavelet.WaveletMatrix(batch.column(4)[i].as_buffer().to_pybytes()).ids().astype("<u4")
                lengths = batch.column(3)[i].values.to_numpy()
                stops = np.cumsum(lengths)
                checks = [zlib.crc32(ids[hi - n : hi]) for n, hi in zip(lengths.tolist(), stops.tolist(), strict=True)]
                same = pa.array(np.zeros(len(lengths), np.int32))
                columns = [batch.column(0).slice(i, 1).take(same), batch.column(1).slice(i, 1).take(same), batch.column(2)[i].values, pa.array(stops - lengths), pa.array(lengths), pa.array(checks, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "shard", "id", "offset", "n_tokens", "ids_crc32"])

    schema = f"part int, shard int, id {kind}, offset long, n_tokens long, ids_crc32 long"
    found = shards.select("part", "shard", "ids", "sizes", "matrix").mapInArrow(run, schema).join(starts, ["part", "shard"])
    return found.select(F.col("id").alias(id_col), (F.col("shard_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def token_digest(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end: int = 0, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Writes the shards under spark.checkpoint.dir and reads the digest of each document back from them."""
    path = Workspace(docs.sparkSession).place("tokens")
    write_tokens(docs, tokenizer, path, id_col, text_col, end, shard_ids)
    return read_tokens(docs.sparkSession, path, id_col)


def find_token(spark: SparkSession, path: str, token: int) -> DataFrame:
    """(part, shard, n, places): how often an id stands in each shard and where, without decoding the shards."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [wavelet.WaveletMatrix(m.as_buffer().to_pybytes()).occurrences(token) for m in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(f) for f in found], pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["part", "shard", "n", "places"])

    return spark.read.parquet(path).select("part", "shard", "matrix").mapInArrow(run, "part int, shard int, n long, places array<bigint>").where("n > 0")
