"""Shards that all match the mixture of sources: proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspar.llm.tables import before_range, hash_range
from quillspar.operators.order import numbered
from quillspar.session import Workspace


def interleaved_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17) -> DataFrame:
    """Per row: id, source, size, text_crc32, law, shard, slot, grown_shard.

    Within each source, rows are ranked in a seeded random order; rank r of n
    gives the fraction (r - 1/2) / n. Rows are put in the order of that
    fraction and the order is cut into `shards` runs whose lengths differ by
    one at most (law `rows`), so that each run holds its share of every
    source. slot counts from 0 in each shard; grown_shard is null, for another
    shard would move rows between all.

    Ranks are exact without bringing a source together: a row's rank is the
    number of rows in its source's lower hash ranges plus its rank in its own.

    A null text has 0 bytes and the checksum of the empty text; null sources
    are a source of their own; null ids are ordered first. Repeated rows are
    ranked one after the other. Fewer rows than shards leave shards empty.
    """
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
    ).withColumn("key", F.xxhash64(F.lit(seed), "id"))
    space = Workspace(docs.sparkSession)
    rows = space.write(rows, "rows")  # a few numbers a row; texts are read once
    total = rows.count()
    rows = rows.withColumn("bucket", hash_range("key", total))

    same_source = F.col("r.source").eqNullSafe(F.col("c.source"))
    counts = rows.groupBy("source", "bucket").agg(F.count("*").alias("n"))
    totals = counts.groupBy("source").agg(F.sum("n").alias("total")).alias("t")
    counts = before_range(counts, ["source"], "bucket", "n", "before").alias("b").join(totals, F.col("b.source").eqNullSafe(F.col("t.source"))).select("b.source", "bucket", "before", "total").hint("merge")
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy("source", "bucket").orderBy("key", "id", "text_crc32", "size")))
    ranked = ranked.alias("r").join(counts.alias("c"), same_source & (F.col("r.bucket") == F.col("c.bucket")))
    rank = F.col("before") + F.col("place")
    ranked = ranked.select("id", "r.source", "size", "text_crc32", "key", ((2 * rank - 1) / (2 * F.col("total"))).alias("fraction"))

    # The place in the whole order, by ranges of all its columns: sources of one row all have the fraction 1/2.
    total = max(total, 1)
    placed = numbered(ranked, [F.col("fraction"), F.col("source").asc_nulls_last(), F.col("key"), F.col("id"), F.col("text_crc32"), F.col("size")], "at", start=0)
    shard = F.expr(f"at * {shards} div {total}")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return (
        placed.withColumn("shard", shard.cast("int"))
        .select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("at") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
