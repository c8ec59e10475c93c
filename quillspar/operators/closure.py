"""Reverse closures over an edge table: who reaches a set of seeds, how deep and by which path.

One job is one hop: the rows that the last hop reached meet the edges, and what
was reached before is taken off. A hop's rows are written below one folder, by
depth, so that the next reads all that was reached as one table and the last
hop's as one partition; a plan never grows with depth and a cycle ends by
itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from quillspar.operators.order import numbered
from quillspar.session import Workspace

MAX_DEPTH = 25
#: Seeds that share a row, one bit each.
BITS = 62


def _hops(space: Workspace, start: DataFrame, hop, max_depth: int | None) -> tuple[DataFrame, int]:
    """(all rows with their depth, the deepest depth that has any): start at depth 0, then hop(the last rows, all rows) until it gives none.

    One hop beyond the bound is taken, for it shows whether the bound cuts anything off.
    """
    folder, depth = space.place("reached"), 0
    rows, fields = start, StructType([*start.schema.fields, StructField("depth", IntegerType())])
    while True:
        counts = Observation()
        rows.observe(counts, F.count(F.lit(1)).alias("n")).write.parquet(f"{folder}/depth={depth}")
        reached = space.spark.read.schema(fields).parquet(folder)
        if not counts.get["n"]:
            return reached, depth - 1
        if max_depth is not None and depth > max_depth:
            return reached, depth
        rows, depth = hop(reached.where(F.col("depth") == depth).drop("depth"), reached.drop("depth")).select(*start.columns), depth + 1


def distinct_edges(edges: DataFrame, source: str, target: str, confirmed: str | None = None) -> DataFrame:
    """(_from, _to, _sure): each edge once, confirmed if any of its rows is; nulls are no ends."""
    sure = F.col(confirmed) if confirmed else F.lit(True)
    rows = edges.select(F.col(source).alias("_from"), F.col(target).alias("_to"), sure.alias("_sure")).where("_from IS NOT NULL AND _to IS NOT NULL")
    return rows.groupBy("_from", "_to").agg(F.bool_or("_sure").alias("_sure"))


def reach(edges: DataFrame, seeds: DataFrame, source: str = "source", target: str = "target", confirmed: str | None = None, seed: str = "seed", node: str = "node", max_depth: int | None = MAX_DEPTH) -> tuple[DataFrame, DataFrame]:
    """(seed, node, depth, sure_depth) of all nodes that reach a seed's nodes (depth 0), for all seeds at once; and (seed) of those that the bound cut off.

    seeds has (seed, node). An edge's source depends on its target. depth is the
    fewest edges, sure_depth the fewest of confirmed ones (null where those
    alone don't reach). BITS seeds share a row: a hop ORs the bits of the
    targets that the last one reached, over all edges and over confirmed ones,
    and takes off the bits that are set already, in one aggregation.
    """
    space = Workspace(edges.sparkSession)
    kept = space.write(distinct_edges(edges, source, target, confirmed), "edges")
    pairs = space.write(seeds.select(F.col(seed).alias("_seed"), F.col(node).alias("_node")).where("_seed IS NOT NULL AND _node IS NOT NULL").distinct(), "pairs")
    names = space.write(numbered(pairs.select("_seed").distinct(), ["_seed"], "_n", 0).select("_seed", F.expr(f"_n div {BITS}").alias("_block"), (F.col("_n") % BITS).cast("int").alias("_bit")), "names")
    bit = F.expr("shiftleft(1L, _bit)")
    start = pairs.join(names, "_seed").groupBy("_block", "_node").agg(F.bit_or(bit).alias("_all"))
    start = start.select("_block", "_node", "_all", F.col("_all").alias("_sure"))

    def hop(last: DataFrame, reached: DataFrame) -> DataFrame:
        none = F.lit(0).cast("long")
        met = last.withColumnRenamed("_sure", "_last_sure").join(kept, F.col("_node") == F.col("_to"))
        new = met.select("_block", F.col("_from").alias("_node"), "_all", F.when(F.col("_sure"), F.col("_last_sure")).otherwise(none).alias("_sure"), none.alias("_had"), none.alias("_had_sure"))
        old = reached.select("_block", "_node", none.alias("_all"), none.alias("_sure"), F.col("_all").alias("_had"), F.col("_sure").alias("_had_sure"))
        every = new.unionByName(old).groupBy("_block", "_node").agg(*[F.bit_or(c).alias(c) for c in ("_all", "_sure", "_had", "_had_sure")])
        fresh = every.select("_block", "_node", F.col("_all").bitwiseAND(F.bitwise_not("_had")).alias("_all"), F.col("_sure").bitwiseAND(F.bitwise_not("_had_sure")).alias("_sure"))
        return fresh.where("_all <> 0 OR _sure <> 0")

    reached, deepest = _hops(space, start, hop, max_depth)
    bits = reached.join(names, "_block").where(F.col("_all").bitwiseOR(F.col("_sure")).bitwiseAND(bit) != 0)
    depth = lambda mask: F.min(F.when(F.col(mask).bitwiseAND(bit) != 0, F.col("depth")))
    found = bits.groupBy(F.col("_seed").alias(seed), F.col("_node").alias(node)).agg(depth("_all").alias("depth"), depth("_sure").alias("sure_depth"))
    if max_depth is None or deepest <= max_depth:
        return found, names.select(F.col("_seed").alias(seed)).limit(0)
    over = F.col("depth") > max_depth
    # What confirmed edges reach beyond the bound, all edges may reach within it.
    kept_rows = found.where(~over).withColumn("sure_depth", F.when(F.col("sure_depth") <= max_depth, F.col("sure_depth")))
    return kept_rows, found.where(over).select(seed).distinct()


def reverse_closure(edges: DataFrame, seeds: DataFrame, source: str = "source", target: str = "target", node: str = "node", max_depth: int | None = MAX_DEPTH, paths: bool = False) -> tuple[DataFrame, bool]:
    """(node, depth[, path]) of all that reach a seed (depth 0) over at most max_depth edges, and whether that cut anything off.

    An edge's source depends on its target. Depth is the fewest edges. A path
    lists the nodes from the seed outwards; of equally short ones it is the one
    that a queue finds which starts with the seeds and takes each node's
    sources in their order.
    """
    rows, capped = _closure(edges, seeds, source, target, None, node, max_depth, paths)
    return rows.drop("confirmed"), capped


def two_tier_closure(edges: DataFrame, seeds: DataFrame, confirmed: str, source: str = "source", target: str = "target", node: str = "node", max_depth: int | None = MAX_DEPTH, paths: bool = False) -> tuple[DataFrame, bool]:
    """Closure over all edges, where what confirmed edges alone reach has its depth (and path) from those, and confirmed true; both at once."""
    return _closure(edges, seeds, source, target, confirmed, node, max_depth, paths)


def _closure(edges: DataFrame, seeds: DataFrame, source: str, target: str, confirmed: str | None, node: str, max_depth: int | None, paths: bool) -> tuple[DataFrame, bool]:
    """Rows of a hop say whether confirmed edges alone led there (`sure`); a node may have one of either kind.

    The order of a queue is that of its paths: seeds by name, and behind each
    node its sources by name. So the smallest path, compared node by node from
    the seed on, is the one that the queue finds first.
    """
    space = Workspace(edges.sparkSession)
    kept = space.write(distinct_edges(edges, source, target, confirmed), "edges")
    start = seeds.select(F.col(seeds.columns[0]).alias("_node")).where("_node IS NOT NULL").distinct()
    tiers = F.explode(F.array(F.lit(False), F.lit(True))) if confirmed else F.lit(False)
    start = start.select("_node", tiers.alias("_tier"), *([F.array("_node").alias("_path")] if paths else []))

    def hop(last: DataFrame, reached: DataFrame) -> DataFrame:
        met = last.join(kept, (F.col("_node") == F.col("_to")) & (~F.col("_tier") | F.col("_sure"))).groupBy("_from", "_tier")
        new = met.agg(F.min("_path").alias("_path")).withColumn("_path", F.concat("_path", F.array("_from"))) if paths else met.agg(F.count("*").alias("_n")).drop("_n")
        return new.withColumnRenamed("_from", "_node").join(reached.select("_node", "_tier"), ["_node", "_tier"], "left_anti")

    reached, deepest = _hops(space, start, hop, max_depth)
    capped = False
    if max_depth is not None and deepest > max_depth:
        capped = not reached.where((F.col("depth") > max_depth) & ~F.col("_tier")).isEmpty()
        reached = reached.where(F.col("depth") <= max_depth)
    rest = ["depth", *(["path"] if paths else [])]
    rows = reached.withColumnRenamed("_path", "path") if paths else reached
    if not confirmed:
        return rows.select(F.col("_node").alias(node), *rest, F.lit(True).alias("confirmed")), capped
    best = rows.groupBy("_node").agg(F.max_by(F.struct(*rest), "_tier").alias("_best"), F.bool_or("_tier").alias("confirmed"))
    return best.select(F.col("_node").alias(node), "_best.*", "confirmed"), capped


def induced(edges: DataFrame, nodes: DataFrame, source: str = "source", target: str = "target", node: str = "node") -> DataFrame:
    """The edges of which both ends are among the nodes."""
    ends = nodes.select(node).distinct()
    return edges.join(ends, edges[source] == ends[node], "left_semi").join(ends, edges[target] == ends[node], "left_semi")
