import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillspar.operators import aggregates, closure, matching
from quillspar.operators.order import labelled, numbered, truncated
from quillspar.streaming.limits import limited


def test_first_glob_in_order_wins(spark):
    rules = spark.createDataFrame([(0, "Des-EDE3*", "3DES"), (1, "des*", "DES"), (2, "*gcm", "AES"), (3, "", "none"), (4, "a * b", "mid")], "ord int, pattern string, algorithm string")
    values = ["des-ede3-cbc", "DES cbc", "aes-GCM", "", "x", "a*b"]
    df = spark.createDataFrame(list(enumerate(values)), "k int, v string")
    got = {r["v"]: r["algorithm"] for r in matching.first_glob(df, "v", ["k"], rules).collect()}
    assert got == {"des-ede3-cbc": "3DES", "DES cbc": "DES", "aes-GCM": "AES", "": "none", "a*b": "mid"}


def test_longest_prefix(spark):
    roots = spark.createDataFrame([(0, "", "all"), (1, "src", "code"), (2, "src/legacy", "old"), (3, "src", "late")], "ord int, root string, service string")
    df = spark.createDataFrame([("src/a.py",), ("src/legacy/b.py",), ("srcs/c.py",), ("d.py",)], "path string")
    got = {r["path"]: r["service"] for r in matching.longest_prefix(df, "path", roots, "root", ["service"]).collect()}
    assert got == {"src/a.py": "code", "src/legacy/b.py": "old", "srcs/c.py": "all", "d.py": "all"}


def test_suffix_resolution(spark):
    files = spark.createDataFrame([("a/b/c",), ("x/b/c",), ("a/d",)], "path string")
    asked = spark.createDataFrame([(1, "b/c"), (2, "a/d"), (3, "c/d"), (4, "a/b/c")], "k int, wanted string")
    got = {r["k"]: (r["n_targets"], r["resolution"]) for r in matching.by_suffix(asked, "wanted", ["k"], files, "path").collect()}
    assert got == {1: (2, "ambiguous"), 2: (1, "resolved"), 3: (0, "unresolved"), 4: (1, "resolved")}


def test_numbers_follow_the_order(spark):
    df = spark.range(0, 5000, numPartitions=7).withColumn("k", F.xxhash64("id"))
    rows = sorted(numbered(df, [F.col("k")]).collect(), key=lambda r: r["k"])
    assert [r["rank"] for r in rows] == list(range(1, 5001))
    ids = [r["id2"] for r in labelled(df.where("id < 1002"), [F.col("id")], name="id2").orderBy("id").collect()]
    assert ids[0] == "CRYPTO-001" and ids[1001] == "CRYPTO-1002"


def test_truncation_tells(spark):
    assert [r["truncated"] for r in truncated(spark.range(3), [F.col("id")], 3).collect()] == [False] * 3
    assert [r["truncated"] for r in truncated(spark.range(4), [F.col("id")], 3).collect()] == [True] * 3


def test_closed_histogram_has_zeroes(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "band string")
    assert {r["band"]: r["n"] for r in aggregates.closed_histogram(df, "band", ["a", "b"]).collect()} == {"a": 2, "b": 0}


def test_mode_takes_the_first_seen(spark):
    df = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, "b", 3), (1, "a", 4)], "g int, v string, at int")
    assert [(r["v"], r["n"]) for r in aggregates.first_seen_mode(df, ["g"], "v", "at").collect()] == [("b", 2)]


def test_merged_edges(spark):
    rows = [("a", "b", False, "guess", 1, "f", 9), ("a", "b", True, "sure", 2, "f", 3), ("a", "b", True, "later", 3, "f", 3)] + [("a", "b", False, "x", 10 + i, "g", i) for i in range(9)]
    df = spark.createDataFrame(rows, "s string, t string, confirmed boolean, basis string, at int, file string, line int")
    (r,) = aggregates.merged_edges(df, ["s", "t"], "confirmed", "basis", "at", ["file", "line"]).collect()
    assert r["confirmed"] and r["basis"] == "sure" and r["evidence_count"] == 12
    assert [(e["file"], e["line"]) for e in r["evidence"]] == [("f", 3), ("f", 9), ("g", 0), ("g", 1), ("g", 2)]


def test_accuracy_of_nothing_is_one(spark):
    df = spark.createDataFrame([(False, False, "x")], "e boolean, f boolean, kind string")
    assert all((r["precision"], r["recall"], r["f1"]) == (1, 1, 1) for r in aggregates.accuracy(df, F.col("e"), F.col("f"), "kind").collect())


@pytest.fixture(scope="module")
def chain(spark):
    return spark.range(1, 40).select((F.col("id") + 1).alias("source"), F.col("id").alias("target"), (F.col("id") % 2 == 1).alias("sure"))


def test_chain_is_cut_at_the_depth(spark, chain):
    seeds = spark.createDataFrame([(1,)], "k long")
    reached, capped = closure.reverse_closure(chain, seeds, paths=True)
    rows = {r["node"]: r for r in reached.collect()}
    assert capped and len(rows) == 26 and rows[26]["depth"] == 25 and rows[4]["path"] == [1, 2, 3, 4]
    reached, capped = closure.reverse_closure(chain, seeds, max_depth=None)
    assert not capped and reached.count() == 40


def test_cycles_diamonds_and_tiers(spark):
    edges = spark.createDataFrame([("b", "a", True), ("c", "a", False), ("d", "b", False), ("d", "c", True), ("a", "d", True), ("c", "b", True), ("x", "y", True)], "source string, target string, sure boolean")
    seeds = spark.createDataFrame([("a",)], "k string")
    both, _ = closure.two_tier_closure(edges, seeds, "sure", paths=True)
    got = {r["node"]: (r["depth"], r["confirmed"], r["path"]) for r in both.collect()}
    assert got == {"a": (0, True, ["a"]), "b": (1, True, ["a", "b"]), "c": (2, True, ["a", "b", "c"]), "d": (3, True, ["a", "b", "c", "d"])}
    assert {(r["source"], r["target"]) for r in closure.induced(edges, both).collect()} == {("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("a", "d"), ("c", "b")}


def test_limits_carry_over_batches(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice([1, 1, 1, 2, None]), i, None if i % 50 == 0 else datetime(2024, 1, 1) + timedelta(seconds=rnd.randrange(4_000))) for i in range(600)]
    events = spark.createDataFrame(rows, "user long, event long, at timestamp")
    wanted, recent = {}, {}
    for user, event, at in sorted(rows, key=lambda r: (r[2] is None, r[2] or datetime.min, r[1])):
        kept = [] if at is None else [r for r in recent.get(user, []) if r > at - timedelta(seconds=60)]
        wanted[event] = at is None or len(kept) < 2
        if at is not None:
            recent[user] = kept + [at] * wanted[event]
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = limited(events, "user", "at", "event", 2, 60)
        assert {r["event"]: r["admitted"] for r in found.collect()} == wanted and found.columns == ["user", "event", "at", "admitted"]
        assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString()  # no frame of a whole key
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
