"""Ledgers, selections under a budget, unions in order, messages, and closures of many seeds, against plain versions."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from quillspar.operators import aggregates, closure, matching, order
from quillspar.plans import coverage, graph
from quillspar.sources import ledger

LEDGER = "scan_id string, id string, reason string, author string, at timestamp, cleared boolean"


def at(minute):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)


def rows_of(spark, path):
    return sorted(tuple(r) for r in ledger.current(spark, path, spark.createDataFrame([], LEDGER).schema).collect())


def test_ledger_keeps_the_last_writer(spark, tmp_path):
    path, put = (tmp_path / "l").as_uri(), lambda *rows: ledger.upsert(spark.createDataFrame(list(rows), LEDGER), path)
    assert rows_of(spark, path) == []
    put(("a", "1", "test code", "kim", at(1), None), ("a", "2", "vendor", "kim", at(1), False), ("b", "1", "old", "lee", at(1), False), (None, "9", "x", "x", at(1), False), ("a", None, "x", "x", at(1), False))
    put(("a", "1", "really", "ray", at(5), False), ("a", "1", "late", "lou", at(3), False), ("a", "2", None, "ray", at(4), True), ("a", "2", "late", "lou", at(2), False))
    want = [("a", "1", "really", "ray", at(5)), ("b", "1", "old", "lee", at(1))]
    assert rows_of(spark, path) == want
    put(("a", "1", "really", "ray", at(5), False), ("a", "2", None, "ray", at(4), True))  # a run repeated
    put(("a", "2", "older than the mark", "lou", at(3), False), ("a", "1", "no time", "lou", None, False))
    assert rows_of(spark, path) == want
    put(("a", "1", None, "ray", at(6), True))
    assert rows_of(spark, path) == want[1:]
    put(("a", "1", "tie 2", "z", at(7), False), ("a", "1", "tie 1", "z", at(7), False))
    assert rows_of(spark, path)[0] == ("a", "1", "tie 2", "z", at(7))
    assert [r["id"] for r in ledger.current(spark, path, spark.createDataFrame([], LEDGER).schema, "b").collect()] == ["1"]


def test_other_scans_and_broken_runs_leave_the_ledger_alone(spark, tmp_path):
    folder, path = tmp_path / "l", (tmp_path / "l").as_uri()
    ledger.upsert(spark.createDataFrame([("a", "1", "x", "k", at(1), False), ("b", "1", "y", "k", at(1), False)], LEDGER), path)
    files = lambda scan: sorted((f, os.stat(folder / f"scan_id={scan}" / f).st_mtime_ns) for f in os.listdir(folder / f"scan_id={scan}") if f.endswith(".parquet"))
    before = files("b"), rows_of(spark, path)
    broken = spark.createDataFrame([("a", "2", "z", "k", at(2), False), ("b", "2", "z", "k", at(2), False)], LEDGER)
    fails = F.udf(lambda x: 1 / 0, "string")
    with pytest.raises(Exception, match="ZeroDivision|division"):
        ledger.upsert(broken.withColumn("reason", F.when(F.col("scan_id") == "b", fails("reason")).otherwise(F.col("reason"))), path)
    assert (files("b"), rows_of(spark, path)) == before
    ledger.upsert(broken.where("scan_id = 'a'"), path)
    assert files("b") == before[0] and [r[:2] for r in rows_of(spark, path)] == [("a", "1"), ("a", "2"), ("b", "1")]
    plain = spark.createDataFrame([("c", 1, 5), ("c", 1, 7)], "scan_id string, rank int, at int")
    ledger.upsert(plain, (tmp_path / "m").as_uri(), keys=("scan_id", "rank"))
    assert [tuple(r) for r in ledger.current(spark, (tmp_path / "m").as_uri(), plain.schema).collect()] == [("c", 1, 7)]


@pytest.mark.parametrize(("budget", "most"), [(7, {}), (7, {"x": 3}), (100, {"y": 2}), (0, {}), (3, {"x": 0})])
def test_budget_is_filled_class_by_class(spark, budget, most):
    rnd = random.Random(budget)
    rows = [(rnd.choice(["x", "y", "w", None]), rnd.randrange(20), i) for i in range(60)]
    df = spark.createDataFrame(rows, "c string, v int, i int").repartition(7)
    kept, shares = order.budgeted(df, "c", ["x", "none", "y"], ["v", "i"], budget, most)
    left, want, told = budget, [], []
    for name in ("x", "none", "y"):
        mine = sorted((v, i) for c, v, i in rows if c == name)
        take = min(len(mine), most.get(name, budget), left)
        want += [(name, v, i) for v, i in mine[:take]]
        told.append((name, len(mine), take, len(mine) - take))
        left -= take
    assert [tuple(r) for r in kept.orderBy("place").select("c", "v", "i").collect()] == want
    assert [r["place"] for r in kept.orderBy("place").collect()] == list(range(1, len(want) + 1))
    assert sorted(map(tuple, shares.collect())) == sorted(told)


def test_unions_keep_the_first_order(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["g", "h"]), n, rnd.choice([None, [], [rnd.choice("abcde") for _ in range(3)], ["z", None, "a"]])) for n in rnd.sample(range(1000), 80)] + [("only", 1, None), ("only", 2, [])]
    want = {}
    for key, _, items in sorted(rows, key=lambda r: r[1]):
        for item in [*want.setdefault(key, []), *(items or [])]:
            if item is not None and item not in want[key]:
                want[key].append(item)
    got = aggregates.first_seen_union(spark.createDataFrame(rows, "k string, n int, items array<string>").repartition(5), ["k"], "items", ["n"])
    assert {r["k"]: r["items"] for r in got.collect()} == want
    assert aggregates.first_seen_union(spark.createDataFrame([], "k string, n int, items array<string>"), ["k"], "items", ["n"]).collect() == []


def test_messages_are_gated(spark):
    facts = spark.createDataFrame([("s", 2, True, None), ("t", 0, None, "x")], "scan_id string, n long, p boolean, w string")
    table = (("a", "n > 1", "{n} of them, {w}."), ("a", "p", "p holds"), ("b", None, "always"), ("b", "w = 'x'", "{w}"))
    assert [tuple(r) for r in coverage.gated(facts, table).orderBy("scan_id", "place").collect()] == [
        ("s", "a", 0, "2 of them, unknown."), ("s", "a", 1, "p holds"), ("s", "b", 2, "always"), ("t", "b", 2, "always"), ("t", "b", 3, "x"),
    ]
    assert coverage.gated(facts.limit(0), table).collect() == []


def queue(edges, seeds, sure_only, most):
    """node -> (depth, path) by a queue, and whether a node at the bound has a source that wasn't seen."""
    sources = {}
    for s, t in sorted({(s, t) for s, t, sure in edges if sure or not sure_only}):
        sources.setdefault(t, []).append(s)
    seen, line, capped = {s: (0, [s]) for s in seeds}, sorted(seeds), False
    for node in line:
        depth, path = seen[node]
        if depth >= most:
            capped |= any(s not in seen for s in sources.get(node, []))
            continue
        for s in sources.get(node, []):
            if s not in seen:
                seen[s] = (depth + 1, [*path, s])
                line.append(s)
    return seen, capped


@pytest.mark.parametrize("most", [2, 25])
def test_closures_equal_a_queue(spark, most, monkeypatch):
    monkeypatch.setattr(closure, "BITS", 3)  # so that seeds fill several rows
    rnd = random.Random(most)
    nodes = [f"n{i:02}" for i in range(40)]
    edges = [(rnd.choice(nodes), rnd.choice(nodes), rnd.random() < 0.6) for _ in range(90)] + [("n00", "n00", True)]
    seeds = {f"s{k}": sorted(rnd.sample(nodes, rnd.randrange(1, 4))) for k in range(8)}
    df = spark.createDataFrame([*edges, edges[0], (None, "n01", True), ("n01", None, True)], "source string, target string, confirmed boolean")
    pairs = spark.createDataFrame([(s, n) for s, ns in seeds.items() for n in ns] + [(None, "n01"), ("s0", None)], "seed string, node string")
    want, capped = {}, set()
    for seed, ns in seeds.items():
        every, cut = queue(edges, ns, False, most)
        sure, _ = queue(edges, ns, True, most)
        want |= {(seed, n): (d, sure[n][0] if n in sure else None) for n, (d, _) in every.items()}
        capped |= {seed} if cut else set()
    found, over = closure.reach(df, pairs, confirmed="confirmed", max_depth=most)
    assert {(r["seed"], r["node"]): (r["depth"], r["sure_depth"]) for r in found.collect()} == want
    assert {r["seed"] for r in over.collect()} == capped
    for seed in ("s0", "s5"):
        every, cut = queue(edges, seeds[seed], False, most)
        sure, _ = queue(edges, seeds[seed], True, most)
        rows, told = closure.two_tier_closure(df, pairs.where(F.col("seed") == seed).select("node"), "confirmed", max_depth=most, paths=True)
        assert {r["node"]: (r["depth"], r["path"], r["confirmed"]) for r in rows.collect()} == {n: (*(sure[n] if n in sure else every[n]), n in sure) for n in every} and told == cut


def test_nothing_reaches_nothing(spark):
    df = spark.createDataFrame([], "source string, target string, confirmed boolean")
    found, over = closure.reach(df, spark.createDataFrame([("s", "a")], "seed string, node string"), confirmed="confirmed")
    assert [tuple(r) for r in found.collect()] == [("s", "a", 0, 0)] and not over.collect()
    found, over = closure.reach(df, spark.createDataFrame([], "seed string, node string"))
    assert not found.collect() and not over.collect()
    with pytest.raises(graph.NotSelectable):
        graph.impact_seeds(df, ("service",))


def test_patterns_by_kind(spark):
    """Whole texts, beginnings, ends and insides, with ties of order and lengths beyond the values'."""
    rnd = random.Random(11)
    word = lambda n: "".join(rnd.choice("ab ") for _ in range(n))
    rules = [(i, rnd.choice(["", "*"]) + word(rnd.randrange(4)) + rnd.choice(["", "*"]), f"r{i}") for i in range(40)] + [(50, "a*b", "star"), (51, "abababab*", "long")]
    rules = rnd.sample(rules, len(rules))
    values = [word(rnd.randrange(7)).upper() for _ in range(120)] + ["", "A*B", None]

    def fits(text, pattern):
        body = pattern[1:] if pattern.startswith("*") else pattern
        body = body[:-1] if body.endswith("*") else body
        head, tail = pattern.startswith("*"), pattern.endswith("*")
        return body in text if head and tail else text.startswith(body) if tail else text.endswith(body) if head else text == pattern

    bare = lambda x: "".join(x.lower().split())
    table = spark.createDataFrame(rules, "ord int, pattern string, name string")
    for chosen in (table, table.where("pattern NOT LIKE '*%*'"), table.limit(0)):
        left = [tuple(r) for r in chosen.collect()]
        want = sorted((i, v, min(h)[1]) for i, v in enumerate(values) if v is not None and (h := [(o, n) for o, p, n in left if fits(bare(v), bare(p))]))
        df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
        assert sorted(map(tuple, matching.first_glob(df, "v", ["i"], chosen).collect())) == want


def test_a_large_budget_cuts_each_class_before_ranking(spark):
    from pyspark.sql import functions as F

    df = spark.range(20_000, numPartitions=4).select(F.lit("x").alias("c"), (F.col("id") * 7919 % 20_000).alias("v"))
    kept, shares = order.budgeted(df, "c", ["x"], ["v"], 5000)
    assert "TakeOrderedAndProject" in kept._jdf.queryExecution().executedPlan().toString()
    assert [(r["v"], r["place"]) for r in kept.orderBy("v").collect()] == [(i, i + 1) for i in range(5000)]
    assert [tuple(r) for r in shares.collect()] == [("x", 20_000, 5000, 15_000)]


def _graph_tables(spark):
    """Findings and imports with repeats, nulls, a file that imports itself, files that lead nowhere and names that look like other kinds."""
    pick = random.Random(16)
    names = [f"m{i}.py" for i in range(9)]
    findings = [(str(i), pick.choice(names[:4]), i % 5, f"e{i}", pick.choice([None, "api"]), "R", pick.choice(["RSA", "AES"]), pick.choice([None, "lib", "file:m1.py"]), pick.choice([None, "s", "t"])) for i in range(12)]
    kinds = ["resolved", "ambiguous", "wildcard", "external", "unresolved", None]
    imports = [(pick.choice(names), pick.randrange(4), pick.choice(kinds), pick.choice([None, None, None, "lib"]), pick.choice([[], pick.sample(names, 2), pick.sample(names, 1), None]), "x", f"import {pick.randrange(3)}") for _ in range(90)]
    columns = "id string, file string, line_start int, evidence string, api string, rule_id string, algorithm string, library string, service string"
    return spark.createDataFrame(findings, columns), spark.createDataFrame(imports, "file string, line int, resolution string, crypto_library string, targets array<string>, spec string, evidence string")


def test_links_are_the_edges_and_read_imports_once(spark):
    findings, imports = _graph_tables(spark)
    read, told = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def count(counter):
        return F.udf(lambda x: (counter.add(1), x)[1], "string").asNondeterministic()  # else Spark may call it once more for a filter

    watched = imports.withColumn("file", count(read)("file")).withColumn("evidence", count(told)("evidence"))
    columns = ["type", "source", "target", "confirmed", "evidence_count"]
    rows = lambda df: sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
    links = graph.links(findings, watched)
    assert links.columns == columns and rows(links) == rows(graph.edges(findings, imports))
    assert 0 < read.value <= imports.count() and told.value == 0
    scans = lambda df: df.withColumn("scan_id", F.lit("a"))
    assert rows(graph.edges_of_scans(scans(findings), scans(imports), evidence=False)[0]) == rows(graph.edges_of_scans(scans(findings), scans(imports))[0])


def test_edges_between_pairs_are_those_of_the_graph(spark):
    findings, imports = _graph_tables(spark)
    whole, links = graph.edges(findings, imports), graph.links(findings, imports)
    reached, _ = graph.impact(links, "algorithm:RSA")
    pairs = graph.leg_pairs(reached)
    assert not pairs.isEmpty()
    some = graph.edges_between(pairs, findings, imports)
    rows = lambda df: sorted((str(r.asDict(recursive=True)) for r in df.collect()))
    assert rows(some.select(*whole.columns)) == rows(whole.join(pairs, ["source", "target"], "left_semi").select(*whole.columns))
    assert rows(graph.indirect(reached, some)) == rows(graph.indirect(reached, whole))
