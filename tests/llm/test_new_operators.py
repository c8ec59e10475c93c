"""Operators 11 to 13 against brute-force versions, on awkward rows and on damaged archives."""

import collections
import gzip
import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspar.llm import negatives, trie, warc

# ---- conversation prefix trie


def brute_trie(rows):
    """rows (conv, turn, role, text) -> the nodes, as tuples in the operator's order of columns."""
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}
    taken = lambda c: zlib.crc32(str(c).encode()) % 6
    built = {c: [*own.get(c - int(math.fmod(c, 100)), [])[: taken(c)], *x[taken(c) :]] for c, x in own.items()}
    members = collections.defaultdict(list)
    for c, x in built.items():
        for d in range(len(x) + 1):
            members[tuple(x[:d])].append(c)
    children = collections.defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    sums = {}
    for node in sorted(members, key=len, reverse=True):
        below = [sums[x] for x in children[node]]
        saved = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        sums[node] = (sum(x[0] for x in below) if below else 1, saved + sum(x[1] for x in below))
    ends = lambda node: hashlib.sha256(",".join(str(c) for c in sorted(members[node]) if len(built[c]) == len(node)).encode()).hexdigest()
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children[n]), *sums[n], ends(n)) for n, m in members.items())


def trie_rows(spark, rows, **options):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, a string, conv string, depth string, shard int, label string")
    return sorted(map(tuple, trie.prefix_trie(df, **options).collect()))


def conversations(rnd, convs, words=("a", "b", "ü漢", "", None)):
    rows = []
    for conv in convs:
        for turn in range(rnd.randrange(0, 9)):
            rows.append((conv, rnd.choice([turn, turn, None, 3]), rnd.choice(["user", "assistant", None]), rnd.choice(words)))
    return rows


def wide(rows):
    return [(*r, "x", "y", "z", 1, "l") for r in rows]


def test_trie_equals_brute_force(spark):
    rnd = random.Random(3)
    rows = conversations(rnd, [*range(0, 40), *range(95, 130), 205, 307, -7, -100, -101, 10_000_000_003])
    rows += [(7, 1, "user", "same"), (7, 1, "user", "same"), (None, 1, "user", "no conversation"), (8, None, None, None), (500, 0, "user", "w " * 40_000)]
    assert trie_rows(spark, wide(rows)) == brute_trie(rows)


@pytest.mark.parametrize("words", [("one",), ("a", "b")])
def test_trie_over_stretches_and_shards(spark, monkeypatch, words):
    """Long conversations lie in many stretches, families in many shards, ids of one node in many texts."""
    monkeypatch.setattr(trie, "STRETCH", 7)
    monkeypatch.setattr(trie, "SHARD_ROWS", 40)
    monkeypatch.setattr(trie, "CHUNK_IDS", 3)
    rnd = random.Random(4)
    rows = conversations(rnd, range(0, 30), words)
    for conv, n in ((100, 60), (101, 60), (133, 35), (4, 29), (100_000, 21)):
        rows += [(conv, 10 + i, "user", "t" if i < 25 else rnd.choice(words)) for i in range(n)]
    assert trie_rows(spark, wide(rows)) == brute_trie(rows)


def test_digests_that_clash_are_made_anew(spark):
    rows = conversations(random.Random(5), range(0, 60), [f"w{i}" for i in range(30)])
    assert trie_rows(spark, wide(rows), bits=2) == brute_trie(rows)


def test_one_conversation_with_most_rows(spark):
    rows = [(1, i, "user", f"t{i % 3}") for i in range(3000)] + [(c, 0, "user", "hi") for c in range(2, 60)]
    assert trie_rows(spark, wide(rows)) == brute_trie(rows)


def test_empty_trie(spark):
    assert trie_rows(spark, []) == [] and trie_rows(spark, wide([(None, 1, "user", "x")])) == []


@given(st.sets(st.tuples(st.integers(-(2**63), 2**63 - 1), st.integers(-(2**63), 2**63 - 1)), max_size=300))
@settings(max_examples=60, deadline=None)
def test_slots_are_minimal_and_perfect(digests):
    a, b = (np.array([d[i] for d in digests], np.int64) for i in range(2))
    table = trie.NodeTable(a, b)
    assert sorted(table.slots(a, b).tolist()) == list(range(len(digests)))
    others = [(x, y ^ 1) for x, y in digests if (x, y ^ 1) not in digests]
    assert (table.slots(np.array([x for x, _ in others], np.int64), np.array([y for _, y in others], np.int64)) == -1).all()


# ---- WARC

PAGES = "page_id long, url string, html string, digest string, path string, payload string"


def page_rows(htmls, ids=None):
    return [(i, f"http://host/{i} \r\nx%20ü", h, "d", "p", "q") for i, h in zip(ids or range(len(htmls)), htmls, strict=True)]


def brute_records(rows):
    out = []
    for i, _, html, *_ in rows:
        body = (html or "").encode()
        same = [r[0] for r in rows if r[0] is not None and (r[2] or "").encode() == body]
        first = min(same, default=None)
        again = len(body) >= 100 and first is not None and i != first
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first if again else None))
    return collections.Counter(out)


@pytest.mark.parametrize("options", [{}, {"compressed": False}, {"archive_bytes": 3000, "torn_every": 2}, {"compressed": False, "torn_every": 3}])
def test_records_equal_brute_force(spark, options):
    body = "<p>" + "same words " * 20
    htmls = [None, "", body, "x" * 99, "x" * 99, "y" * 100, "y" * 100, body, "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 3, "ü" * 50, "ü" * 50, "z" * 3_000_000, body, "\r\n\r\n", "q" * 200, "q" * 200]
    rows = page_rows(htmls, [3, 5, 9, 1, 2, 8, 7, 6, 10, 12, 11, 13, 6, None, None, 14])
    got = warc.page_records(spark.createDataFrame(rows, PAGES), **options).collect()
    assert collections.Counter(map(tuple, got)) == brute_records(rows)


def test_records_of_an_empty_table_and_of_names(spark):
    assert warc.page_records(spark.createDataFrame([], PAGES)).collect() == []
    named = spark.createDataFrame([("b:1 ü", None, "x" * 100), ("a/2", "u", "x" * 100), (None, "u", "")], "page_id string, url string, html string")
    assert sorted((r["page_id"] or "", r["record_type"], r["refers_to"]) for r in warc.page_records(named).collect()) == [("", "response", None), ("a/2", "response", None), ("b:1 ü", "revisit", "a/2")]


def archive(records, compressed):
    pack = (lambda x: gzip.compress(x, mtime=0)) if compressed else (lambda x: x)
    return [pack(warc.page_record(i, f"http://h/{i}", body, hashlib.sha256(body).hexdigest(), None)) for i, body in enumerate(records)]


def read(spark, path, data):
    path.write_bytes(data)
    rows = warc.read_archives(spark.createDataFrame([(path.as_uri(),)], "path string")).collect()
    return {r["record_id"].split(":")[2]: bytes(r["payload"]) for r in rows if r["gap"] is None}, sorted((r["offset"], r["bytes"], r["gap"]) for r in rows if r["gap"] is not None)


@pytest.mark.parametrize("compressed", [True, False])
@pytest.mark.parametrize("kind", ["flipped", "cut", "junk", "lost start", "wrong length", "head", "tail", "zeros"])
def test_what_lies_behind_damage_is_salvaged(spark, tmp_path, compressed, kind):
    rnd = random.Random(kind)
    bodies = [rnd.randbytes(rnd.randrange(50, 4000)) for _ in range(12)]
    parts = archive(bodies, compressed)
    lost, gap = {5}, None
    if kind == "flipped":
        at = len(parts[5]) - (12 if compressed else 200)
        parts[5] = parts[5][:at] + bytes([parts[5][at] ^ 0xFF]) + parts[5][at + 1 :]
    elif kind == "cut":
        parts[5] = parts[5][: len(parts[5]) // 2]
    elif kind == "lost start":
        parts[5] = parts[5][7:]
    elif kind == "wrong length":
        raw = gzip.decompress(parts[5]) if compressed else parts[5]
        raw = raw.replace(b"Content-Type: application/http; msgtype=response\r\nContent-Length: ", b"Content-Type: application/http; msgtype=response\r\nContent-Length: 9", 1)
        parts[5] = gzip.compress(raw, mtime=0) if compressed else raw
    else:
        lost = set()
        noise = bytes(3000) if kind == "zeros" else b"\x1f\x8b\x08 WARC/1.0\r\n" + rnd.randbytes(3000) + b"\nWARC/1.1\r\nA: b\r\n\r\n"
        parts.insert({"head": 0, "tail": 12}.get(kind, 5), noise)
        gap = noise
    found, gaps = read(spark, tmp_path / "a.warc", b"".join(parts))
    assert found == {str(i): b for i, b in enumerate(bodies) if i not in lost}
    place = 0 if kind == "head" else 12 if kind == "tail" else 5
    assert [g[:2] for g in gaps] == [(sum(map(len, parts[:place])), len(gap if gap is not None else parts[5]))] and gaps[0][2]


def test_random_damage_loses_only_what_it_touches(spark, tmp_path):
    rnd = random.Random(8)
    for compressed in (True, False):
        bodies = [rnd.randbytes(rnd.randrange(10, 900)) for _ in range(60)]
        parts = archive(bodies, compressed)
        data, stops = bytearray(b"".join(parts)), np.cumsum([0, *map(len, parts)])
        hit = sorted(rnd.sample(range(len(data)), 8))
        for at in hit:
            data[at] ^= 1 + rnd.randrange(255)
        touched = {int(np.searchsorted(stops, at, side="right")) - 1 for at in hit}
        found, gaps = read(spark, tmp_path / f"b{compressed}", bytes(data))
        assert {i: b for i, b in found.items() if int(i) not in touched} == {str(i): b for i, b in enumerate(bodies) if i not in touched}
        assert all(any(lo <= stops[i] + len(parts[i]) - 1 and stops[i] <= lo + n - 1 for i in touched) for lo, n, _ in gaps)


def test_records_of_other_writers(spark, tmp_path):
    """Version 1.0, other digests, continued headers, several records in one member, other record types."""
    block = b"GET / HTTP/1.1\r\n\r\n"
    sha1 = __import__("base64").b32encode(hashlib.sha1(block).digest())
    one = b"WARC/1.0\r\nWARC-Type: request\r\nWARC-Record-ID: <urn:x:a:r1>\r\nWARC-Block-Digest: sha1:" + sha1 + b"\r\nX-Note: one\r\n two\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    two = b"WARC/1.1\nWARC-Type: metadata\r\nWARC-Record-ID: <urn:x:b:r2>\r\nWARC-Block-Digest: md5:abc\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    found, gaps = read(spark, tmp_path / "o.warc.gz", gzip.compress(one + two) + gzip.compress(b"no record") + gzip.compress(two.replace(b":b:", b":c:")))
    assert found == {"a": block, "b": b"", "c": b""} and len(gaps) == 1
    found, gaps = read(spark, tmp_path / "p.warc", one + two.replace(b"md5:abc", b"sha1:abc") + one.replace(b":a:", b":d:"))
    assert found == {"a": block, "d": block} and [g[2] for g in gaps] == ["another block digest"]
    assert read(spark, tmp_path / "empty.warc", b"") == ({}, [])


# ---- hard negatives


def brute_negatives(rows, every=100):
    use = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    clip = lambda x: min(max(x, -(1 << 63)), (1 << 63) - 1)
    for anchor in {r[0] for r in use if r[0] % every == 0}:
        _, label, vector = min((lab, v) for i, lab, v in use if i == anchor) and (anchor, *min((lab, v) for i, lab, v in use if i == anchor))
        scored = sorted((-clip(sum(a * b for a, b in zip(vector, v))), i, lab) for i, lab, v in use if i != anchor)  # noqa: B905
        for top, positive, _ in [x for x in scored if x[2] == label][:5]:
            fit = [x for x in scored if x[2] != label and 30 * -top <= 100 * -x[0] <= 90 * -top][:10]
            out += [(anchor, positive, rank, i, -top, -s) for rank, (s, i, _) in enumerate(fit, 1)]
    return collections.Counter(out)


def mined(spark, rows, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, label int, embedding array<{kind}>").withColumn("id", F.lit("x")).withColumn("score", F.lit(1)).withColumn("row_part", F.lit(9))
    return collections.Counter(map(tuple, negatives.hard_negatives(negatives.usable(df)).collect()))


def test_hard_negatives_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(negatives, "CELL_ROWS", 50)
    monkeypatch.setattr(negatives, "CELL_ANCHORS", 2)
    rnd = np.random.default_rng(6)
    rows = [(int(i), int(rnd.integers(0, 3)), rnd.normal(0, 0.2, 8).astype(np.float32).tolist()) for i in rnd.permutation(330)]
    rows += [(i, 1, rows[0][2]) for i in range(1000, 1040)]  # ties
    rows += [(2000, 1, [0.0] * 8), (2001, 1, [0.0] * 8), (2002, 2, [0.0] * 8), (1999, 0, [0.0] * 8)]  # scores of 0
    rows += [(-100, 2, [0.5] * 8), (-1, 2, [0.25] * 8), rows[5], rows[5]]
    rows += [(None, 1, [1.0] * 8), (3000, None, [1.0] * 8), (3001, 1, None), (3002, 1, [1.0, None]), (3003, 1, [float("nan")]), (3004, 1, [float("inf")]), (3100, 1, []), (3101, 2, [1.0])]
    assert mined(spark, rows) == brute_negatives(rows)


def test_repeated_anchors_and_equal_vectors(spark):
    rows = [(100, 1, [1.0, 1.0]), (100, 1, [1.0, 0.5]), (100, 1, [1.0, 1.0])] + [(i, i % 2, [1.0, i % 5 / 4]) for i in range(1, 90)]
    assert mined(spark, rows) == brute_negatives(rows)


def test_scores_beyond_doubles_stay_exact(spark):
    rnd = random.Random(9)
    for size in (1e6, 1e12, 1e30):
        rows = [(i, rnd.randrange(2), [size * rnd.uniform(0.5, 1), size * rnd.uniform(-0.2, 1)]) for i in range(0, 200, 5)]
        assert mined(spark, rows, "double") == brute_negatives(rows)


def test_no_vectors_no_negatives(spark):
    assert not mined(spark, []) and not mined(spark, [(100, 1, [1.0])]) and not mined(spark, [(1, 1, [1.0]), (2, 2, [1.0])])


def test_keys_sort_as_anchor_score_kind_id():
    rnd = random.Random(10)
    edge = [-(1 << 63), -1, 0, 1, (1 << 63) - 1]
    rows = [(rnd.choice(edge), rnd.choice(edge), rnd.randrange(2), rnd.choice(edge)) for _ in range(400)]
    keys = negatives.packed(*(np.array(x) for x in zip(*rows, strict=True)))
    assert list(zip(*negatives.unpacked(keys), strict=True)) == rows
    by_key = [r for _, r in sorted(zip(keys.to_pylist(), rows, strict=True))]
    assert by_key == sorted(rows, key=lambda r: (r[0], -r[1], r[2], r[3]))
    assert negatives.packed(*[np.zeros(0, np.int64)] * 4).type == pa.binary()
