import collections
import itertools
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillspar.llm import chat, decontaminate, exact_dedup, licenses, mixing, ngram_join, quality, sharding, tables, textkernel, token_store, tokens
from quillspar.operators import order
from tests.llm.conftest import SCHEMA, rows_of

BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


def texts_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


# ---- token counts


def test_token_counts_are_the_librarys(awkward, docs):
    tokenizer = Tokenizer.from_file(BPE)
    for df in (awkward, docs):
        want = collections.Counter((i, len(t.encode()), n := len(tokenizer.encode(t, add_special_tokens=False).ids), n > 1024) for i, t in texts_of(df))
        assert collections.Counter(map(tuple, tokens.token_counts(df, BPE).collect())) == want


def test_tricky_pieces(spark):
    texts = ["don't we'll I'VE 'tis rock'n'roll", "a<|endoftext|>b <|endoftext|>", "x  y   z\n\n w\n", " lead", "tail ", "a  b c", "é, è. «ñ» x×y÷z", "1,000.5% of_it", "\r\na\tb", "漢 字、かな", "áb c‍d", "||| a|b |c|"]
    tokenizer = Tokenizer.from_file(BPE)
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(spark.createDataFrame(rows_of(texts), SCHEMA), BPE).collect()}
    assert got == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_other_tokenizers_encode_whole_texts(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    some = docs.where("doc_id % 10 = 0")
    assert {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(some, path).collect()} == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) for i, t in texts_of(some)}


# ---- token store


def test_store_round_trip(awkward, docs):
    tokenizer = Tokenizer.from_file(BPE)
    for df, shard in ((docs, 20_000), (awkward.where("doc_id IS NOT NULL"), 50)):
        got = sorted(map(tuple, token_store.token_digest(df, BPE, shard_ids=shard).collect()), key=lambda r: r[1])
        at, want = 0, []
        assert [r[0] for r in got] == sorted(r[0] for r in got)
        for i, text in texts_of(df):
            ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
            want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        assert collections.Counter((r[0], r[2], r[3]) for r in got) == collections.Counter(want)
        for r in got:
            assert r[1] == at
            at += r[2]


def test_tokens_are_found_without_decoding(spark, docs, tmp_path):
    path = (tmp_path / "tokens").as_uri()
    token_store.write_tokens(docs, BPE, path, shard_ids=10_000)
    tokenizer = Tokenizer.from_file(BPE)
    token = tokenizer.encode(" the", add_special_tokens=False).ids[0]
    want = sum(tokenizer.encode(t, add_special_tokens=False).ids.count(token) for _, t in texts_of(docs))
    found = token_store.find_token(spark, path, token).collect()
    assert sum(r["n"] for r in found) == want and all(len(r["places"]) == r["n"] for r in found)


# ---- exact copies


def wanted_copies(df):
    groups = collections.defaultdict(list)
    for i, text in texts_of(df):
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text)].append(i)
    least = {t: min((i for i in g if i is not None), default=None) for t, g in groups.items()}
    return collections.Counter((i, least[t], len(g), i == least[t], hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g)


def test_exact_copies(awkward, docs):
    every = lambda c: F.lit(7)  # noqa: E731 - all hashes collide: one chain of all texts
    for df, options in ((awkward, {"capacity": 2}), (docs, {"capacity": 16, "share_rows": 3}), (docs, {"hashed": every, "share_rows": 50}), (docs, {"hashed": lambda c: F.length(c) % 40, "capacity": 30})):
        assert collections.Counter(map(tuple, exact_dedup.exact_duplicates(df, **options).collect())) == wanted_copies(df)


def test_directory_splits_overfull_buckets_and_rows_go_through_it(docs):
    # Half of the hashes share their first bits, so that buckets of different depths come about.
    index = exact_dedup.ExactIndex(docs, capacity=8, hashed=lambda c: F.when(F.xxhash64(c) > 0, F.xxhash64(c)).otherwise(F.shiftrightunsigned(F.xxhash64(c), 5)))
    sizes = {r["bucket"]: r["count"] for r in index.entries.groupBy("bucket").count().collect()}
    slots = index.directory.slots.collect()
    assert max(sizes.values()) <= 8 and {s["bucket"] for s in slots} == set(sizes)
    assert index.directory.doublings > 0 and len({s["local"] for s in slots}) > 2
    assert all((s["bucket"] % (1 << 64)) >> (64 - s["local"]) == s["slot"] >> (index.directory.depth - s["local"]) for s in slots)
    index.directory.slots = index.directory.slots.limit(0)
    assert index.classes().count() == 0


def test_directory_doubles_at_its_own_capacity_and_may_be_joined(spark, awkward, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert exact_dedup.ExactIndex(docs).directory.doublings > 0
    monkeypatch.setattr(exact_dedup, "BROADCAST_SLOTS", 0)
    assert collections.Counter(map(tuple, exact_dedup.exact_duplicates(awkward, capacity=2, share_rows=2).collect())) == wanted_copies(awkward)


def test_copies_go(awkward):
    left = exact_dedup.drop_exact_duplicates(awkward)
    assert left.columns == awkward.columns
    assert sorted(r["doc_id"] for r in left.where("text IS NOT NULL AND length(text) > 500 AND length(text) < 10000").select("doc_id").distinct().collect()) == [5, 6, 7]


# ---- n-gram join


def brute_classes(pairs, percent=80):
    sets, parent = {}, {}
    for i, text in pairs:
        words = re.findall(r"[^\x20\x09-\x0D]+", low(text))
        sets.setdefault(i, set()).add(frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else []))
    nodes = [(i, s) for i, every in sets.items() for s in every]
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(nodes):
        for j, b in nodes[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {(i, len(s)): find(i) for i, s in nodes}


def test_ngram_classes(spark, awkward, docs):
    rnd = np.random.default_rng(3)
    base = [f"t{i}" for i in range(150)]
    chain = []
    for step in range(60):  # a chain of near copies, copies with own changes, and short texts
        words = list(base)
        for at in rnd.integers(0, 150, rnd.integers(0, 5)):
            words[at] = f"x{step}_{at}"
        chain.append(" ".join(words[: 150 - step % 7]))
    drift = list(base)
    for step in range(20):
        drift[step * 3] = f"d{step}"
        chain.append(" ".join(drift))
    hard = spark.createDataFrame(rows_of([*chain, "a b", "A  b", "a b c d", "", None], 100), SCHEMA)
    for df in (hard, docs, awkward.where("doc_id IS NOT NULL AND doc_id <> 9")):
        want = brute_classes(texts_of(df))
        got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in ngram_join.ngram_classes(df).collect()}
        assert got == want


def test_one_of_each_group_stays(awkward):
    left = ngram_join.distinct_documents(awkward)
    assert left.columns == awkward.columns
    classes = {}
    for i, text in texts_of(awkward):
        words = re.findall(r"[^\x20\x09-\x0D]+", low(text))
        classes.setdefault(tuple(words), []).append(i)
    want = collections.Counter(i for words, ids in classes.items() for i in (ids if not words else [min(ids, key=lambda i: (i is None, i or 0))]))
    del want[7]  # the one near copy, of 5
    assert collections.Counter(r["doc_id"] for r in left.collect()) == want


def test_rows_of_one_id_are_judged_apart(spark):
    base = [f"t{i}" for i in range(60)]
    near, other = " ".join([*base[:-1], "changed"]), " ".join(f"o{i}" for i in range(30))
    texts = [(1, " ".join(base)), (2, near), (2, other), (2, other), (None, near), (None, "words of its own here it is"), (None, "Words of its own here it is"), (3, None), (3, ""), (4, other)]
    df = spark.createDataFrame([(i, t, "en", "s", 1, 7, "s", "k", "l") for i, t in texts], SCHEMA)
    left = collections.Counter((r["doc_id"], low(r["text"] or "")) for r in ngram_join.distinct_documents(df).collect())
    assert left == collections.Counter({(1, " ".join(base)): 1, (2, other): 1, (None, "words of its own here it is"): 1, (3, ""): 2})


# ---- decontamination


def test_planted_passages(spark, docs, data):
    items = spark.read.parquet(f"{data}/benchmark.parquet")
    passages = [r["text"] for r in items.orderBy("item_id").collect()]
    filler = " ".join(f"filler{i}" for i in range(80))

    def spoiled(text, every):
        return " ".join("changed" if i % every == every - 1 else w for i, w in enumerate(text.split()))

    texts = [f"{filler} {passages[0]} {filler}", f"{filler} {spoiled(passages[1], 6)}", passages[2].upper(), f"{filler} {spoiled(passages[3], 3)}", filler, None, "", " ".join(passages[4].split()[:8])]
    planted = spark.createDataFrame(rows_of(texts), SCHEMA)
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminations(planted, items).collect()}
    assert {(0, 0), (1, 1), (2, 2)} <= found and {i for i, _ in found} == {0, 1, 2}
    kept = decontaminate.decontaminated(planted, items)
    assert kept.columns == planted.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 6, 7]


def longest_overlap(doc, item):
    """(agreeing words, words, -first word) of the best accepted overlap, over all starts, shifts and lengths."""
    best = None
    for shift in range(-len(item) + 1, len(doc)):
        for lo in range(max(0, -shift), len(item)):
            agree = 0
            for hi in range(lo, min(len(item), len(doc) - shift)):
                agree += doc[hi + shift] == item[hi]
                n = hi + 1 - lo
                if n >= min(decontaminate.OVERLAP_WORDS, len(item)) and 5 * (n - agree) <= n:
                    best = max(best or (0, 0, 0), (n, -lo - shift, agree))
    return best


def test_overlaps_equal_brute_force(spark, awkward):
    rnd = np.random.default_rng(2)
    say = lambda n: [f"v{x}" for x in rnd.integers(0, 12, n)]  # noqa: E731 - few words, so that much overlaps by chance
    passages = [say(n) for n in (1, 2, 3, 4, 5, 6, 8, 12, 13, 14, 17, 22, 30)]
    texts = []
    for _ in range(25):
        words = say(int(rnd.integers(0, 60)))
        item = passages[rnd.integers(0, len(passages))]
        for at in rnd.integers(0, len(item), len(item) // 5):
            item = [*item[:at], "new", *item[at + 1 :]]
        at = int(rnd.integers(0, len(words) + 1))
        texts.append(words[:at] + item + words[at:])
    items = spark.createDataFrame([(k, " ".join(p)) for k, p in enumerate(passages)], "item_id long, text string")
    docs = spark.createDataFrame(rows_of([" ".join(t) for t in texts]), SCHEMA)
    wanted = {(i, k): found for i, t in enumerate(texts) for k, p in enumerate(passages) if (found := longest_overlap(t, p))}
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminations(docs, items).collect()}
    assert set(got) == set(wanted) and len(got) > 40
    assert {k: (r["n_words"], -r["first_word"], r["matched"]) for k, r in got.items()} == wanted
    # Awkward rows: a passage that a long text, a copy and a row without an id hold.
    long = max((r["text"] or "" for r in awkward.collect()), key=len).split()
    items = spark.createDataFrame([(1, " ".join(long[30_000:30_020])), (2, "no id"), (3, None)], "item_id long, text string")
    assert sorted(map(tuple, decontaminate.contaminations(awkward, items).collect()), key=str) == sorted([(9, 1, 30_000, 20, 20), (None, 2, 0, 2, 2)], key=str)
    more = awkward.unionByName(awkward.where("doc_id = 5").withColumn("doc_id", F.lit(None).cast("long"))).unionByName(awkward.where("doc_id = 7").withColumn("doc_id", F.lit(9).cast("long")))
    left = decontaminate.decontaminated(more.withColumn("row", F.lit("r")).withColumn("doc", F.lit(1)), items)
    assert left.columns == [*awkward.columns, "row", "doc"] and left.count() == more.count() - 2
    assert sorted(str(r["doc_id"]) for r in left.collect()).count("None") == 2 and left.where("doc_id = 9").count() == 1


def test_overlaps_of_long_passages_equal_brute_force(spark):
    """Passages of up to 2,000 words, with words replaced one by one or in one block, in the midst of documents, cut, repeated, and at block edges."""
    rnd = np.random.default_rng(12)
    say = lambda name, n: [f"{name}{x}" for x in rnd.integers(0, 500, n)]
    lengths = (1, 13, 40, 129, 300, 600, 1000, 2000)
    passages = [say(f"p{k}x", n) for k, n in enumerate(lengths)]
    docs, wanted = [], {}
    for k, item in enumerate(passages):
        n = len(item)
        for share, place in itertools.product((0.0, 0.08, 0.2), ("front", "middle", "end", "spread", "ends")):
            many, doc = int(share * n), list(item)
            at = {"front": range(many), "middle": range((n - many) // 2, (n - many) // 2 + many), "end": range(n - many, n), "spread": rnd.permutation(n)[:many], "ends": [*range(many // 2), *range(n - many + many // 2, n)]}[place]
            for i in at:
                doc[i] = "other"
            before = say("d", int(rnd.integers(0, 1500)))
            lo, hi = (0, n) if share else sorted(rnd.integers(0, n + 1, 2).tolist())
            docs.append(before + doc[lo:hi] + say("e", 30))
    docs += [passages[7] + ["x"] * 500 + passages[7][:1990], passages[6] * 3, ["y"] * 1017 + passages[3] + passages[4], passages[5][:300] + ["gone"] + passages[5][300:]]
    for d, doc in enumerate(docs):
        doc = np.array(doc, dtype=object)
        for k, item in enumerate(passages):
            places = collections.defaultdict(list)
            for i, w in enumerate(item):
                places[w].append(i)
            shifts = {j - i for j, w in enumerate(doc) for i in places.get(w, ())}
            item = np.array(item, dtype=object)
            found = [(best[1], -(best[0] + s), best[2]) for s in shifts if (best := plain_longest(doc, item, s))]
            if found:
                wanted[d, k] = max(found)
    items = spark.createDataFrame([(k, " ".join(p)) for k, p in enumerate(passages)], "item_id long, text string")
    rows = spark.createDataFrame(rows_of([" ".join(t) for t in docs] * 2), SCHEMA).withColumn("doc_id", F.col("doc_id") % len(docs))
    got = {(r["doc_id"], r["item_id"]): (r["n_words"], -r["first_word"], r["matched"]) for r in decontaminate.contaminations(rows, items).collect()}
    assert got == wanted and len(got) > 100


def plain_longest(doc, item, shift):
    """As decontaminate.overlap, by counting each stretch's replaced words, longest stretches first."""
    lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
    least = min(decontaminate.OVERLAP_WORDS, len(item))
    same = np.array([doc[i + shift] == item[i] for i in range(lo, hi)], dtype=int)
    sums = np.concatenate(([0], np.cumsum(same)))
    if sums[-1] < 0.8 * least:
        return None
    for n in range(hi - lo, least - 1, -1):
        agree = sums[n:] - sums[: len(sums) - n]
        good = np.flatnonzero(5 * (n - agree) <= n)
        if len(good):
            return lo + int(good[0]), n, int(agree[good[0]])
    return None


def test_passages_without_an_id_of_their_own(spark):
    passages = [" ".join(f"{name}{i}" for i in range(20)) for name in ("a", "b", "c", "d")]
    items = spark.createDataFrame([(None, passages[0]), (1, passages[1]), (1, passages[2]), (None, passages[3]), (2, passages[2])], "item_id long, text string")
    planted = spark.createDataFrame(rows_of([f"before {p} after" for p in passages] + ["nothing of it"]), SCHEMA)
    found = collections.Counter(map(tuple, decontaminate.contaminations(planted, items).collect()))
    assert found == collections.Counter([(0, None, 1, 20, 20), (1, 1, 1, 20, 20), (2, 1, 1, 20, 20), (2, 2, 1, 20, 20), (3, None, 1, 20, 20)])
    assert [r["doc_id"] for r in decontaminate.decontaminated(planted, items).collect()] == [4]


def test_every_accepted_overlap_has_a_seed():
    # An overlap of 26 words or more holds one of 13 to 25 with as small a share of replaced words.
    for n in range(1, 26):
        # A passage of 13 words or more may be any longer than the overlap, a shorter one is the overlap.
        masks = [decontaminate.MASKS[m] for m in decontaminate.masks_of(n)]
        windows = [sum(1 << (at + i) for i, c in enumerate(mask) if c == "1") for mask in masks for at in range(n - len(mask) + 1)]
        most = int(n * decontaminate.REPLACED_SHARE + 1e-9)
        for places in itertools.combinations(range(n), most):  # fewer replaced words leave more windows whole
            gone = sum(1 << i for i in places)
            assert any(not w & gone for w in windows), (n, places)


def test_short_and_spoiled_passages_are_found(spark):
    patterns = [(n, (i,)) for n in (5, 6, 7, 8) for i in range(n)] + [(10, (2, 4)), (15, (2, 7, 9)), (12, ()), (1, ()), (2, ()), (3, ()), (4, ())]
    passages = [[f"p{k}w{i}" for i in range(n)] for k, (n, _) in enumerate(patterns)]
    items = spark.createDataFrame([(k, " ".join(words)) for k, words in enumerate(passages)], "item_id long, text string")
    texts = [" ".join(["before"] + ["changed" if i in gone else w for i, w in enumerate(words)] + ["after"] + [words[0]] * (len(words) == 1)) for words, (_, gone) in zip(passages, patterns, strict=True)]
    found = decontaminate.contaminations(spark.createDataFrame(rows_of(texts), SCHEMA), items).collect()
    assert {(r["doc_id"], r["item_id"], r["matched"]) for r in found} == {(k, k, n - len(gone)) for k, (n, gone) in enumerate(patterns)}


# ---- licenses


def test_license_places_equal_brute_force(awkward, docs, spark):
    said = spark.createDataFrame(rows_of(["MIT License", "the mit\n\nLICENSE, mit license", "smit license", "Licensed under the Apache Licence, Version 2.0", "GNU General; Public -- License v3", "mit licenses"]), SCHEMA)
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for df in (said, awkward, docs):
        got = collections.Counter(tuple(r)[:6] for r in licenses.license_scan(df).collect())
        want = collections.Counter()
        for i, text in texts_of(df):
            words = word.findall(low(text))
            places = [(k, label) for phrase, label in licenses.BASE_PHRASES.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
            at = [k for k, _ in places]
            want[i, len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))] += 1
        assert got == want


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def stands_in(notice, words):
    """Whether any words in a row are the notice within its edits, its name within the name's."""
    for lo in range(len(words)):
        for hi in range(lo + 1, len(words) + 1):
            if not notice.name:
                if edit_distance(notice.before, " ".join(words[lo:hi])) <= notice.edits:
                    return True
                continue
            for a in range(lo, hi + 1):
                for b in range(a, hi + 1):
                    if (a == lo) != (not notice.before) or (b == hi) != (not notice.after):
                        continue
                    if edit_distance(notice.name, " ".join(words[a:b])) <= notice.name_edits and edit_distance(notice.before, " ".join(words[lo:a])) + edit_distance(notice.after, " ".join(words[b:hi])) <= notice.edits:
                        return True
    return False


def test_notices_equal_brute_force(spark):
    rnd = np.random.default_rng(4)
    templates = ["licensed under the [mit] license", "licensed under the [apache] license", "spdx license identifier [zlib]", "licensed under {cc by nc}", "{mozilla} public license version", "this is free and unencumbered software"]
    notices = {t: licenses.NOTICES[t] for t in templates}
    texts = []
    for k in range(120):
        letters = list(re.sub(r"[][{}]", "", templates[k % len(templates)]))
        for at in rnd.integers(0, len(letters), rnd.integers(0, 5)):
            letters[at] = ["", "x", " ", letters[at] + "y"][rnd.integers(0, 4)]
        texts.append("ab " * rnd.integers(0, 2) + "".join(letters) + " cd" * rnd.integers(0, 2))
    got = {r["doc_id"]: {s["notice"]: s for s in r["spans"]} for r in licenses.license_scan(spark.createDataFrame(rows_of(texts), SCHEMA), notices=notices).collect()}
    found = 0
    for k, text in enumerate(texts):
        words = text.split()
        for template, label in notices.items():
            notice = licenses.Notice.of(template, label)
            assert (notice.text in got[k]) == stands_in(notice, words), (text, template)
            if notice.text in got[k]:
                span = got[k][notice.text]
                found += 1
                assert edit_distance(notice.text, " ".join(words[span["first_word"] : span["last_word"] + 1])) <= span["edits"] <= notice.edits + notice.name_edits
    assert found > 30


def test_fuzzy_notices(spark):
    told = {
        "Licensd under the Apache License, Verson 2.0": "apache",
        "released   UNDER the MIT licence!": "mit",
        "licensed under rocks and water": "",
        "Licensed under CC BY-NC 4.0.": "cc-by-nc",
        "Licensed under CC BY-ND 4.0": "cc-by-nd",
        "Licensed under the MPL License": "mpl",
        "released under the ISC license": "isc",
        "released under the BSL license": "",
        "Licensed under the BSD License": "bsd",
        "unlicensed under the mit licenses": "",
        "licensed under the limit license": "",
        "the licensed under": "",
        "(see the Mozila Public License, version 2)": "mpl",
        "Licensed under CC BY-NC-SA 4.0": "cc-by-nc-sa",
        "licensed under CC BY-NC-ND": "cc-by-nc-nd",
        "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International": "cc-by-nc-sa",
        "SPDX-License-Identifier: MIT": "mit",
        "SPDX-License-Identifer: (GPL-2.0-or-later OR BSD-3-Clause) AND Zlib\nint x;": "bsd,gpl,zlib",
        "SPDX-License-Identifier: CC-BY-NC-SA-4.0 OR CC-BY-4.0": "cc-by,cc-by-nc-sa",
        "SPDX-License-Identifier: Permit": "",
        "licensed under the Apache 2.0 license": "apache",
        "Licenced under the Apache Licence": "apache",
        "under the terms of the MIT or Apache license": "apache,mit",
        "under the terms of the MIT, BSD 3-Clause and/or GPLv3 licenses": "bsd,gpl,mit",
        "distributed under the BSD 2-Clause License": "bsd",
        "available under the MIT, BSD 3-Clause and/or GPLv3 license": "bsd,gpl,mit",
        "released under the GNU Lesser General Public Licence": "lgpl",
        "licensed under the 2.0 license": "",
        "the driver is licensed under the law of Apache county, and has a license": "",
    }
    rows = licenses.license_scan(spark.createDataFrame(rows_of(told), SCHEMA)).orderBy("doc_id").collect()
    assert [r["labels"] for r in rows] == list(told.values())
    assert [s["edits"] for s in rows[0]["spans"]] == [1] and (rows[0]["spans"][0]["first_word"], rows[0]["spans"][0]["last_word"]) == (0, 4)
    assert all(0 <= r["score"] <= 1 and (r["score"] > 0) == (r["labels"] != "") for r in rows)
    halves = licenses.license_scan(spark.createDataFrame(rows_of(["licensed under the", "mit license", "licensed under the mit", "license"]), SCHEMA)).orderBy("doc_id").collect()
    assert [len(r["spans"]) for r in halves] == [0, 0, 0, 0]


# ---- quality


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    scores = quality.quality_scores(docs, labels.where("doc_id % 2 = 0"))
    held = scores.join(labels.where("doc_id % 2 = 1").groupBy("doc_id").agg(F.first("quality").alias("quality")), "doc_id").collect()
    assert sum(r["kept"] == (r["quality"] == 1) for r in held) / len(held) > 0.93
    good = [r for r in held if r["quality"] == 1]
    assert sum(r["kept"] for r in good) / len(good) > 0.97


def plain_features(r, hashed):
    """The features of one row, told by plain loops."""
    text = r["text"] or ""
    raw, words = text.encode(), [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    share = lambda x, of: sum(s < x / max(of, 1) for s in quality._SHARES)
    log = lambda x, step=1.0: min(int(np.log2(max(x, 0) + 1) / step), quality.BINS - 1)
    keys = [low(w.decode()) for w in words]
    lines = raw.split(b"\n")
    marks = set(range(0x21, 0x7F)) - {*b"0123456789.,;:'\"?-()"} - {*range(65, 91), *range(97, 123)}
    found = {
        "upper": share(sum(65 <= b <= 90 for b in raw), sum(65 <= (b & 0xDF) <= 90 and b < 128 for b in raw)),
        "symbols": share(sum(b in marks for b in raw), len(raw)),
        "stutter": share(max(sum(a == b for a, b in zip(keys, keys[1:])) - 1, 0), len(keys)),
        "top_word": share(max(max(collections.Counter(keys).values(), default=0) - 3, 0), len(keys)),
        "word_bytes": log(sum(map(len, words)) / max(len(words), 1), 0.5),
        "digits": share(sum(48 <= b <= 57 for b in raw), len(raw)),
        "lines": log(len(lines)),
        "line_bytes": log(len(raw) / len(lines), 0.5),
        "longest_line": log(max(map(len, lines)), 0.5),
        "source": hashed[r["source"] or ""],
        "lang": hashed[r["lang"] or ""],
        "size": min(int(2 * np.log2(max(r["n_chars"] or 0, 0) + 1)), quality.BINS - 1),
    }
    bins = set()
    for word in words:
        data = np.frombuffer(word, np.uint8)
        bins.add(int(textkernel.word_hashes(data, np.array([0, len(word)]), textkernel.NON_SPACE)[0][0]) >> (64 - quality.WORD_BITS))
        if len(word) >= 3:
            for tag, three in ((1, word[:3]), (2, word[-3:])):
                code = np.array([int.from_bytes(three, "little") | tag << 24], np.uint64)
                bins.add(1 << quality.WORD_BITS | int(textkernel.mix(code)[0]) >> (64 - quality.WORD_BITS))
    return found | {"words": sorted(bins)}


def plain_co_training(rows, label, held):
    """(p_content, p_metadata, score) of each row by one machine's loops; label and held by row."""
    span, views, fine = quality.View.SPAN, quality.VIEWS, quality.View.FINE
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    free = [i for i, y in enumerate(label) if y < 0]

    def place(v, odds, f, many=1):
        raw = sum(odds[n][f[n]] for n in views[v] if n != "words") + (sum(odds["words"][w] for w in f["words"]) / max(len(f["words"]), 1) ** 0.5 if "words" in views[v] else 0.0)
        return int((min(max(raw, 0.5 - span), span - 0.5) + span) * many)

    def picks(v, odds, many, y):
        """The unlabelled rows that view v calls y: whole places from the outside in."""
        groups = collections.defaultdict(list)
        for i in free:
            groups[place(v, odds, rows[i], fine)].append(i)
        found = []
        for k in sorted(groups, reverse=y == 1):
            if found and len(found) + len(groups[k]) > many:
                break
            found += groups[k]
        return {i: min(1.0, many / len(found)) for i in found} if 2 * len(found) <= len(free) else {}

    def trained(v, told, weight):
        odds = {}
        for name in views[v]:
            counts = np.zeros((2, quality.WORD_BINS if name == "words" else quality.BINS))
            for f, y in zip(rows, told):
                for b in f[name] if name == "words" else [f[name]]:
                    counts[:, b] += y
            counts += (quality.WORD_SMOOTHING if name == "words" else quality.SMOOTHING) * weight[:, None]
            odds[name] = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
        seen = [(place(v, odds, f), y) for f, y, h in zip(rows, label, held) if h]
        good, bad = sum(y for _, y in seen), sum(1 - y for _, y in seen)
        aims = [(k - span + 0.5, (good + 1) / (good + 2) if y else 1 / (bad + 2)) for k, y in seen]
        slope, shift = 0.0, np.log((good + 1) / (bad + 1))
        for _ in range(50):
            g, c = np.array([-quality.RIDGE * slope, 0.0]), np.array([[quality.RIDGE, 0.0], [0.0, 1e-9]])
            for x, aim in aims:
                p = sigmoid(np.clip(slope * x + shift, -40, 40))
                g += np.array([x, 1]) * (aim - p)
                c += p * (1 - p) * np.array([[x * x, x], [x, 1]])
            slope, shift = np.array([slope, shift]) + np.linalg.solve(c, g)
        curve = [min(max(max(slope, 0.0) * (k - span + 0.5) + shift, -quality.LIMIT), quality.LIMIT) for k in range(2 * span)]
        losses = [-np.log(sigmoid(curve[k] if y else -curve[k])) for k, y in seen] or [0.0]
        return odds, curve, np.mean(losses), np.std(losses) / len(losses) ** 0.5

    known = [np.array([y == 0, y == 1]) * float(not h) for y, h in zip(label, held)]
    prior = sum(known) + 1.0
    weight = prior / prior.sum()
    now = [trained(v, known, weight) for v in range(2)]
    bounds, asking = [m[2] + m[3] for m in now], [True, True]
    share = np.mean([y for y, h in zip(label, held) if h] or [0.0])
    trust = [max(0.0, 1 - m[2] / -(share * np.log(share) + (1 - share) * np.log(1 - share))) if 0 < share < 1 else 0.0 for m in now]
    for turn in range(1, quality.ROUNDS):
        new = list(now)
        for v in range(2):
            teacher = now[1 - v][0]
            bad, good = (picks(1 - v, teacher, quality.EXCHANGED * turn * weight[y] * len(free), y) for y in (0, 1))
            asking[v] = asking[v] and trust[1 - v] > 0 and bool(bad or good)
            if asking[v]:
                told = list(known)
                for i, part in (bad | good).items():
                    p = sigmoid(now[1 - v][1][place(1 - v, teacher, rows[i])])
                    told[i] = np.round(quality.WHOLE * trust[1 - v] * part * np.array([1 - p, p])) / quality.WHOLE
                model = trained(v, told, weight)
                asking[v] = model[2] <= bounds[v]
                new[v] = model if asking[v] else now[v]
        now = new
    curves = [m[1] for m in now]
    place_of = lambda v, f: place(v, now[v][0], f)
    out = []
    for f in rows:
        one, two = (curves[v][place_of(v, f)] for v in range(2))
        out.append((sigmoid(one), sigmoid(two), sigmoid(one + two - np.log(prior[1] / prior[0]))))
    return out


def test_quality_equals_a_plain_version(docs, spark, data, awkward):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    same = docs.where("doc_id < 150").unionByName(awkward.select(*docs.columns).where("length(text) < 20000 OR text IS NULL"))
    rows = same.withColumn("h", F.xxhash64(F.lit("held out"), "doc_id") % quality.HELD_OUT == 0).withColumn("s", F.pmod(F.xxhash64(F.coalesce("source", F.lit(""))), F.lit(quality.BINS))).withColumn("l", F.pmod(F.xxhash64(F.coalesce("lang", F.lit(""))), F.lit(quality.BINS))).collect()
    hashed = {r["source"] or "": r["s"] for r in rows} | {r["lang"] or "": r["l"] for r in rows}
    told = {r["doc_id"]: r["quality"] for r in labels.collect()}
    label = [told.get(r["doc_id"], -1) for r in rows]
    wanted = plain_co_training([plain_features(r, hashed) for r in rows], label, [r["h"] and y >= 0 for r, y in zip(rows, label)])
    got = sorted(map(tuple, quality.quality_scores(same, labels).drop("kept").collect()), key=str)
    wanted = sorted([(r["doc_id"], *w) for r, w in zip(rows, wanted)], key=str)
    assert [g[0] for g in got] == [w[0] for w in wanted]
    assert all(g[1:] == pytest.approx(w[1:], abs=1e-6) for g, w in zip(sorted(got, key=lambda g: (g[0] is None, g)), sorted(wanted, key=lambda g: (g[0] is None, g))))


def test_views_teach_each_other(spark, monkeypatch):
    """Either view labels documents for the other and is kept to; scores change by it and are no worse on held-out documents than without."""
    folder, seen = "/root/testdata/sf0.01", []
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    plain = quality.co_train
    monkeypatch.setattr(quality, "co_train", lambda table, *a: seen.append((table, plain(table, *a))) or seen[-1][1])
    found = [{r["doc_id"]: r for r in quality.quality_scores(docs, labels, rounds=n).collect()} for n in (1, quality.ROUNDS)]
    assert not seen[0][1][3]
    said = seen[1][1][3]
    for teacher in ("content", "metadata"):
        assert any(x.kept and x.bad + x.good > 0 for x in said if x.teacher == teacher), said
    assert any(x.bad for x in said) and any(x.good for x in said)
    for column in ("p_content", "p_metadata"):
        assert any(abs(found[0][i][column] - found[1][i][column]) > 1e-6 for i in found[0])
    held = [(r["id"], r["label"]) for r in seen[1][0].where("held").collect()]
    loss = [np.array([-np.log(max(f[i]["score"] if y else 1 - f[i]["score"], 1e-9)) for i, y in held]) for f in found]
    assert loss[1].mean() <= loss[0].mean() + loss[0].std() / len(held) ** 0.5


def test_batches_may_be_counted_in_slices(docs, spark, data, monkeypatch):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    whole = sorted(map(tuple, quality.quality_scores(docs, labels).collect()))
    monkeypatch.setattr(quality, "SLICE_ROWS", 7)
    assert sorted(map(tuple, quality.quality_scores(docs, labels).collect())) == whole


def test_picks_are_whole_places_from_either_end():
    pool = np.array([0, 3, 0, 5, 80, 6, 4, 2, 0])
    assert quality.picks_of(pool, 0.5, 0.2) == quality.Picks(3, 6, (8, 6), (1.0, 1.0))
    assert quality.picks_of(pool, 0.02, 0.5) == quality.Picks(2, 7, (3, 2), (1 / 3, 0.5))
    for pool in (np.array([0, 9, 0]), np.zeros(3, int)):
        assert quality.picks_of(pool, 0.5, 0.5) == quality.Picks(-1, 3, (0, 0), (0.0, 0.0))


def test_quality_of_awkward_rows(awkward, spark):
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, 0), (None, 1, 0), (9, None, None)], "doc_id long, quality int, toxic int")
    rows = quality.quality_scores(awkward, labels).collect()
    assert len(rows) == awkward.count() and all(0 <= r["score"] <= 1 for r in rows)
    rows = quality.quality_scores(awkward, labels.limit(0)).collect()
    assert all(r["score"] == 0.5 and r["kept"] for r in rows)


def test_good_documents_are_judged_row_by_row(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    kept = {r["doc_id"]: r["kept"] for r in quality.quality_scores(docs, labels).collect()}
    assert {r["doc_id"] for r in quality.good_documents(docs, labels).collect()} == {i for i, k in kept.items() if k}
    bad = next(i for i, k in kept.items() if not k)
    # Rows without an id, and a good row under a rejected row's id; a column with one of the operator's names.
    more = docs.where(F.col("doc_id") == bad).withColumn("doc_id", F.lit(None).cast("long")).unionByName(docs.where(F.col("doc_id") == min(i for i, k in kept.items() if k)).withColumn("doc_id", F.lit(bad).cast(docs.schema["doc_id"].dataType)))
    every = docs.unionByName(more).withColumn("words", F.lit("w")).withColumn("score", F.lit(0.5))
    left = quality.good_documents(every, labels)
    assert left.columns == every.columns
    ids = [r["doc_id"] for r in left.collect()]
    assert None not in ids and ids.count(bad) == 1


# ---- mixing


def test_targets_and_takes(awkward, docs):
    for df in (docs, awkward):
        rows = mixing.mixed_sources(df).collect()
        sizes = collections.Counter((r["doc_id"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in df.collect())
        assert collections.Counter((r["doc_id"], r["size"]) for r in rows) == sizes
        assert all(r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"]) for r in rows)
        source = {r["doc_id"]: r["source"] for r in df.collect()}
        total = collections.Counter()
        for r in rows:
            total[source[r["doc_id"]]] += r["size"]
        names = sorted(total, key=lambda s: (s is None, s))
        weights, caps = {s: i % 3 + 1 for i, s in enumerate(names)}, {s: 3.0 * total[s] for s in names}
        target, open_ = dict.fromkeys(names, 0.0), set(names)
        left = float(sum(total.values()))
        while left > 1e-9 and open_:
            share = {s: left * weights[s] / sum(weights[o] for o in open_) for s in open_}
            left = 0.0
            for s, x in share.items():
                target[s] += x
            for s in list(open_):
                if target[s] > caps[s]:
                    left += target[s] - caps[s]
                    target[s] = caps[s]
                    open_.discard(s)
        taken = collections.Counter()
        for r in rows:
            taken[source[r["doc_id"]]] += r["taken"]
            assert r["target"] == pytest.approx(target[source[r["doc_id"]]]) and r["source_size"] == total[source[r["doc_id"]]]
        if df is docs:
            assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] + 1 for s in names)
        assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mixed_sources(df).collect()), key=str)


def test_mixed_documents_repeat_whole_rows(docs):
    taken = {r["doc_id"]: r["taken"] // max(r["size"], 1) for r in mixing.mixed_sources(docs).collect()}
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert collections.Counter(r["doc_id"] for r in mixed.collect()) == collections.Counter({i: n for i, n in taken.items() if n})


def test_mixed_documents_of_awkward_rows(awkward, spark):
    # Other column names, names of the operator's own, repeated and missing ids.
    df = awkward.withColumnRenamed("text", "body").withColumnRenamed("source", "host").withColumn("copies", F.lit(1)).withColumn("row", F.lit("r")).withColumn("sharers", F.lit(2)).withColumn("name", F.lit("n"))
    mixed = mixing.mixed_documents(df, text_col="body", source_col="host")
    assert mixed.columns == df.columns
    total = lambda d: collections.Counter((r["doc_id"], r["host"], r["words"]) for r in d.select("doc_id", "host", F.regexp_count("body", F.lit(mixing.WORD)).alias("words")).collect())
    rows = mixing.mixed_sources(df, text_col="body", source_col="host").join(df.select("doc_id", "host").distinct(), "doc_id").collect()
    wanted = collections.Counter()
    for r in rows:
        wanted[r["doc_id"], r["host"], r["size"]] += r["taken"] // max(r["size"], 1)
    got = total(mixed)
    assert all(got[k] == n for k, n in wanted.items() if n) and all(k in wanted or k[0] is None for k in got)
    twice = spark.createDataFrame([(1, "a b c", "s")] * 2 + [(2, "d e f g", "t"), (3, "h i j k l", "u")] * 3, "doc_id long, text string, source string")
    copies = collections.Counter(r["doc_id"] for r in mixing.mixed_documents(twice).collect())
    taken = collections.Counter()
    for r in mixing.mixed_sources(twice).collect():
        taken[r["doc_id"]] += r["taken"] // r["size"]
    assert copies == +taken


def test_many_sources_share_by_weight(spark):
    rows = [(i, " ".join(["w"] * (i % 13 + 1)), f"host{i % 400:03}") for i in range(2_000)]
    got = mixing.source_targets(spark.createDataFrame(rows, "doc_id long, text string, source string").groupBy("source").agg(F.sum(F.regexp_count("text", F.lit("w")).cast("long")).alias("source_size"))).collect()
    sizes = {r["source"]: r["source_size"] for r in got}
    names, left = sorted(sizes), float(sum(sizes.values()))
    weights, target, open_ = {s: i % 3 + 1 for i, s in enumerate(names)}, dict.fromkeys(names, 0.0), set(names)
    while left > 1e-6 and open_:
        share = {s: left * weights[s] / sum(weights[o] for o in open_) for s in open_}
        left = 0.0
        for s, x in share.items():
            target[s] += x
            if target[s] > 3 * sizes[s]:
                left += target[s] - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
                open_.discard(s)
    assert all(r["target"] == pytest.approx(target[r["source"]]) for r in got)


# ---- shards


def brute_shards(df, shards, seed=17):
    """(id, crc32, shard, slot), from one sorted list."""
    rows = [(r["doc_id"], r["source"], r["key"], zlib.crc32(t := (r["text"] or "").encode()), len(t) + 16) for r in df.withColumn("key", F.xxhash64(F.lit(seed), "doc_id")).collect()]
    low = lambda x: (x is not None, x or 0)
    sources = collections.defaultdict(list)
    for r in rows:
        sources[r[1]].append(r)
    line = []
    for source, group in sources.items():
        group.sort(key=lambda r: (r[2], low(r[0]), r[3], r[4]))
        line += [((2 * k + 1) / (2 * len(group)), source is None, source or "", r[2], low(r[0]), r[3], r[4], r[0]) for k, r in enumerate(group)]
    line.sort()
    at, out = 0, []
    cuts = [k for k in range(len(line)) if k == 0 or k * shards // len(line) != (k - 1) * shards // len(line)]
    for k, r in enumerate(line):
        at = 0 if k in cuts else at + 1
        out.append((r[-1], r[5], k * shards // len(line), at))
    return out


@pytest.mark.parametrize("shards", [7, 40])
def test_shards(docs, awkward, shards):
    for df in (docs, awkward):
        rows = sharding.interleaved_shards(df, shards).collect()
        want = collections.Counter((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in df.collect())
        assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
        slots = collections.defaultdict(list)
        for r in rows:
            slots[r["shard"]].append(r["slot"])
            assert r["law"] == "rows" and r["grown_shard"] is None
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        counts = [len(slots.get(k, [])) for k in range(shards)]
        assert max(counts) - min(counts) <= 1
        assert sorted(((r["doc_id"], r["text_crc32"], r["shard"], r["slot"]) for r in rows), key=str) == sorted(brute_shards(df, shards), key=str)
    by_source = collections.Counter((r["shard"], r["source"]) for r in sharding.interleaved_shards(docs, 4).collect())
    per = collections.Counter(r["source"] for r in docs.collect())
    assert all(abs(by_source[k, s] - n / 4) <= 2 for s, n in per.items() for k in range(4))


def test_ranks_over_many_hash_ranges(docs, awkward, monkeypatch):
    wanted = sorted(map(tuple, mixing.mixed_sources(docs).collect()))
    monkeypatch.setattr(tables, "RANGE_ROWS", 3)
    monkeypatch.setattr(tables, "STRETCH_BITS", 2)
    for df in (docs, awkward):
        rows = sharding.interleaved_shards(df, 7).collect()
        assert sorted(((r["doc_id"], r["text_crc32"], r["shard"], r["slot"]) for r in rows), key=str) == sorted(brute_shards(df, 7), key=str)
    assert sorted(map(tuple, mixing.mixed_sources(docs).collect())) == wanted


def test_single_row_sources_share_no_task(spark, monkeypatch):
    written = {}
    write = order.Workspace.write
    monkeypatch.setattr(order.Workspace, "write", lambda self, df, name, *a, **k: written.setdefault(name, write(self, df, name, *a, **k)))
    df = spark.range(8_000).select(F.col("id").alias("doc_id"), F.lit("a text").alias("text"), F.concat(F.lit("domain"), "id").alias("source"))
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = sharding.interleaved_shards(df, 7).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    assert len({(r["shard"], r["slot"]) for r in rows}) == 8_000
    tasks = [r["count"] for r in written["ranged"].groupBy("_range").count().collect()]
    assert len(tasks) > 1 and max(tasks) < 4_000


# ---- chat

MESSAGES = "conv_id long, turn long, role string, text string"


def brute_replies(rows):
    """Parent turns, told by plain loops over passages and windows."""

    def passages(text):
        out = []
        for line in (text or "").split("\n"):
            prefix = re.match(r"[ \t>]*", line)[0]
            level = prefix.count(">")
            words = re.sub(r"[\x20\x09-\x0D\x01\x02]+", " ", (line[len(prefix) :] if level else line).lower()).split(" ")
            if not out or out[-1][0] != level:
                out.append((level, []))
            out[-1][1].extend(w for w in words if w)
        return out

    parents, asked = {}, collections.defaultdict(list)
    for conv, turn, _, text in rows:
        for level, words in passages(text):
            n = min(5, len(words))
            if level and n:
                asked[conv, turn] += [(level, tuple(words[i : i + n])) for i in range(len(words) - n + 1)]
    for (conv, turn), windows in asked.items():
        votes = collections.Counter()
        for level, window in windows:
            said = [t for c, t, _, text in rows if c == conv and t is not None for lv, words in passages(text) if not lv for i in range(len(words) - len(window) + 1) if tuple(words[i : i + len(window)]) == window]
            if turn is not None and said and min(said) < turn:
                votes[level, min(said)] += 1
        parents[conv, turn] = max(votes, key=lambda v: (-v[0], votes[v], v[1]))[1] if votes else None
    return parents


def test_quotes_link_and_go(spark):
    rows = [
        (1, 0, "a", "Hello all.\nHow does it work? I would really like to know how the engine is started today\n\n\n\nBye"),
        (1, 1, "b", "On Monday a wrote:\n> Hello all.\n> how does  it\n> work? I would really like to know how\n> the engine is started\nIt works well."),
        (1, 2, "c", "Unrelated"),
        (1, 3, "a", "b wrote:\n>> how does it work? I would really\n>> like to know\n> It works well.\nThanks"),
        (1, 4, "d", "> Unrelated\nok"),
        (1, 5, None, "> nobody said this\nx"),
        (2, 0, "u", "> Hello all.\nhm"),
        (2, 0, "u", "> Hello all.\nhm"),
        (None, 0, "a", "hello there\r\n"),
        (None, 1, "b", "> hello there\nyes"),
        (None, None, "b", ""),
        (None, None, "b", "> hello there\nno"),
        (None, 2, "b", None),
    ]
    df = spark.createDataFrame(rows, MESSAGES).withColumn("own", F.lit("extra")).withColumn("passages", F.lit(1)).withColumn("range", F.lit(2)).withColumn("_raw", F.lit(None).cast("string"))
    out = {(r["conv_id"], r["position"]): r for r in chat.reply_ordered(df).collect()}
    assert [out[1, k]["turn"] for k in range(6)] == [0, 1, 3, 2, 4, 5]
    assert [out[1, k]["parent_turn"] for k in range(6)] == [None, 0, 1, None, 2, None]
    assert out[1, 0]["text"].endswith("today\n\nBye") and out[1, 1]["text"] == "It works well." and out[1, 5]["formatted"] == "<|unknown|>\nx\n"
    assert out[2, 1]["text"] == "hm" and out[None, 1]["text"] == "no" and out[None, 3]["parent_turn"] == 0
    wanted = brute_replies(rows)
    assert all(r["parent_turn"] == wanted.get((r["conv_id"], r["turn"])) for r in out.values())


def test_random_rewrapped_quotes(spark):
    rnd = np.random.default_rng(11)
    rows = []
    for conv in range(6):
        texts = []
        for turn in range(12):
            own = [f"w{x}" for x in rnd.integers(0, 30, rnd.integers(1, 25))]
            lines = []
            for level in (2, 1):
                if texts and rnd.random() < 0.6:
                    words = texts[rnd.integers(0, len(texts))]
                    lo = rnd.integers(0, len(words))
                    cut, width = words[lo : lo + rnd.integers(1, 20)], int(rnd.integers(1, 6))
                    lines += ["> " * level + " ".join(cut[i : i + width]) for i in range(0, len(cut), width)]
            texts.append(own)
            rows.append((conv, turn, "r", "\n".join(lines + [" ".join(own)])))
    wanted = brute_replies(rows)
    got = chat.reply_ordered(spark.createDataFrame(rows, MESSAGES)).collect()
    assert all(r["parent_turn"] == wanted.get((r["conv_id"], r["turn"])) for r in got) and sum(r["parent_turn"] is not None for r in got) > 20


def test_very_long_messages(spark):
    n = 200_000
    rows = [(1, 0, "a", ">" * n), (1, 1, "a", "\n" * n), (1, 2, "a", "wrote " * n), (1, 3, "a", "> \n" * n + "x"), (1, 4, "b", "x y z " * n), (1, 5, "b", "> x y z x y z\nq"), (1, 6, "b", "\n \r" * n + " wrote:" * n)]
    out = {r["turn"]: r for r in chat.reply_ordered(spark.createDataFrame(rows, MESSAGES)).collect()}
    assert out[5]["parent_turn"] == 4 and out[1]["text"] == "" and out[3]["text"] == "x" and out[3]["quoted_lines"] == n


# ---- empty tables


def test_empty_tables(spark, nothing):
    items = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert tokens.token_counts(nothing, BPE).count() == 0
    assert token_store.token_digest(nothing, BPE).count() == 0
    assert exact_dedup.exact_duplicates(nothing).count() == 0
    assert ngram_join.ngram_classes(nothing).count() == 0
    assert decontaminate.contaminations(nothing, items).count() == 0
    assert licenses.license_scan(nothing).count() == 0
    assert quality.quality_scores(nothing, labels).count() == 0
    assert mixing.mixed_sources(nothing).count() == 0
    assert sharding.interleaved_shards(nothing, 5).count() == 0
    assert chat.reply_ordered(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_empty_benchmark_leaves_all(awkward, spark):
    items = spark.createDataFrame([(1, None), (2, ""), (3, " -- ")], "item_id long, text string")
    assert decontaminate.decontaminated(awkward, items).count() == awkward.count()
