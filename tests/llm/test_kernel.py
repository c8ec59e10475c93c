import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspar.llm import textkernel as tk
from quillspar.llm import tokens, wavelet
from quillspar.llm.mixing import fit_budget, fit_sums, plan_source

TEXTS = st.lists(st.text(alphabet="abAB \t\n.,'é漢|9", max_size=40), max_size=8)


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_pattern(texts):
    for inside, pattern in ((tk.NON_SPACE, r"[^\x20\x09-\x0D]+"), (tk.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        got, hashes = [], {}
        for _, _, data, offsets in tk.chunks(pa.array(texts, pa.string())):
            found, firsts = tk.word_hashes(data, offsets, inside)
            got += [found[a:b].tolist() for a, b in zip(firsts[:-1], firsts[1:])]
        for text, found in zip(texts, got):
            words = re.findall(pattern, low(text))
            assert len(words) == len(found)
            for word, h in zip(words, found):
                assert hashes.setdefault(word, h) == h
        assert len(set(hashes.values())) == len(hashes)


def test_long_rows_are_hashed_piece_by_piece_alike(monkeypatch):
    text = " ".join(f"word{i % 977}" for i in range(5000))
    (_, _, data, offsets), = tk.chunks(pa.array([text]))
    whole, firsts = tk.word_hashes(data, offsets, tk.NON_SPACE)
    monkeypatch.setattr(tk, "CHUNK_BYTES", 100)
    pieces, again = tk.word_hashes(data, offsets, tk.NON_SPACE)
    assert (whole == pieces).all() and (firsts == again).all()


def test_words_that_a_polynomial_would_confuse():
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    words = [a, a.translate(str.maketrans("ab", "ba")), a[:-1], "\0" * 8, "\0" * 16, "a", "a\0", "abcdefgh" * 2, "abcdefgh"]
    (_, _, data, offsets), = tk.chunks(pa.array(words))
    assert len(set(tk.word_hashes(data, offsets, tk.NON_SPACE)[0].tolist())) == len(words)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_shingles(texts):
    seen = {}
    for _, _, data, offsets in tk.chunks(pa.array(texts, pa.string())):
        for text, found in zip(texts, tk.shingles(*tk.word_hashes(data, offsets, tk.NON_SPACE))):
            words = re.findall(r"[^\x20\x09-\x0D]+", low(text))
            sets = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()
            assert len(sets) == len(found)
            assert seen.setdefault(frozenset(sets), found.tolist()) == found.tolist()


@pytest.mark.parametrize(("n", "letters"), [(0, 3), (1, 1), (9, 2), (1000, 40), (3000, 700)])
def test_wavelet_matrix(n, letters):
    ids = (np.random.default_rng(n).integers(0, letters, n) * 13).astype(np.uint32)
    blob = wavelet.build(ids)
    matrix = wavelet.WaveletMatrix(blob)
    assert (matrix.ids() == ids).all() and matrix.n == n
    for i in range(0, n, 17):
        assert matrix.access(i) == ids[i]
    for token in {*ids[:15].tolist(), 1}:
        where = np.flatnonzero(ids == token).tolist()
        assert matrix.occurrences(token) == where and matrix.count(token) == len(where)
        assert matrix.count(token, n // 4, n // 2) == sum(n // 4 <= w < n // 2 for w in where)
    with pytest.raises(IndexError):
        matrix.access(n)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), max_size=6), st.integers(0, 90))
def test_budget_is_met_as_well_as_can_be(counts, budget):
    lengths = np.array(sorted(counts), np.int64)
    amounts = np.array([counts[x] for x in lengths.tolist()], np.int64)
    take = fit_budget(lengths, amounts, budget)
    sums = {0}
    for length, n in counts.items():
        sums = {s + k * length for s in sums for k in range(n + 1)}
    assert (take <= amounts).all() and int((take * lengths).sum()) == max(s for s in sums if s <= budget)


def test_plan_never_repeats_a_document_too_often():
    lengths, counts = np.array([0, 3, 7, 50_000]), np.array([5, 10, 4, 3])
    total = int((lengths * counts).sum())
    for target in (0, 1, total // 2, total, 2 * total + 11, 3 * total):
        passes, extra = plan_source(lengths, counts, target)
        assert (extra >= 0).all() and (passes * counts + extra <= 3 * counts).all()
        got = passes * total + int((lengths * extra).sum())
        assert got <= target and target - got < 50_000


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), max_size=5), st.integers(0, 90))
def test_listed_sums_equal_the_table(counts, budget):
    lengths = np.array(sorted(counts), np.int64)
    amounts = np.array([counts[x] for x in lengths.tolist()], np.int64)
    take = fit_sums(lengths, amounts, budget)
    assert (take <= amounts).all() and int((take * lengths).sum()) == int((fit_budget(lengths, amounts, budget) * lengths).sum())
    rough = fit_sums(lengths, amounts, budget, most=8)
    assert (rough <= amounts).all() and int((rough * lengths).sum()) <= budget


def test_long_documents_are_fitted_as_short_ones():
    for scale in (1, 10, 1_000):
        lengths = np.array([5_000, 6_000, 7_000]) * scale
        passes, extra = plan_source(lengths, np.array([1, 1, 1]), 15_000 * scale)
        assert int(((passes + extra) * lengths).sum()) == 15_000 * scale and (passes + extra <= 3).all()


def test_coarse_part_is_drawn_from_all_lengths():
    lengths = np.arange(1_000, 3_000)
    counts = np.ones(len(lengths), np.int64)
    target = int(lengths.sum()) // 3
    passes, extra = plan_source(lengths, counts, target)
    assert passes == 0 and int((lengths * extra).sum()) == target
    quarters = extra.reshape(4, -1).mean(axis=1)
    assert (quarters > 0.2).all() and (quarters < 0.5).all()
    assert (extra != plan_source(lengths, counts, target, seed=30)[1]).any()


def test_special_strings_are_not_cut():
    assert not tokens._is_cut("<|endoftext|>") and tokens._is_cut("<|fim_prefix|>")
