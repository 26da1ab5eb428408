import numpy as np
import pytest

from cladeworks.llm import suffix_array as suffix_array_module
from cladeworks.llm.fm_index import FMIndex
from cladeworks.llm.suffix_array import common_prefixes, suffix_array

TEXTS = ["banana", "a", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "abcabcabcabdabcabc" * 9, "mississippi"]


@pytest.mark.parametrize("text", TEXTS)
def test_order_and_prefixes(text):
    s = np.frombuffer(text.encode(), np.uint8).astype(np.int64)
    sa, rank = suffix_array(s)
    assert sa.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    assert (sa[rank] == np.arange(len(s))).all()
    lcp = common_prefixes(s, sa, cap=1000, stride=4)
    for k in range(1, len(sa)):
        a, b, n = text[sa[k - 1] :], text[sa[k] :], 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        assert lcp[k] == n


def test_random_texts():
    rng = np.random.default_rng(1)
    for _ in range(40):
        s = rng.integers(0, 3, rng.integers(1, 300))
        sa, _ = suffix_array(s)
        assert sa.tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def test_depth_leaves_equal_contexts_together():
    s = np.frombuffer(b"abcdefgh" * 30, np.uint8).astype(np.int64)
    sa, rank = suffix_array(s, depth=8)
    starts = [bytes(s[i : i + 8].astype(np.uint8)) for i in sa]
    assert starts == sorted(starts)


def test_fm_index_counts_and_locates():
    rng = np.random.default_rng(2)
    text = rng.integers(1, 6, 500)
    index = FMIndex(text, sample=7)
    phrases = np.zeros((60, 4), np.int64)
    lengths = rng.integers(1, 5, 60)
    for i, n in enumerate(lengths):
        phrases[i, 4 - n :] = rng.integers(1, 8, n)
    lo, hi = index.search(phrases, lengths)
    for p, n, a, b in zip(phrases, lengths, lo, hi, strict=True):
        want = [i for i in range(len(text) - n + 1) if (text[i : i + n] == p[4 - n :]).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


@pytest.mark.parametrize("rows", [1 << 17, 4])
def test_depth_is_exact_and_prefixes_hold_in_its_order(rows, monkeypatch):
    """Repeats longer than the depth stay tied; Kasai's bound is not carried past them."""
    monkeypatch.setattr(suffix_array_module, "SORT_ROWS", rows)
    rng = np.random.default_rng(3)
    for symbols, depth in ((2, 11), (4, 20), (300, 13), (60_000, 5)):
        part = rng.integers(0, symbols, 60)
        s = np.concatenate([part, rng.integers(0, symbols, 40), part[:45], part[5:], np.zeros(50, np.int64), part])
        sa, rank = suffix_array(s, depth)
        starts = [s[i : i + depth].tolist() for i in range(len(s))]
        assert [starts[i] for i in sa] == sorted(starts)
        assert all((rank[sa[k]] == rank[sa[k - 1]]) == (starts[sa[k]] == starts[sa[k - 1]]) for k in range(1, len(s)))
        assert all(sa[k] > sa[k - 1] for k in range(1, len(s)) if rank[sa[k]] == rank[sa[k - 1]])
        lcp = common_prefixes(s, sa, depth, stride=7, rank=rank)
        for k in range(1, len(s)):
            a, b, n = starts[sa[k - 1]], starts[sa[k]], 0
            while n < min(len(a), len(b)) and a[n] == b[n]:
                n += 1
            assert lcp[k] == n


def test_a_refinement_is_stable_where_numbers_do_not_fit():
    rng = np.random.default_rng(4)
    group, follow = np.sort(rng.integers(0, 9, 500)), rng.integers(-1, 6, 500)
    first = np.append(True, np.diff(group) != 0)
    want = np.lexsort((follow, group))
    for n in (6, 1 << 58):
        order, new = suffix_array_module.refined(first, follow, n)
        assert (order == want).all()
        assert (new == np.append(True, (np.diff(group[want]) != 0) | (np.diff(follow[want]) != 0))).all()
