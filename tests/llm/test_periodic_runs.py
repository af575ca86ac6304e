"""Periodic runs against a scan of every period; hash collisions, nulls, blank and long texts, clashing columns."""

import random

import numpy as np
import pytest

from graphloom.llm import periodic_runs as pr


def by_hand(words):
    found = {}
    n = len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q) and j > i:
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def shortened(words, runs):
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in dropped)


def texts(seed, count):
    rng = random.Random(seed)
    out = []
    for _ in range(count):
        k = rng.choice([1, 2, 3, 5, 50])
        words = []
        for _ in range(rng.randint(0, 6)):
            words += [str(rng.randrange(k)).encode() for _ in range(rng.randint(0, 30))]
            cycle = [str(rng.randrange(k)).encode() for _ in range(rng.choice([1, 2, 3, 7, 20, 33]))]
            words += (cycle * rng.randint(1, 9))[: rng.randint(1, 400)]
        out.append(words)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_random_texts(seed):
    words = texts(seed, 60)
    for w, got in zip(words, pr.find_runs(words), strict=True):
        assert [tuple(r) for r in got] == by_hand(w)
        assert pr.collapsed(w, got) == shortened(w, by_hand(w))


def test_blocks_longer_than_a_tile(monkeypatch):
    monkeypatch.setattr(pr, "MAX_BLOCK", 4)
    rng = random.Random(5)
    cycle = [str(rng.randrange(9)).encode() for _ in range(61)]
    words = [[b"x", *(cycle * 5)[:270], b"y"], [b"a"] * 500, [b"a", b"b"] * 40 + [b"c"] + [b"a", b"b"] * 9]
    for w, got in zip(words, pr.find_runs(words), strict=True):
        assert [tuple(r) for r in got] == by_hand(w)


def test_a_block_of_other_words_with_equal_hash_is_no_run(monkeypatch):
    monkeypatch.setattr(pr, "mix", lambda x: x & np.uint64(1))
    words = texts(9, 20)
    for w, got in zip(words, pr.find_runs(words), strict=True):
        assert {tuple(r) for r in got} <= set(by_hand(w))


@pytest.mark.parametrize("size", [2, 8, 64, 128, 4096])
def test_transform_correlates_exactly(size):
    rng = np.random.default_rng(size)
    block = size // 2
    a, b = rng.integers(0, 3, (2, size)).astype(float), rng.integers(0, 3, (2, block)).astype(float)
    ntt = pr.Transform(size)
    got = ntt.undo(pr.reduced(ntt(a) * ntt(b, mirrored=True)), block) % pr.MODULUS
    want = np.array([[(a[r, t : t + block] * b[r, : size - t]).sum() for t in range(block)] for r in range(2)])
    assert (got == want).all()


SCHEMA = "doc_id long, text string, runs string, words string, n_words int, collapsed string, document int"


def test_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a " * 5), (4, "a " * 6), (4, "a " * 6), (None, "é\u00a0ü x " * 8), (6, "to be or not " * 30000), (7, " ".join(map(str, range(50000))))]
    got = pr.periodic_runs(spark.createDataFrame([(i, t, "x", "y", 1, "z", 2) for i, t in rows], SCHEMA)).collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: (r.doc_id is None, r.doc_id))] == [1, 2, 3, 4, 4, 4, 6, 7, None]
    by_id = {r.doc_id: r for r in got if r.doc_id != 4}
    assert by_id[1].runs == [] and by_id[1].collapsed == "" and by_id[3].n_words == 0
    assert [tuple(x) for x in by_id[6].runs] == [(0, 120000, 4)] and by_id[6].collapsed == "to be or not"
    assert [tuple(x) for x in by_id[None].runs] == [(0, 16, 2)] and by_id[None].collapsed == "é\u00a0ü x"  # a no-break space is no white space
    assert by_id[7].runs == [] and len(by_id[7].collapsed.split()) == 50000
    assert sorted((len(r.runs), r.collapsed) for r in got if r.doc_id == 4) == [(0, "a a a a a"), (1, "a"), (1, "a")]


def test_empty_table(spark):
    got = pr.periodic_runs(spark.createDataFrame([], SCHEMA))
    assert got.columns == ["doc_id", "n_words", "runs", "collapsed"] and got.count() == 0
