"""Periodic runs against a plain comparison of every word with the one each period later."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tidegauge.llm import queries, runs


def plain(words, shortest=12):
    """Start, length and period of every run, by start and period."""
    found = {}
    words = np.array(words, dtype=object)
    for q in range(1, len(words) // 2 + 1):
        same = np.r_[False, words[:-q] == words[q:], False].astype(int)
        for start, end in np.flatnonzero(np.diff(same)).reshape(-1, 2).tolist():
            if end - start + q >= max(shortest, 2 * q):
                found.setdefault((start, end - start + q), q)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def kept(words, rows):
    gone = {i for s, n, q in rows for i in range(s + q, s + n)}
    return [x for i, x in enumerate(words) if i not in gone]


def rewritten(words, key):
    h, n = zlib.crc32(str(key).encode()), len(words)
    if key is None or h % 10 or not n:
        return words
    g = h // 10
    a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def hard(seed):
    """Few letters, Fibonacci words, powers of stretches with broken ends, nested periods."""
    r = random.Random(seed)
    kind, n = r.randrange(6), r.randrange(0, 240)
    if kind < 2:
        return [r.randrange(2 + kind) for _ in range(n)]
    if kind == 2:
        a, b = [0], [0, 1]
        while len(b) <= n:
            a, b = b, b + a
        return b[:n]
    if kind == 3:
        return [0] * n
    out = []
    while len(out) < n:
        base = [r.randrange(3) for _ in range(r.randrange(1, 40))] if kind == 4 else [0] * r.randrange(1, 30) + [1]
        power = base * r.randrange(1, 9)
        out += power[: len(power) - r.randrange(len(base))]
    return out


@pytest.mark.parametrize("block", range(8))
def test_hard_sequences(block):
    texts = [[str(x).encode() for x in hard(block * 40 + i)] for i in range(40)]
    for words, got in zip(texts, runs.of_texts(texts), strict=True):
        assert list(map(tuple, got.tolist())) == plain(words)
        assert runs.collapsed(words, got) == kept(words, plain(words))
    for words in texts[:10]:  # alone as beside others
        assert list(map(tuple, runs.of_texts([words])[0].tolist())) == plain(words)
    longer = runs.of_texts(texts, shortest=30)
    assert [len(x) for x in longer] == [len(plain(x, 30)) for x in texts]


def test_long_sequences_stay_in_proportion():
    n = 60_000
    assert runs.of_texts([[b"a"] * n])[0].tolist() == [[0, n, 1]]
    two = runs.of_texts([[b"a", b"b"] * n + [b"a"] * n])[0].tolist()
    assert two == [[0, 2 * n + 1, 2], [2 * n, n, 1]]
    with pytest.raises(ValueError):
        runs.find(np.arange(3), shortest=11)


def test_wavelet_tree_counts_and_picks():
    r = np.random.default_rng(3)
    for n in (1, 2, 5, 64, 1000):
        values = r.permutation(n)
        tree = runs.Wavelet(values)
        low = r.integers(0, n, 200)
        high = np.minimum(low + r.integers(1, n + 1, 200), n)
        x = r.integers(0, 2 * n + 2, 200)
        assert tree.below(low, high, x).tolist() == [(values[a:b] < y).sum() for a, b, y in zip(low, high, x, strict=True)]
        k = r.integers(0, high - low)
        assert tree.least(low, high, k).tolist() == [sorted(values[a:b])[j] for a, b, j in zip(low, high, k, strict=True)]


def test_nulls_repeated_rows_long_text_and_clashing_names(spark, odd_docs):
    rows = [(r["doc_id"], (r["text"] or "").encode().split()) for r in odd_docs.collect()]
    for tails in (False, True):
        want = Counter()
        for key, words in rows:
            words = rewritten(words, key) if tails else words
            found = plain(words) if len(words) < 1000 else list(map(tuple, runs.of_texts([words])[0].tolist()))
            want[key, tuple(found), b" ".join(kept(words, found)).decode()] += 1
        out = runs.runs(odd_docs, tails=tails)
        assert out.columns == ["doc_id", "runs", "collapsed"]
        assert Counter((r[0], tuple(map(tuple, r[1])), r[2]) for r in out.collect()) == want


def test_empty_table(spark, no_docs):
    assert runs.runs(no_docs).count() == 0


def test_query_on_whole_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op13_runs(spark, folder).collect()}
    some = 0
    for row in docs.collect():
        words = rewritten((row["text"] or "").encode().split(), row["doc_id"])
        found = plain(words) if len(words) < 6000 else list(map(tuple, runs.of_texts([words])[0].tolist()))
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
        head = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
        sums = [hashlib.sha256(x).hexdigest() for x in (b"".join(b"%d,%d,%d\n" % x for x in found), b" ".join(kept(words, found)))]
        assert got[row["doc_id"]] == (len(found), *head, *sums)
        some += bool(found)
    assert some > 5
