"""Texts without repeated passages against a plain count of windows."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from tidegauge.llm import queries, repeats


def plain(texts, window):
    """Per text: words, removed words, kept words and maximal repeated stretches."""
    split = [(x or "").encode().split() for x in texts]
    counts = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    rows = []
    for w in split:
        gone = np.zeros(len(w) + 1, bool)
        for i in range(len(w) - window + 1):
            if counts[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = True
        edges = np.flatnonzero(np.diff(np.r_[False, gone].astype(int)))
        kept = b" ".join(x for x, g in zip(w, gone, strict=False) if not g).decode()
        rows.append((len(w), int(gone.sum()), kept, tuple(map(tuple, edges.reshape(-1, 2).tolist()))))
    return rows


def same(out, keys, texts, window):
    got = Counter((r[0], r[1], r[2], r[3], tuple(tuple(x) for x in r[4])) for r in out.collect())
    assert got == Counter((k, *r) for k, r in zip(keys, plain(texts, window), strict=True))


def planted(window, seed=5):
    """Shared passages around the window's length at all offsets, a run of one word, copies and near misses."""
    r = random.Random(seed)
    fresh = iter(range(10**9))
    new = lambda n: [f"w{next(fresh)}" for _ in range(n)]
    passages = [new(window + d) for d in (-1, 0, 1, 7, 60)]
    texts = []
    for i in range(120):
        words = new(r.randrange(0, 3 * window))
        for _ in range(r.randrange(3)):
            at = r.randrange(len(words) + 1)
            words[at:at] = r.choice(passages)
        texts.append((" " if i % 2 else " \t\n").join(words))
    copy = " ".join(new(2 * window))
    return texts + [copy] * 9 + ["a " * (window + d) for d in (-1, 0, 1, 5)] + [" ".join(new(window) * 2)]


@pytest.mark.parametrize("window", [1, 2, 5, 35])
@pytest.mark.parametrize("chunk", [repeats.CHUNK_BYTES, 700])
def test_planted_passages(spark, monkeypatch, window, chunk):
    monkeypatch.setattr(repeats, "CHUNK_BYTES", chunk)
    texts = planted(window)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    same(repeats.without_repeats(rows, window=window, bucket=500), range(len(texts)), texts, window)


def test_nulls_repeated_rows_long_text_and_clashing_names(spark, odd_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    same(repeats.without_repeats(odd_docs), *zip(*rows, strict=True), 35)
    same(repeats.without_repeats(odd_docs, window=4), *zip(*rows, strict=True), 4)


def test_empty_table_and_only_nulls(spark, no_docs):
    assert repeats.without_repeats(no_docs).count() == 0
    nothing = spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")
    same(repeats.without_repeats(nothing), [1, None], [None, ""], 35)


def test_words_differ_by_white_space_of_ascii_only(spark):
    words = [f"x{i}" for i in range(40)]
    texts = [" ".join(words), " ".join(words), "\x0b".join(words), " ".join(words)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    same(repeats.without_repeats(rows), range(4), texts, 35)


def test_hashes_do_not_depend_on_place_or_table():
    few, many = repeats.Words(limit=2), repeats.Words()
    r = random.Random(1)
    text = [str(r.randrange(9)).encode() for _ in range(400)]
    for length in (1, 2, 18, 35):
        one, two = few.hashes([text])[0], many.hashes([text[150:], text])[0][250:]
        assert (few.stretches(one, length) == many.stretches(two, length)).all()
        cut = [tuple(text[i : i + length]) for i in range(len(text) - length + 1)]
        assert len(set(cut)) == len(set(many.stretches(two, length).tolist()))


def test_query_on_whole_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = {k: r[:2] for (k, _), r in zip(rows, plain([t for _, t in rows], 35), strict=True)}
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in queries.op12_repeats(spark, folder).collect()}
    assert got == want and sum(n for _, n in got.values()) > 0
