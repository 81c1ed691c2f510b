"""Aligned tokenizers against both libraries and a plain count of overlapping tokens."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidegauge.llm import alignment, queries

PATHS = [public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
HARD = [
    "", " ", "  ", "\n", "a", " a", "a ", "\ta\r\n b\r c", "x▁y", "<s> </s> <unk>", "<|endoftext|> a<|endoftext|>",
    "naïve café   　x", "\U0001f600 \U0001f600\U0001f600", "a\x1cb \x1d c", "\x00 a\x00", "a b \x85 c", "';\r\n  };\r",
    "é بح 中文字", "    four\n\n\n  three   ", "1234567 3.14159 x_y-z", "﻿bom �",
]


def plain(texts):
    """Per text its numbers and groups, by the libraries on the whole text and all overlaps of ranges."""
    a, b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    pair = alignment.Pair(*PATHS)
    found, counts = [], Counter()
    for text in texts:
        one = a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        two = b.encode(text) if text else []
        raw = (" " + (text or "")).encode()
        if b"".join(pair.bytes_a[x] for x in one) != raw or b"".join(pair.bytes_b[x] for x in two) != raw:
            one = two = []
        spans = []
        for ids, of in ((one, pair.bytes_a), (two, pair.bytes_b)):
            at, here = 0, []
            for x in ids:
                here.append((at, at + len(of[x]), x))
                at += len(of[x])
            spans.append(here)
        ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        first, groups = 0, []
        for end in ends:
            sides = [",".join(str(x) for s, e, x in side if first <= s and e <= end) for side in spans]
            groups.append("|".join(sides))
            first = end
        links = [(x, y) for s, e, x in spans[0] for t, f, y in spans[1] if s < f and t < e]
        counts.update(links)
        found.append((len(one), len(two), len(groups), links, ";".join(groups)))
    highest = defaultdict(int)
    for (_, y), n in counts.items():
        highest[y] = max(highest[y], n)
    rows = [
        (
            *x[:3], len(x[3]), sum(counts[k] == highest[k[1]] for k in x[3]), sum(counts[k] for k in x[3]),
            hashlib.sha256(x[4].encode()).hexdigest() if x[4] else "",
        )
        for x in found
    ]
    return rows, counts, highest


def same(out, ids, texts):
    rows, counts, highest = plain(texts)
    got = Counter(tuple(r) for r in out[0].collect())
    assert got == Counter((i, *r) for i, r in zip(ids, rows, strict=True))
    pairs = {(r["a"], r["b"]): (r["links"], r["best"]) for r in out[1].collect()}
    assert pairs == {k: (n, n == highest[k[1]]) for k, n in counts.items()}


@pytest.mark.parametrize("known", [1, 30, 200_000])
def test_hard_texts_at_every_bound(spark, known):
    texts = [*HARD, *(x + y for x in HARD[5:9] for y in HARD[9:]), None, "the the the " * 50]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    same(alignment.align(rows, *PATHS, known=known), range(len(texts)), texts)


def test_nulls_repeats_and_clashing_names(spark, odd_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect() if len(r["text"] or "") < 1000]
    short = odd_docs.where("text is null or length(text) < 1000")
    same(alignment.align(short, *PATHS), *zip(*rows, strict=True))


def test_long_text_and_empty_table(spark, odd_docs, no_docs):
    long = odd_docs.where("length(text) > 1000")
    row, text = alignment.align(long, *PATHS)[0].first(), long.first()["text"]
    assert row["n_b"] == len(sentencepiece.SentencePieceProcessor(model_file=PATHS[1]).encode(text))
    out, pairs = alignment.align(no_docs, *PATHS)
    assert out.count() == 0 and pairs.count() == 0 and out.columns[0] == "doc_id"


def test_table_of_fragments_is_emptied_without_a_trace():
    pair = alignment.Pair(*PATHS)
    small, large = alignment.Aligner(pair, limit=3), alignment.Aligner(pair)
    for text in HARD:
        one, two = small.align([text]), large.align([text])
        assert (one[0] == two[0]).all() and one[1] == two[1]
        assert all((x == y).all() for i in (2, 3) for x, y in zip(one[i], two[i], strict=True))


def test_query_on_whole_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = {r["doc_id"]: tuple(r)[:4] for r in queries.op11_alignment(spark, folder).collect()}
    a, b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    assert len(got) == len(rows)
    for key, text in rows:
        assert got[key][1:3] == (len(a.encode(" " + text).ids), len(b.encode(text)))
