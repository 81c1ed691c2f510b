from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tidegauge.llm import bpe, packing, queries, token_files
from tidegauge.session import fresh_folder

BYTES, WORDS = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
PIECES = [
    " ", "  ", "\n", "\t", "\x1c", " ", "　", "a", "b", "'s", "'ll", "e", "E", "é", "é", "Σ", "AΣ ",
    "İ", "ß", "1", "23", "!", "...", "<|endoftext|>", "<|startoftext|>", "<|", "漢", "\U0001f600", "​", "́",
    "aaaaaaa", "the", " the", "\x85", "\r\n", "ﬁ", "\x00",
]


def library(path):
    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


def little(ids):
    return np.array(ids, "<u4").tobytes()


@pytest.fixture(scope="module")
def odd_texts():
    r = random.Random(3)
    return ["".join(r.choice(PIECES) for _ in range(r.randint(0, 25))) for _ in range(4000)]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_ids_are_those_of_the_library(path, odd_texts):
    coder = bpe.Encoder(bpe.vocabulary(path), limit=500)  # small, so that the table is emptied on the way
    want = [x.ids for x in library(path).encode_batch(odd_texts, add_special_tokens=False)]
    got = []
    for at in range(0, len(odd_texts), 300):
        flat, lengths = coder.encode(odd_texts[at : at + 300])
        got += [x.tolist() for x in np.split(flat, np.cumsum(lengths)[:-1])]
    assert got == want


def test_decoded_bytes(odd_texts):
    vocab, known = bpe.vocabulary(BYTES), library(BYTES)
    for text in odd_texts[:500]:
        ids = known.encode(text, add_special_tokens=False).ids
        got = vocab.decode(np.array(ids, np.int64)).decode("utf-8", "replace")
        assert got == known.decode(ids, skip_special_tokens=False) == text


def test_marked_pairs_stand_in_no_token():
    vocab = bpe.vocabulary(BYTES)
    pairs = np.zeros((256, 256), bool)
    for at in range(50256):
        raw = np.frombuffer(vocab.decode(np.array([at])), np.uint8)
        pairs[raw[:-1], raw[1:]] = True
    assert (pairs == vocab.inside).all()
    assert not vocab.inside[ord("e"), ord(" ")]


def test_encode_and_decode_tables(odd_docs, no_docs):
    ids = bpe.encode(odd_docs, BYTES)
    assert "text" not in ids.columns and ids.count() == 12
    back = {(r["doc_id"], r["text"]) for r in bpe.decode(ids, BYTES).collect()}
    assert back == {(r["doc_id"], r["text"] or "") for r in odd_docs.collect()}
    assert bpe.encode(no_docs, BYTES).count() == bpe.decode(bpe.encode(no_docs, BYTES), BYTES).count() == 0
    assert bpe.digest(no_docs, BYTES).count() == 0


def test_op5(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    known = library(BYTES)
    got = {r["doc_id"]: r for r in queries.op5_bpe(spark, folder).collect()}
    assert len(got) == len(docs)
    for r in docs:
        ids = known.encode(r["text"] or "", add_special_tokens=False).ids
        text = known.decode(ids, skip_special_tokens=False)
        want = (len(ids), hashlib.sha256(little(ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        assert tuple(got[r["doc_id"]])[1:] == want


@pytest.mark.parametrize(
    "ids",
    [
        [], [0], [2**64 - 1], [0] * 5000, list(range(3000)), [1 << (i % 64) for i in range(4000)],
        [2**60 - 1, 2**60, 7] * 700, [1] * 1023 + [2**40], [49407] * 1025,
    ],
)
def test_words_round_trip(ids):
    ids = np.array(ids, np.uint64)
    words, per_block, aside = token_files.pack(ids)
    assert (token_files.unpack(words, per_block, aside, len(ids)) == ids).all()
    assert per_block.sum() == len(words)


def test_small_ids_take_little_room():
    words, _, _ = token_files.pack(np.ones(60_000, np.uint64))
    assert len(words) < 1200


def test_files_of_odd_documents(spark, odd_docs, no_docs):
    known = library(WORDS)
    folder = fresh_folder(spark, "odd-files")
    token_files.write(odd_docs, folder, WORDS, end_id=2)
    got = token_files.read(spark, folder).orderBy("start").collect()
    key = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "")
    at = 0
    for have, doc in zip(got, sorted(odd_docs.collect(), key=key), strict=True):
        want = known.encode(doc["text"] or "", add_special_tokens=False).ids + [2]
        assert (have["doc_id"], have["start"], have["ids"]) == (doc["doc_id"], at, want)
        at += len(want)
    empty = fresh_folder(spark, "no-files")
    token_files.write(no_docs, empty, WORDS, end_id=2)
    assert token_files.summary(spark, empty).count() == 0


def test_op7(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect()
    known, at = library(WORDS), 0
    got = {r["doc_id"]: r for r in queries.op7_token_files(spark, folder).collect()}
    assert len(got) == len(docs)
    for r in docs:
        ids = known.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        assert tuple(got[r["doc_id"]])[1:] == (at, len(ids), zlib.crc32(little(ids)))
        at += len(ids)


def check_pieces(rows, examples, limits):
    """Every id in one piece, offsets without gaps, all limits kept; returns the share of padding."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for key, ids in examples.items():
        at = 0
        for r in sorted(pieces[key], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            assert r["ids_crc32"] == zlib.crc32(little(ids[at : at + r["length"]]))
            at += r["length"]
        assert at == len(ids)
    padding = total = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= limits.tokens and len(own) <= limits.segments
        assert sum(r["loss_tokens"] for r in own) <= limits.loss
        total += at
        padding += 0 if at & (at - 1) == 0 else limits.tokens - at
    return padding / (total + padding)


def test_op10(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    known = library(WORDS)
    examples = {r["doc_id"]: known.encode(r["text"] or "", add_special_tokens=False).ids + [1] for r in docs}
    rows = queries.op10_packing(spark, folder).collect()
    assert check_pieces(rows, examples, packing.Limits()) < 0.01


def test_all_limits_hold(spark):
    r = random.Random(4)
    rows = [(i, " ".join(["word"] * r.randint(0, 400)), r.choice([None, 0, 5, 60, 300])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, prompt int").repartition(2)
    limits = packing.Limits(tokens=512, segments=4, loss=300, pool=50)
    got = packing.pack(docs, WORDS, 1, limits, loss_from="prompt").collect()
    known = library(WORDS)
    check_pieces(got, {i: known.encode(t, add_special_tokens=False).ids + [1] for i, t, _ in rows}, limits)
    for x in got:
        prompt = rows[x["doc_id"]][2] or 0
        assert x["loss_tokens"] == max(0, x["start"] + x["length"] - max(x["start"], prompt))


def test_packing_odd_documents(odd_docs, no_docs):
    rows = packing.pack(odd_docs, WORDS, 1).collect()
    assert sum(r["length"] for r in rows if r["doc_id"] == 1) == 1  # null text: the end id alone
    twice = [r for r in rows if r["doc_id"] == 5]
    assert sum(r["length"] for r in twice) == 2 * twice[0]["doc_tokens"]
    assert any(r["doc_id"] is None for r in rows)
    assert packing.pack(no_docs, WORDS, 1).count() == 0
    with pytest.raises(ValueError):
        packing.pack(no_docs, WORDS, 1, packing.Limits(segments=0))


def test_very_short_texts_need_no_padding(spark):
    """Sequences that the segment limit closes end on a power of two, and no id is lost."""
    path = P.path("word_bpe_49k.json")
    rows = [(i, "a red dog" if i % 3 else "word " * (i % 50)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = packing.pack(docs, path, end_id=1).toPandas()
    sizes = got.groupby("sequence_id")["length"].sum()
    full = sum(n if n & (n - 1) == 0 else 2048 for n in sizes)
    assert sizes.sum() == got.drop_duplicates("doc_id")["doc_tokens"].sum() and full / sizes.sum() < 1.01
    assert got.groupby("sequence_id").size().max() <= 128
    for _, own in got.sort_values("start").groupby("doc_id"):
        assert own["start"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]]
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own["offset"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]]
