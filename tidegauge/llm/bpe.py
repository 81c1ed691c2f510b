"""BPE encoding and decoding by forced boundaries.

Merging only ever makes vocabulary tokens, so a pair of neighbouring bytes that stands in no token is
a certain cut: nothing is ever merged across it. ``Vocabulary.inside`` marks the pairs that do occur.
A text falls into fragments at such pairs and at the cuts of the vocabulary's word pattern; each
distinct fragment is merged once, many fragments at a time, and the ids are put together again.

Every operator treats null as the empty text; the empty text has no ids. Texts of any length are
processed whole. The table of fragments of a worker is bounded and is emptied when full, which costs
time and changes no result.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import ENCODE_BYTES, pieces, texts_of

#: Fragments that a worker remembers.
TABLE_LIMIT = 800_000
_NO_RANK = np.iinfo(np.int64).max

# The word patterns that the two public vocabularies are defined with.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"

#: White space as the patterns see it: the four separators \x1c to \x1f are not part of it.
_SPACE = r"[^\S\x1c-\x1f]"
_FRAGMENT = re.compile(rf"{_SPACE}*[\S\x1c-\x1f]+|{_SPACE}+")
_WORD = re.compile(r"[\S\x1c-\x1f]+")
_SEPARATORS = re.compile(r"[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """A byte-level BPE vocabulary read from a tokenizer's JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, letters = spec["model"], byte_letters()
        of_letter = {c: b for b, c in enumerate(letters)}
        vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_pattern = re.compile("|".join(map(re.escape, self.special)) or r"(?!)")
        self.words = bool(self.suffix)
        self.pattern = regex.compile(WORD_PATTERN if self.words else BYTE_PATTERN)
        self.first = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + self.suffix] for c in letters], np.int64)

        size = max([*vocab.values(), *self.special.values()]) + 1
        self.size = size
        token_bytes = [b""] * size
        for token, at in vocab.items():
            plain = token.removesuffix(self.suffix) if self.suffix else token
            if token not in self.special:
                token_bytes[at] = bytes(of_letter[c] for c in plain)
                if plain != token:
                    token_bytes[at] += b" "
        for token, at in self.special.items():
            token_bytes[at] = token.encode()
        lengths = np.array([len(x) for x in token_bytes], np.int64)
        self._bytes = np.frombuffer(b"".join(token_bytes), np.uint8)
        self._lengths, self._starts = lengths, np.cumsum(lengths) - lengths

        #: inside[a, b]: the bytes a, b stand next to each other in some token.
        self.inside = np.zeros((256, 256), bool)
        for token, at in vocab.items():
            if token not in self.special:
                raw = np.frombuffer(token_bytes[at], np.uint8)
                raw = raw[:-1] if self.suffix and token.endswith(self.suffix) else raw
                self.inside[raw[:-1], raw[1:]] = True

        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] * size + vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] if not self.suffix else vocab[a.removesuffix(self.suffix) + b] for a, b in merges], np.int64)
        order = np.argsort(keys)
        self._keys, self._rank, self._made = keys[order], order.astype(np.int64), made

    # -- merging -------------------------------------------------------------------------------

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._rank[at], _NO_RANK)

    def merge(self, raw: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words, given as their bytes one after the other, with the number of each.

        ``inside`` cuts the bytes further, and what lies between two cuts is merged by itself. In each
        pass every fragment merges all occurrences, from the left, of its best pair. A pair with a
        token made in that pass ranks behind it, so this is the order of the plain algorithm.
        """
        words, ends = len(counts), np.cumsum(counts)
        ids = self.first[raw]
        filled = ends[counts > 0] - 1
        ids[filled] = self.last[raw[filled]]
        word = np.repeat(np.arange(words, dtype=np.int32), counts)
        cut = np.ones(len(ids), bool)
        if len(ids):
            cut[1:] = (word[1:] != word[:-1]) | ~self.inside[raw[:-1], raw[1:]]
        owner = np.cumsum(cut, dtype=np.int32) - 1
        rank = np.full(len(ids), _NO_RANK)
        near = np.flatnonzero(~cut) - 1
        rank[near] = self._ranks(ids[near], ids[near + 1])
        best = np.empty(owner[-1] + 1 if len(owner) else 0, np.int64)
        at = np.arange(len(ids))
        done_ids, done_at, per = [], [], np.zeros(words, np.int64)
        while len(ids):
            start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best[owner[start]] = np.minimum.reduceat(rank, start)
            least = best[owner]
            live = least != _NO_RANK
            if not live.all():
                done_ids.append(ids[~live])
                done_at.append(at[~live])
                ids, owner, rank, at, least = ids[live], owner[live], rank[live], at[live], least[live]
                if not len(ids):
                    break
            hit = rank == least
            if (hit[1:] & hit[:-1]).any():  # of overlapping pairs every second one, from the left
                here = np.arange(len(hit))
                start = np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1]], here, 0))
                hit &= (here - start) % 2 == 0
            where = np.flatnonzero(hit)
            ids[where] = self._made[rank[where]]
            keep = np.ones(len(ids), bool)
            keep[where + 1] = False
            ids, owner, rank, at = ids[keep], owner[keep], rank[keep], at[keep]
            made = where - np.arange(len(where))
            rank[made] = _NO_RANK
            left = made[made > 0] - 1
            pairs = np.concatenate([left, made[made + 1 < len(ids)]])
            pairs = pairs[owner[pairs] == owner[pairs + 1]]
            rank[pairs] = self._ranks(ids[pairs], ids[pairs + 1])
        if not done_ids:
            return np.empty(0, np.uint32), per
        ids, at = np.concatenate(done_ids), np.concatenate(done_at)
        slot = np.full(len(raw), -1, np.int64)
        slot[at] = ids
        kept = slot >= 0
        return slot[kept].astype(np.uint32), np.bincount(word[kept], minlength=words)

    # -- cutting -------------------------------------------------------------------------------

    def fragments(self, text: str) -> list[str]:
        """Coarse cuts. Between a visible character and white space no token ever reaches, and the
        word pattern, which never looks to the left, goes on there as at the start of a text."""
        if not self.words:
            return _FRAGMENT.findall(text)
        if _SEPARATORS.search(text):
            return _WORD.findall(text)
        return text.split()

    def cut(self, fragment: str) -> list[str | int]:
        """Fine cuts of one fragment by special tokens and the word pattern."""
        if fragment.isalpha() and fragment.isascii():
            return [fragment.lower() if self.words else fragment]
        out: list[str | int] = []
        at = 0
        for found in self.special_pattern.finditer(fragment):
            out += self._plain(fragment[at : found.start()])
            out.append(self.special[found[0]])
            at = found.end()
        return out + self._plain(fragment[at:])

    def _plain(self, text: str) -> list[str]:
        if self.words:
            if text.isascii():
                text = text.lower()
            else:  # letter by letter: a final sigma has no special form here
                text = "".join(map(str.lower, unicodedata.normalize("NFC", text)))
        return self.pattern.findall(text)

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the tokens, one after the other; a word end stands for a blank."""
        ids = ids.astype(np.int64)
        return self._bytes[spread(self._starts[ids], self._lengths[ids])].tobytes()


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for every stretch, one after the other."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Encodes texts through a bounded table of the fragments seen so far."""

    def __init__(self, vocab: Vocabulary, limit: int = TABLE_LIMIT):
        self.vocab, self.limit = vocab, limit
        self._clear()

    def _clear(self) -> None:
        self._index: defaultdict[str, int] = defaultdict()
        self._index.default_factory = self._index.__len__
        self._ids = np.empty(0, np.uint32)
        self._starts = np.empty(0, np.int64)
        self._counts = np.empty(0, np.int64)

    def _learn(self) -> None:
        """Merge the fragments that the table has a number but no ids for."""
        known = len(self._counts)
        if known == len(self._index):
            return
        fresh = list(itertools.islice(reversed(self._index), len(self._index) - known))[::-1]
        number: defaultdict[str, int] = defaultdict()
        number.default_factory = number.__len__
        parts: list[int] = []  # numbers of distinct words, or -1 - id of a special token
        per = np.empty(len(fresh), np.int64)
        for at, fragment in enumerate(fresh):
            cuts = self.vocab.cut(fragment)
            parts += [-1 - x if isinstance(x, int) else number[x] for x in cuts]
            per[at] = len(cuts)
        words = [x.encode("utf-8", "surrogatepass") for x in number]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ids, counts = self.vocab.merge(np.frombuffer(b"".join(words), np.uint8), sizes)
        special = np.arange(self.vocab.size)  # each special token as one more word of one id
        starts = np.r_[np.cumsum(counts) - counts, len(ids) + special]
        counts = np.r_[counts, np.ones(self.vocab.size, np.int64)]
        ids = np.r_[ids, special.astype(np.uint32)]
        part = np.array(parts, np.int64)
        part = np.where(part < 0, len(words) - 1 - part, part)
        flat = ids[spread(starts[part], counts[part])]
        ends = np.r_[0, np.cumsum(counts[part])][np.r_[0, np.cumsum(per)]]
        self._starts = np.concatenate([self._starts, len(self._ids) + ends[:-1]])
        self._counts = np.concatenate([self._counts, np.diff(ends)])
        self._ids = np.concatenate([self._ids, flat])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and the number of each."""
        if len(self._index) > self.limit:
            self._clear()
        number, at = self._index.__getitem__, []
        for text in texts:
            cut = self.vocab.fragments(text)
            at.append(np.fromiter(map(number, cut), np.int64, len(cut)))
        self._learn()
        lengths = np.array([int(self._counts[x].sum()) for x in at], np.int64)
        flat = np.concatenate(at) if at else np.empty(0, np.int64)
        return self._ids[spread(self._starts[flat], self._counts[flat])], lengths


@lru_cache(maxsize=4)
def encoder(path: str, limit: int = TABLE_LIMIT) -> Encoder:
    """One table per worker process."""
    return Encoder(vocabulary(path), limit)


def little_endian(ids: np.ndarray) -> bytes:
    return ids.astype("<u4").tobytes()


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns of ``df`` without ``text`` and with ``ids``, an array of token ids.

    Null texts are empty; an empty text gives an empty array. A column of the name ``ids`` is replaced.
    """
    kept = [c for c in df.columns if c not in (text, ids)]
    rows = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("__text"))
    schema = df.select(*[F.col(f"`{c}`") for c in kept], F.lit(None).cast("array<int>").alias(ids)).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            for part in pieces(batch, "__text", ENCODE_BYTES):
                flat, lengths = coder.encode(texts_of(part, "__text"))
                offsets = pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32))
                column = pa.ListArray.from_arrays(offsets, pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], column], [*kept, ids])

    return rows.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """All columns of ``df`` without ``ids`` and with the decoded ``text``; null ids give ''."""
    kept = [c for c in df.columns if c not in (text, ids)]
    rows = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{ids}`").alias("__ids"))
    schema = df.select(*[F.col(f"`{c}`") for c in kept], F.lit(None).cast("string").alias(text)).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            found = [
                vocab.decode(np.array(x or [], np.int64)).decode("utf-8", "replace")
                for x in batch.column(len(kept)).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.string())], [*kept, text])

    return rows.mapInArrow(run, schema)


def digest(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: its key, ``n_tokens``, and SHA-256 of the ids and of the text decoded from them.

    Encoding and decoding are those of ``encode`` and ``decode``; they run in one pass so that ids
    need not be carried between them. Null keys and repeated rows are kept as they are.
    """
    schema = df.select(F.col(f"`{key}`").alias(key)).schema
    schema = schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, vocab = encoder(path), vocabulary(path)
        for batch in batches:
            for part in pieces(batch, "__text", ENCODE_BYTES):
                flat, lengths = coder.encode(texts_of(part, "__text"))
                ends = np.cumsum(lengths)
                rows = [flat[end - n : end] for end, n in zip(ends, lengths, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(lengths, pa.int64()),
                        pa.array([hashlib.sha256(little_endian(x)).hexdigest() for x in rows]),
                        pa.array(
                            [
                                hashlib.sha256(vocab.decode(x).decode("utf-8", "replace").encode()).hexdigest()
                                for x in rows
                            ]
                        ),
                    ],
                    [key, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return df.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("__text")).mapInArrow(run, schema)
