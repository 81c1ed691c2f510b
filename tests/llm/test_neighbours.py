from __future__ import annotations

import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from tidegauge.llm import hamming, jaccard, queries, vectors
from tidegauge.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Groups(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def tie(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def plain_sets(rows):
    out = {}
    for key, text in rows:
        words = WORD.findall((text or "").translate(LOWER))
        runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)] or ([tuple(words)] if words else [])
        out[key] = frozenset(runs)
    return out


def plain_join(rows):
    sets, groups = plain_sets(rows), Groups()
    by_item = defaultdict(set)
    for key, own in sets.items():
        for item in own:
            by_item[item].add(key)
    tried = set()
    for keys in by_item.values():
        for a, b in itertools.combinations(sorted(keys), 2):
            if (a, b) not in tried:
                tried.add((a, b))
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    groups.tie(a, b)
    return {key: (len(own), groups.find(key)) for key, own in sets.items()}


def family_texts(seed, families, most):
    """Texts of many lengths with copies, near copies around the limit, and passages they share."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    passage = [r.choice(words) for _ in range(40)]
    out = []
    for _ in range(families):
        base = [r.choice(words) for _ in range(int(5 * (most / 5) ** r.random()))]
        if r.random() < 0.4:
            base[len(base) // 2 : len(base) // 2] = passage
        for _ in range(r.randint(1, 7)):
            text = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, max(1, len(base) // 60), max(1, len(base) // 35)])):
                at = r.randrange(len(text))
                text[at : at + r.choice([0, 1])] = r.choice([[], [r.choice(words)], [r.choice(words)] * 2])
            out.append(" ".join(text).upper() if r.random() < 0.2 else " \n".join(text))
    r.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize(("seed", "families", "most"), [(1, 150, 40), (2, 90, 400), (3, 40, 2500)])
def test_join_against_all_pairs(spark, seed, families, most):
    rows = family_texts(seed, families, most)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(docs).collect()}
    want = plain_join(rows)
    assert got == want
    assert len({c for _, c in want.values()}) < len(rows)


@pytest.mark.parametrize("small", [0, 64])
def test_crowded_sets_are_compared_with_all(spark, small):
    """With far too few segments no set can pay, so every one takes the exact way out."""
    rows = family_texts(5, 25, 60)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    settings = jaccard.Settings(segments=((1 << 62, 0.02),), small=small, bucket=400)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(docs, settings=settings).collect()}
    assert got == plain_join(rows)


def test_large_group_of_near_copies(spark):
    r = random.Random(8)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(600):
        text = list(base)
        text[r.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(text)))
    rows += [(1000 + i, " ".join(base[:60] + [f"y{i}-{k}" for k in range(60)])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join(docs).collect()}
    assert all(got[i] == 0 for i in range(600)) and all(got[1000 + i] == 1000 + i for i in range(300))


def test_join_of_odd_documents(odd_docs, no_docs):
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in jaccard.join(odd_docs).collect())
    assert got == [
        (0, 4, None), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 5, 4), (5, 5, 4), (5, 5, 4), (6, 29996, 6),
        (7, 4, 7), (8, 1, 8), (9, 1, 9), (10, 1, 9),
    ]
    assert jaccard.join(no_docs).count() == jaccard.join(odd_docs.where("doc_id in (1, 2)")).count() - 2 == 0
    kept = jaccard.first_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 7, 8, 9]


def test_first_of_each_decides_by_row_where_ids_repeat(spark):
    base = [f"b{i}" for i in range(60)]
    near, other = " ".join([*base[:-1], "x"]), " ".join(f"u{i}" for i in range(50))
    rows = [
        (3, " ".join(base), "a"), (5, near, "b"), (5, other, "c"), (5, other.upper(), "d"), (6, near, "e"),
        (7, " ".join([*base[:-2], "x", "y"]), "f"), (8, other, "g"), (None, other, "h"), (9, "", "i"), (9, None, "j"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string")
    kept = jaccard.first_of_each(docs)
    assert kept.columns == docs.columns
    got = sorted(r["node"] for r in kept.collect())
    assert got in (["a", "c", "h", "i", "j"], ["a", "d", "h", "i", "j"])  # of equal sets of one id either stays
    plain = jaccard.first_of_each(docs.where("doc_id in (3, 6, 7, 8)"))
    assert sorted(r["doc_id"] for r in plain.collect()) == [3, 8]


def test_op4(spark, folder):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op4_jaccard(spark, folder).collect()}
    assert got == plain_join(docs)


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (5, None)]
    edges += [(r.randrange(200, 400), r.randrange(200, 400)) for _ in range(120)]
    groups = Groups()
    for a, b in edges:
        if b is not None:
            groups.tie(a, b)
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: groups.find(x) for x in list(groups) if groups.find(x) != x}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def plain_nearest(codes, queries_, k):
    out = {}
    for q, code in queries_:
        all_ = sorted(((code ^ c) & (2**64 - 1)).bit_count() * 10**9 + i for i, c in codes if i != q)
        out[q] = [(n + 1, x % 10**9, x // 10**9) for n, x in enumerate(all_[:k])]
    return out


@pytest.mark.parametrize("case", ["random", "copies", "few", "extreme"])
def test_hamming_against_all(spark, case):
    r = random.Random(6)
    signed = lambda: r.getrandbits(64) - 2**63
    if case == "random":
        codes = [(i, signed()) for i in range(3000)]
    elif case == "copies":
        base = signed()
        codes = [(i, base if i % 3 else base ^ (1 << r.randrange(63)) ^ (1 << r.randrange(63))) for i in range(2000)]
    elif case == "few":
        codes = [(i, signed()) for i in range(4)]
    else:
        codes = [(0, 0), (1, -1), (2, -(2**63)), (3, 2**63 - 1), (4, -1)]
    asked = codes[::97] if len(codes) > 100 else codes
    frames = [spark.createDataFrame(x, "id long, code long") for x in (codes, asked)]
    got = defaultdict(list)
    for x in hamming.nearest(*frames, k=7).collect():
        got[x["query_id"]].append((x["rank"], x["neighbour_id"], x["distance"]))
    assert {q: sorted(x) for q, x in got.items()} == plain_nearest(codes, asked, 7)


def test_sign_codes_of_odd_vectors(spark):
    good, short = [1.0, -1.0] * 32, [1.0] * 63
    rows = [(1, good), (2, None), (3, short), (4, [*good[:63], None]), (5, [*good[:63], float("nan")]), (None, good), (6, [0.0] * 64)]
    codes = hamming.sign_codes(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert {r["id"]: r["code"] & (2**64 - 1) for r in codes.collect()} == {1: int("01" * 32, 2), 6: 0}
    empty = codes.limit(0)
    assert hamming.nearest(empty, empty, 3).count() == 0


def test_op6(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    codes = [(r["vec_id"], sum(1 << i for i, x in enumerate(r["embedding"]) if x > 0)) for r in rows]
    got = defaultdict(list)
    for x in queries.op6_hamming(spark, folder).collect():
        got[x["query_id"]].append((x["rank"], x["neighbour_id"], x["distance"]))
    assert {q: sorted(x) for q, x in got.items()} == plain_nearest(codes, [c for c in codes if c[0] % 100 == 0], 10)


def plain_links(rows, limit=0.95):
    keys = [k for k, _ in rows]
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    close = x @ x.T >= limit
    np.fill_diagonal(close, False)
    groups = Groups()
    for a, b in zip(*np.nonzero(close), strict=True):
        groups.tie(keys[a], keys[b])
    return {k: int(c) for k, c in zip(keys, close.sum(1), strict=True)}, {k: groups.find(k) for k in keys}


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(900, 48))
    near = base[:300] + rng.normal(size=(300, 48)) * rng.choice([0.05, 0.2, 0.3], (300, 1))
    cloud = base[0] + rng.normal(size=(250, 48)) * 0.05
    rows = list(enumerate(np.r_[base, near, cloud, base[300:340], base[:20] * 3].astype(np.float32).tolist()))
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    links, roots = plain_links(rows)
    settings = vectors.Settings(block=64)  # the cloud takes several parts of one cell
    got = {r["vec_id"]: r for r in vectors.link(frame, settings=settings).collect()}
    assert len(got) == len(rows)
    assert all(got[k]["n_links"] <= links[k] for k in links)
    assert sum(r["n_links"] for r in got.values()) >= 0.95 * sum(links.values())
    assert np.mean([got[k]["component_id"] == roots[k] for k in roots]) > 0.95
    assert all(r["kept"] == (k == r["component_id"]) for k, r in got.items())


def test_odd_vectors(spark):
    rows = [
        (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]),
        (7, [2.0, 0.0]), (8, [1.0]), (9, []), (10, [1.0, 0.0]), (None, [1.0, 0.0]), (11, [-1.0, 0.0]), (12, [3e38, 1e30]), (1, [1.0, 0.0]),
    ]
    frame = spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, embedding array<float>, id int, links string")
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in vectors.link(frame).collect())
    alone = [(k, 0, k, True) for k in (2, 3, 4, 5, 6, 8, 9, 11)]
    tied = [(1, 4, 1, True), (1, 4, 1, True), (7, 4, 1, False), (10, 4, 1, False), (12, 4, 1, False)]
    assert [x for x in got if x[0]] == sorted(alone + tied)
    assert [x[:2] for x in got if not x[0]] == [(0, 0)]
    assert vectors.link(frame.limit(0)).count() == 0


def test_op9(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    links, roots = plain_links(rows)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in queries.op9_vectors(spark, folder).collect()}
    assert got.keys() == links.keys()
    assert sum(n for n, _ in got.values()) >= 0.9 * sum(links.values())


def test_no_task_holds_a_whole_hot_cell(spark):
    block, count, visits = 50, 1000, 700
    members = spark.range(count).selectExpr("1L as cell", "id", "1L as n", "array(1D, 0D) as v")
    guests = spark.range(count, count + visits).selectExpr("1L as cell", "id", "1L as n", "array(1D, 0D) as v")
    nowhere = guests.selectExpr("2L as cell", "id", "n", "v")
    rows = vectors._dealt(members, guests.union(nowhere), block)
    groups = defaultdict(list)
    for r in rows.select("cell", "part", "with", "alone", "member", "id").collect():
        groups[r["cell"], r["part"], r["with"], r["alone"]].append((r["member"], r["id"]))
    assert max(map(len, groups.values())) < 4 * block  # two parts, which vary around the block
    met = defaultdict(int)
    for (_, _, _, alone), held in groups.items():
        ours, theirs = [x for own, x in held if own], [x for own, x in held if not own]
        for pair in itertools.combinations(sorted(ours), 2) if alone else itertools.product(ours, theirs):
            met[tuple(sorted(pair))] += 1
    assert set(met.values()) == {1}
    assert len(met) == count * (count - 1) // 2 + count * visits
