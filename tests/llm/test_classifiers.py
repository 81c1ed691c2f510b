from __future__ import annotations

import numpy as np
import pytest

from tidegauge.llm import language, quality, queries, toxicity

MEDIUM = "/root/testdata/sf0.1"


def test_masks_hold_every_language_of_an_ngram(spark):
    rows = [(1, "alpha beta gamma", "x"), (2, "beta gamma delta", "y"), (3, "omega", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, settings=language.Settings(orders=(3,)))
    assert model.languages == ("x", "y", "z")
    for at, (_, text, _) in enumerate(rows):
        keys, _, _ = language.ngrams([text], (3,))
        masks = ~np.zeros((len(keys), 1), np.uint64)
        for slot in language._slots(keys, len(model.masks), model.hashes):
            masks &= model.masks[slot]
        assert ((masks[:, 0] >> np.uint64(at)) & np.uint64(1)).all()  # a Bloom filter never forgets


def test_more_than_64_languages(spark):
    rows = [(i, f"{chr(97 + i // 26)}{chr(97 + i % 26)}qz " * 5, f"l{i:03}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    names, score, _ = language.identify(model, [r[1] for r in rows])
    assert names == [r[2] for r in rows] and ((score > 0) & (score <= 1)).all()


def test_language_of_odd_documents(odd_docs, no_docs):
    model = language.fit(odd_docs)
    got = {(r["doc_id"], r["n_chars"]): r for r in language.predict(odd_docs, model).collect()}
    assert [got[k]["lang_pred"] for k in ((1, None), (2, 0), (3, 3), (8, 12))] == ["und"] * 4
    assert got[1, None]["score"] == 0
    assert (got[5, 43]["lang_pred"], got[7, -1]["lang_pred"]) == ("en", "de")
    assert language.predict(no_docs, model).count() == 0
    names, score, cover = language.identify(model, ["漢字", "qqqq"])
    assert names == ["de", "de"] and score.tolist() == cover.tolist() == [0, 0]
    nothing = language.fit(no_docs)
    assert language.identify(nothing, ["The dog"])[0] == ["und"]


def test_op3_on_held_out(spark):
    got = queries.op3_language(spark, MEDIUM).toPandas()
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(docs, on="doc_id")
    held = both[both["held_out"] & both["lang"].notna()]
    assert len(got) == len(docs) and (held["lang"] == held["lang_pred"]).mean() > 0.99
    assert got["score"].between(0, 1).all()


def test_op8_on_held_out(spark):
    got = queries.op8_quality(spark, MEDIUM).toPandas()
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet").toPandas()
    assert len(got) == spark.read.parquet(f"{MEDIUM}/documents.parquet").count()
    held = got[got["held_out"]].merge(labels, on="doc_id")
    good, bad = held[held["quality"] == 1], held[held["quality"] == 0]
    assert good["predicted"].mean() > 0.98 and bad["predicted"].mean() < 0.1
    assert got[["content_score", "metadata_score", "score"]].stack().between(0, 1).all()


def test_quality_of_odd_documents(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 1), (4, 0), (None, 1), (6, None), (99, 0)], "doc_id long, quality int")
    for named, share in ((labels, True), (labels.limit(0), True), (labels.where("doc_id = 99"), True)):
        model = quality.fit(odd_docs, named)
        rows = quality.score(odd_docs, model).collect()
        assert len(rows) == 12 and all(0 <= r["score"] <= 1 for r in rows) is share
    assert rows[0]["score"] >= 0.5  # without labels nothing is bad
    assert quality.score(no_docs, model).count() == 0
    assert quality.fit(no_docs, labels) is not None


def test_views_teach_each_other(spark):
    """Few labels: the second view alone can tell most rows, and the first learns from it."""
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(900):
        good = i % 2
        text = " ".join(rng.choice(["tree", "river", "stone"] if good else ["zzqq", "xxvv", "kkjj"], 12))
        rows.append((i, text, "en", "fine" if good else "poor"))
        if i < 80:
            labels.append((i, good))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    got = quality.score(docs, model).collect()
    assert np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 2 == 1) for r in got]) > 0.99


def brute_nearest(index, term, weight, terms, k):
    dense = np.zeros((len(index.ids), terms))
    for t in range(terms):
        own = slice(index.start[t], index.start[t + 1])
        dense[index.row[own], t] = index.weight[own]
    query = np.zeros(terms)
    query[term] = weight
    sim = dense @ query
    best = np.lexsort((index.ids, -np.round(sim, 12)))[:k]
    return [(int(index.ids[x]), round(float(sim[x]), 9)) for x in best if sim[x] > 0]


@pytest.mark.parametrize("seed", range(5))
def test_block_bounds_lose_no_neighbour(seed):
    rng = np.random.default_rng(seed)
    n, terms = 700, 40
    row, term, weight = [], [], []
    for i in range(n):
        own = np.sort(rng.choice(terms, rng.integers(1, 7), replace=False))
        w = rng.choice([1.0, 2.0, 3.0], len(own))
        row += [i] * len(own)
        term += own.tolist()
        weight += (w / np.linalg.norm(w)).tolist()
    row, term, weight = np.array(row), np.array(term), np.array(weight)
    settings = toxicity.Settings(block=16, first=2, neighbours=9, dense=[0.06, 2.0, 0.0][seed % 3])
    index = toxicity.Index.build(rng.permutation(n), rng.integers(0, 2, n), row, term, weight, terms, settings)
    for i in range(0, n, 7):
        own = row == i
        at, sim = next(index.nearest_of(np.array([0, own.sum()]), term[own], weight[own]))
        got = [(int(index.ids[x]), round(float(s), 9)) for x, s in zip(at, sim, strict=True)]
        assert got == brute_nearest(index, term[own], weight[own], terms, 9)


def test_op2_on_held_out(spark):
    got = queries.op2_toxicity(spark, MEDIUM).toPandas()
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet").toPandas()
    assert len(got) == spark.read.parquet(f"{MEDIUM}/documents.parquet").count()
    held = got[got["held_out"]].merge(labels, on="doc_id")
    clean, toxic = held[held["toxic"] == 0], held[held["toxic"] == 1]
    assert clean["predicted"].mean() < 0.02 and toxic["predicted"].mean() > 0.75
    assert got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.5)).all()


def test_toxicity_of_odd_documents(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 1), (5, 1), (6, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    for docs, named in ((odd_docs, labels), (odd_docs, labels.limit(0)), (no_docs, labels)):
        model = toxicity.fit(docs, named)
        rows = toxicity.score(odd_docs, model).collect()
        assert len(rows) == 12 and all(0 <= r["score"] <= 1 for r in rows)
        assert toxicity.score(no_docs, model).count() == 0
    assert rows[0]["score"] < 0.5


@pytest.mark.parametrize("seed", range(3))
def test_batches_of_texts_lose_no_neighbour(seed):
    rng = np.random.default_rng(seed)
    n, terms = 400, 60
    own = [np.sort(rng.choice(terms, rng.integers(1, 9), replace=False, p=np.arange(1, terms + 1) / 1830)) for _ in range(n)]
    weight = [w / np.linalg.norm(w) for w in (rng.choice([1.0, 2.0, 3.0], len(x)) for x in own)]
    bounds = np.r_[0, np.cumsum([len(x) for x in own])]
    row, term, weight = np.repeat(np.arange(n), np.diff(bounds)), np.concatenate(own), np.concatenate(weight)
    index = toxicity.Index.build(rng.permutation(n), rng.integers(0, 2, n), row, term, weight, terms, toxicity.Settings(batch=64))
    got = list(index.nearest_of(bounds, term, weight))
    assert len(got) == n
    for i, (at, sim) in enumerate(got):
        mine = slice(bounds[i], bounds[i + 1])
        plain = brute_nearest(index, term[mine], weight[mine], terms, 15)
        assert [(int(index.ids[x]), round(float(s), 9)) for x, s in zip(at, sim, strict=True)] == plain


def test_every_text_with_a_known_term_has_neighbours(spark):
    """At balanced labels a term of a few examples is kept too."""
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(["river", "stone", "cloud", "table"], 6)) + (f" vile{i % 4}" if i % 2 else f" kind{i % 4}")) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int"))
    chance, ids, _ = model.score(["vile1", "vile3", "kind0", "river", "", "qqqq"])
    assert [len(x) > 0 for x in ids] == [True] * 4 + [False] * 2
    assert min(chance[:2]) > 0.5 > chance[2]


def test_toxicity_sample_is_of_the_documents_and_by_label(spark):
    docs = spark.createDataFrame([(i, f"word{i} some text") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 15 == 0)) for i in range(3000)], "doc_id long, toxic int")
    index = toxicity.fit(docs, labels, settings=toxicity.Settings(examples=100)).index
    assert sorted(index.ids[index.labels == 1]) == list(range(0, 300, 15))  # the rare label whole
    assert 50 <= (index.labels == 0).sum() <= 110
    assert toxicity._shares(10, 80, 100) == (1, 1) and toxicity._shares(900, 900, 100) == (50 / 900, 50 / 900)
