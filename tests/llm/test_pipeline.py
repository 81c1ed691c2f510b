from __future__ import annotations

import public_tokenizers as P
from test_neighbours import plain_join
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from tidegauge.llm import queries
from tidegauge.session import cut


def test_every_operator_and_the_pipeline_are_registered():
    named = __spark_entry__.queries()
    assert {int(x[2:].split("_")[0]) for x in named if x.startswith("op")} >= set(range(1, 11))
    assert named["pipeline"] is corpus_pipeline.run and set(queries.QUERIES) <= set(named)


def test_stages_on_their_own_input(spark, folder):
    """Each stage takes effect on all that the one before it kept, and adds or drops no column."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = cut(stage(spark, before, folder), name)
        assert after.columns == columns and after.dtypes == docs.dtypes
        gone = {r["doc_id"] for r in before.collect()} - {r["doc_id"] for r in after.collect()}
        if name == "language":
            assert not gone
        elif name == "quality":
            known = [labels[x] for x in gone if x in labels]
            assert known.count(0) >= 0.8 * len(known)
        else:
            want = plain_join([(r["doc_id"], r["text"]) for r in before.collect()])
            assert gone == {k for k, (_, c) in want.items() if k != c}
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, before, folder)
    known = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    known.no_truncation()
    known.no_padding()
    total = {r["doc_id"]: len(known.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in before.collect()}
    held: dict = {}
    for r in packed.collect():
        held[r["doc_id"]] = held.get(r["doc_id"], 0) + r["length"]
    assert held == total
    whole = corpus_pipeline.run(spark, folder).groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in whole} == total


def test_texts_without_letters_go(spark, odd_docs, folder):
    kept = corpus_pipeline.known_language(spark, odd_docs, folder)
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 4, 5, 5, 6, 7]  # "one two" is in no language taught here
    assert corpus_pipeline.good_quality(spark, odd_docs, folder).columns == odd_docs.columns
