"""The operators of this folder applied to their whole tables, by query name."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import alignment, bpe, hamming, html_text, jaccard, language, packing, quality, repeats, runs, token_files, toxicity, vectors
from tidegauge.llm.common import fold, table
from tidegauge.session import fresh_folder


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold(F.col("doc_id"), 5) == 0
    model = toxicity.fit(docs.where(~held_out), table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return scored.select("doc_id", held_out.alias("held_out"), "score", predicted, "nearest")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    remainder = fold(F.col("doc_id"), 4)
    model = language.fit(docs.where(remainder != 2))
    rows = docs.select("doc_id", "text", (remainder == 2).alias("held_out"))
    return language.predict(rows, model)


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every hundredth vector, by Hamming distance of the sign codes."""
    codes = hamming.sign_codes(table(spark, sf_dir, "embeddings"))
    return hamming.nearest(codes, codes.where(F.col("id") % 100 == 0), k=10)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.summary(spark, folder)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; a fifth of the ids is held out of fitting so that it can be judged."""
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 5) == 0
    model = quality.fit(docs.where(~held_out), table(spark, sf_dir, "labels"))
    scored = quality.score(docs.select("doc_id", "text", "lang", "source"), model)
    return scored.select(
        "doc_id", held_out.alias("held_out"), "content_score", "metadata_score", "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op9_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.link(table(spark, sf_dir, "embeddings"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = [public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return alignment.align(table(spark, sf_dir, "documents"), *paths)[0]


def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.runs(table(spark, sf_dir, "documents"), tails=True)
    # The greatest length first; of equal ones the smallest start, then period.
    longest = F.array_min(F.transform("runs", lambda x: F.struct((-x.length).alias("l"), x.start, x.period)))
    lines = F.transform("runs", lambda x: F.format_string("%d,%d,%d\n", x.start, x.length, x.period))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("longest"), lines.alias("lines"), "collapsed")
    length, period = -F.col("longest.l"), F.col("longest.period")
    return rows.select(
        "doc_id", "n_runs", F.col("longest.start").alias("start"), length.alias("length"), period.alias("period"),
        F.expr("-1000 * longest.l div longest.period").alias("exponent_milli"),
        F.sha2(F.array_join("lines", ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_main_text": op1_main_text,
    "op2_toxicity": op2_toxicity,
    "op3_language": op3_language,
    "op4_jaccard": op4_jaccard,
    "op5_bpe": op5_bpe,
    "op6_hamming": op6_hamming,
    "op7_token_files": op7_token_files,
    "op8_quality": op8_quality,
    "op9_vectors": op9_vectors,
    "op10_packing": op10_packing,
    "op11_alignment": op11_alignment,
    "op12_repeats": op12_repeats,
    "op13_runs": op13_runs,
}
#: The smallest id that each id reaches over ``links(a, b)``, both directions given.
_COMPONENTS = """
    reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach AS r JOIN links AS l ON r.b = l.a),
    component AS (SELECT a, least(a, min(b)) AS root FROM reach GROUP BY a)"""

ORACLES: dict[str, str] = {
    "op4_jaccard": rf"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'
            ) AS w FROM documents
        ), shingles AS (
            SELECT DISTINCT doc_id, unnest(CASE
                WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i : array_to_string(w[i : i + 4], ' '))
                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
            FROM words
        ), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        links AS (
            SELECT x.doc_id AS a, y.doc_id AS b
            FROM shingles AS x JOIN shingles AS y ON x.s = y.s AND x.doc_id <> y.doc_id
            JOIN sizes AS m ON m.doc_id = x.doc_id JOIN sizes AS n ON n.doc_id = y.doc_id
            GROUP BY x.doc_id, y.doc_id, m.n, n.n HAVING 100 * count(*) >= 75 * (m.n + n.n - count(*))
        ), {_COMPONENTS}
        SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, doc_id) AS component_id
        FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN component ON a = doc_id""",
    "op6_hamming": """
        WITH codes AS (
            SELECT vec_id, list_sum(list_transform(range(64), lambda i : CASE WHEN embedding[i + 1] > 0 THEN 1::HUGEINT << i ELSE 0 END))::UBIGINT AS code
            FROM embeddings
        ), near AS (
            SELECT q.vec_id AS query_id, c.vec_id AS neighbour_id, bit_count(xor(q.code, c.code))::INTEGER AS distance,
                   row_number() OVER (PARTITION BY q.vec_id ORDER BY bit_count(xor(q.code, c.code)), c.vec_id) AS rank
            FROM codes AS q JOIN codes AS c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
        )
        SELECT query_id, rank::INTEGER AS rank, neighbour_id, distance FROM near WHERE rank <= 10""",
    "op9_vectors": f"""
        WITH RECURSIVE links AS (
            SELECT x.vec_id AS a, y.vec_id AS b FROM embeddings AS x JOIN embeddings AS y ON x.vec_id <> y.vec_id
            WHERE list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) >= 0.95
        ), {_COMPONENTS}
        SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(root, vec_id) AS component_id, coalesce(root, vec_id) = vec_id AS kept
        FROM embeddings LEFT JOIN component ON a = vec_id
        LEFT JOIN (SELECT a AS of_id, count(*) AS n FROM links GROUP BY a) ON of_id = vec_id""",
    "op12_repeats": r"""
        WITH texts AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
            FROM documents
        ), starts AS (
            SELECT r, i, md5(array_to_string(words[i : i + 34], ' ')) AS k
            FROM texts, unnest(range(1, len(words) - 33)) AS t(i)
        ), repeated AS (
            SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY k) AS n FROM starts) WHERE n > 1
        ), gone AS (
            SELECT DISTINCT r, i + j AS p FROM repeated, range(35) AS t(j)
        ), kept AS (
            SELECT r, string_agg(words[p], ' ' ORDER BY p) AS kept, count(*) AS n
            FROM (SELECT r, words, unnest(range(1, len(words) + 1)) AS p FROM texts) ANTI JOIN gone USING (r, p)
            GROUP BY r
        )
        SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed,
               sha256(coalesce(kept, '')) AS kept_sha256
        FROM texts LEFT JOIN kept USING (r)""",
}
