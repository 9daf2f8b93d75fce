"""Keyword, vector and hybrid search, and grounded answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import answer, nearest, search
from ..operators.blocks import BlockIndex
from ..operators.search import KeywordIndex
from ..operators.segments import SegmentedIndex
from .base import query, scratch, table

QUERY = ("the", "ndre", "of", "the", "Dingsda")
_ASKED = ", ".join(f"('{w}')" for w in QUERY)
#: Only the query's terms are joined to the postings; the statistics need all of them.
_BM25_SQL = rf"""
    WITH tok AS MATERIALIZED (SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS w FROM documents),
    tf AS MATERIALIZED (SELECT doc_id, w, count(*) AS f FROM tok GROUP BY doc_id, w), dl AS (SELECT doc_id, count(*) AS dl FROM tok GROUP BY doc_id),
    st AS (SELECT (SELECT count(*) FROM documents)::DOUBLE AS n, (SELECT count(*) FROM tok) / (SELECT count(*) FROM documents) AS avgdl),
    raw AS MATERIALIZED (SELECT w, count(*) AS df, ln(max(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS i FROM tf, st GROUP BY w),
    idf AS MATERIALIZED (SELECT w, df, CASE WHEN i < 0 THEN 0.25::DOUBLE * (SELECT avg(i) FROM raw) ELSE i END AS idf FROM raw),
    q AS (SELECT w, count(*) AS times FROM (VALUES {_ASKED}) v(w) GROUP BY w),
    sc AS (SELECT tf.doc_id, list_reduce(list(times * idf * f * 2.5::DOUBLE / (f + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) ORDER BY w), lambda a, b: a + b) AS s FROM q JOIN idf USING (w) JOIN tf USING (w) JOIN dl ON dl.doc_id = tf.doc_id, st GROUP BY tf.doc_id),
    kw AS (SELECT doc_id AS id, s / (SELECT max(s) FROM sc) AS score, row_number() OVER (ORDER BY s DESC, doc_id) AS kw_rank FROM (SELECT * FROM sc ORDER BY s DESC, doc_id LIMIT 10) WHERE s > 0)"""
_NEAR_SQL = """
    near AS (SELECT vec_id AS id, list_sum(list_transform(list_zip(embedding, (SELECT embedding FROM embeddings WHERE vec_id = 0)), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2)) AS distance FROM embeddings ORDER BY distance, id LIMIT 10),
    vec AS (SELECT id, CASE WHEN far > 0 THEN 1 - distance / far ELSE 1 END AS score, row_number() OVER (ORDER BY distance, id) AS vec_rank FROM near, (SELECT CASE WHEN count(*) < 10 THEN 3.4028234663852886e38 ELSE max(distance) END AS far FROM near))"""
_HYBRID_SQL = f"""{_BM25_SQL}, {_NEAR_SQL},
    merged AS (SELECT coalesce(kw.id, vec.id) AS id, 0.5::DOUBLE * coalesce(kw.score, 0) + 0.5::DOUBLE * coalesce(vec.score, 0) AS final, kw_rank, vec_rank FROM kw FULL JOIN vec ON kw.id = vec.id),
    hits AS (SELECT doc_id AS chunk_id, text AS content, round(final, 4) AS final_score, row_number() OVER (ORDER BY round(final, 4) DESC, kw_rank NULLS LAST, vec_rank) AS rank FROM merged JOIN documents ON doc_id = id WHERE final >= 0.1 QUALIFY rank <= 5)"""


def _index(spark, sf_dir):
    return KeywordIndex.build(table(spark, sf_dir, "documents"), "doc_id", "text").keep_counts()


def _vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    return rows, list(rows.where("chunk_id = 0").first()["vector"])  # the query: one row


def _hits(spark, sf_dir, words=QUERY, top_k=5):
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    vectors, asked = _vectors(spark, sf_dir)
    return search.hybrid_search(_index(spark, sf_dir), vectors, chunks, list(words), asked, top_k)


@query("q_term_stats", _BM25_SQL + " SELECT w AS term, df, round(idf, 6) AS idf FROM idf")
def q_term_stats(spark, sf_dir):
    return _index(spark, sf_dir).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query("q_bm25_topk", _BM25_SQL + " SELECT id, round(score, 6) AS score, kw_rank FROM kw")
def q_bm25_topk(spark, sf_dir):
    return search.bm25_topk(_index(spark, sf_dir), list(QUERY), 10).withColumn("score", F.round("score", 6))


@query("q_index_append", _BM25_SQL + " SELECT id, round(score, 6) AS score, kw_rank FROM kw")
def q_index_append(spark, sf_dir):
    """The same rows as by a fresh build, from an index that grew by three batches, one of them sent twice, lost a seventh and got it back."""
    index = SegmentedIndex(spark, scratch(spark, "index"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    for part in (0, 1, 2, 1):
        index.append(docs.where(F.pmod("doc_id", F.lit(3)) == part), f"part {part}", "doc_id", "text")
    gone = docs.where(F.pmod("doc_id", F.lit(7)) == 0)
    index.remove(gone, "gone", "doc_id")
    index.append(gone, "back", "doc_id", "text")
    return search.bm25_topk(index.index(), list(QUERY), 10).withColumn("score", F.round("score", 6))


#: Questions by number, and the SQL of what each asks for.
QUERIES_ASKED = (QUERY, ("ndre", "of"), ("the",), ("Dingsda", "none at all"), ("of", "of", "and", "the", "ndre"))
_MANY_SQL = _BM25_SQL[: _BM25_SQL.index("    q AS (")] + f"""
    q AS (SELECT query_id, w, count(*) AS times FROM (VALUES {", ".join(f"({i}, '{w}')" for i, q in enumerate(QUERIES_ASKED) for w in q)}) v(query_id, w) GROUP BY ALL),
    sc AS (SELECT query_id, tf.doc_id, list_reduce(list(times * idf * f * 2.5::DOUBLE / (f + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) ORDER BY w), lambda a, b: a + b) AS s FROM q JOIN idf USING (w) JOIN tf USING (w) JOIN dl ON dl.doc_id = tf.doc_id, st GROUP BY query_id, tf.doc_id),
    best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS kw_rank FROM sc QUALIFY kw_rank <= 10)
    SELECT query_id, doc_id AS id, round(s / max(s) OVER (PARTITION BY query_id), 6) AS score, kw_rank FROM best WHERE s > 0"""


@query("q_bm25_topk_many", _MANY_SQL)
def q_bm25_topk_many(spark, sf_dir):
    """The ten best documents of several questions at once, from blocks of postings with early stop."""
    index = KeywordIndex.build(table(spark, sf_dir, "documents"), "doc_id", "text").keep_counts()
    asked = spark.createDataFrame([(i, list(q)) for i, q in enumerate(QUERIES_ASKED)], "query_id int, terms array<string>")
    return BlockIndex.build(index, scratch(spark, "blocks")).search(asked, 10).withColumn("score", F.round("score", 6))


@query("q_vector_search", f"WITH {_NEAR_SQL} SELECT id, round(distance, 6) AS distance FROM near")
def q_vector_search(spark, sf_dir):
    vectors, asked = _vectors(spark, sf_dir)
    return search.vector_search(vectors, asked, 10).withColumn("distance", F.round("distance", 6))


@query("q_vector_topk", f"WITH {_NEAR_SQL} SELECT id, round(score, 6) AS score, vec_rank FROM vec")
def q_vector_topk(spark, sf_dir):
    vectors, asked = _vectors(spark, sf_dir)
    return search.vector_topk(search.vector_search(vectors, asked, 10), 10).withColumn("score", F.round("score", 6))


@query("q_vector_topk_many", """
    WITH pairs AS (SELECT q.vec_id AS query_id, v.vec_id AS id, list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2)) AS distance FROM embeddings AS q, embeddings AS v WHERE q.vec_id % 5 = 0),
    near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), id) AS vec_rank FROM pairs QUALIFY vec_rank <= 10)
    SELECT query_id, id, round(1 - distance / max(distance) OVER (PARTITION BY query_id), 6) AS score, vec_rank FROM near""")
def q_vector_topk_many(spark, sf_dir):
    """What q_vector_topk gives, for a fifth of the vectors as queries in one scan."""
    vectors, _ = _vectors(spark, sf_dir)
    found = nearest.vector_search_many(vectors, vectors.where("chunk_id % 5 = 0").withColumnRenamed("chunk_id", "query_id"), 10)
    return nearest.vector_scores_many(found, 10).withColumn("score", F.round("score", 6))


@query("q_hybrid_search", _HYBRID_SQL + " SELECT * FROM hits")
def q_hybrid_search(spark, sf_dir):
    return _hits(spark, sf_dir)


@query("q_grounded", _HYBRID_SQL + " SELECT chunk_id, final_score, rank FROM hits WHERE final_score >= 0.2 ORDER BY rank LIMIT 3")
def q_grounded(spark, sf_dir):
    return answer.grounded(_hits(spark, sf_dir)).select("chunk_id", "final_score", "rank")


@query("q_decision", _HYBRID_SQL + f" SELECT count(*) FILTER (final_score >= 0.999) > 0 AS should_answer, CASE WHEN count(*) = 0 THEN '{answer.NOTHING_FOUND}' WHEN count(*) FILTER (final_score >= 0.999) = 0 THEN '{answer.NOT_RELIABLE}' END AS fallback_message FROM hits")
def q_decision(spark, sf_dir):
    return answer.decision(_hits(spark, sf_dir), 0.999)


_HEAD, _TAIL = (x.replace("'", "''") for x in answer.PROMPT.split("{context}"))


@query("q_prompt", _HYBRID_SQL + f", kept AS (SELECT *, row_number() OVER (ORDER BY rank) AS i FROM (SELECT * FROM hits WHERE final_score >= 0.2 ORDER BY rank LIMIT 3)) SELECT concat('{_HEAD}', string_agg('Tài liệu ' || i || ':' || chr(10) || content, chr(10) || chr(10) ORDER BY i), replace('{_TAIL}', '{{query}}', '{' '.join(QUERY)}')) AS prompt FROM kept")
def q_prompt(spark, sf_dir):
    return answer.prompt(answer.grounded(_hits(spark, sf_dir)), " ".join(QUERY))


@query("q_rag_answer")
def q_rag_answer(spark, sf_dir):
    """A whole answer, with a stand-in for the model that repeats the first words of its context."""
    found = answer.answer(" ".join(QUERY), lambda q: _hits(spark, sf_dir, q.split(), 3), lambda p: " ".join(p.split("CONTEXT:")[1].split()[:30]))
    return spark.createDataFrame([(found["answer"], found["sources"], found["grounded"])], "answer string, sources array<string>, grounded boolean")
