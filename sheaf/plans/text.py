"""Normalisation, chunking, pages and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values
from ..functions.text import matches_any_accentless, normalize_text, same_text, tokens
from ..operators import chunking
from ..operators.answer import overlaps
from ..sources.files import append_history
from .base import query, table

#: Documents hold no articles, so lines get headers by their number; and some noise to be cleaned.
_LINED = """SELECT doc_id, array_join(transform(split(text, '\n'), (l, i) -> CASE WHEN i % 7 = 2 THEN concat('Điều ', i, '. ', l) WHEN i % 7 = 4 THEN concat(i, '. ', l) WHEN i % 7 = 6 THEN concat('Khoản ', i, ' ', l) ELSE l END), '\n') AS text FROM {docs}"""
_LINED_SQL = """SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda l, i: CASE WHEN (i - 1) % 7 = 2 THEN 'Điều ' || (i - 1) || '. ' || l WHEN (i - 1) % 7 = 4 THEN (i - 1) || '. ' || l WHEN (i - 1) % 7 = 6 THEN 'Khoản ' || (i - 1) || ' ' || l ELSE l END), chr(10)) AS text FROM documents"""


def _lined(spark, sf_dir):
    return spark.sql(_LINED, docs=table(spark, sf_dir, "documents"))


_CHUNKS_SQL = f"""
    WITH lined AS ({_LINED_SQL}),
    {{steps}}
"""
_CHUNK_STEPS = r"""
    parts AS (SELECT doc_id, text, string_split(regexp_replace(text, '(?mi)^(Điều\s+\d+[:.]?)', chr(1) || '\1', 'g'), chr(1)) AS a FROM lined WHERE text <> ''),
    articles AS (SELECT doc_id, text, true AS whole, 1 AS an, 0 AS ao, text AS article FROM parts WHERE len(a) = 1
                 UNION ALL SELECT doc_id, text, false, i, coalesce(list_sum(list_transform(a[:i - 1], lambda x: len(x))), 0), trim(a[i], chr(10) || ' ' || chr(13) || chr(9)) FROM (SELECT *, unnest(range(2, len(a) + 1)) AS i FROM parts WHERE len(a) > 1)),
    clauses AS (SELECT *, CASE WHEN whole THEN '' ELSE regexp_extract(article, '(?mi)^(Điều\s+\d+[:.]?)', 1) END AS header,
                CASE WHEN whole THEN [article] ELSE string_split(regexp_replace(article, '(?m)^\s*(\d+[.)]|Khoản\s+\d+[.)]?)', chr(1) || '\0', 'g'), chr(1)) END AS c FROM articles),
    flat AS (SELECT doc_id, text, whole, header, false AS split, article AS body, an, 1 AS cn, ao AS start FROM clauses WHERE len(c) = 1
             UNION ALL SELECT doc_id, text, whole, header, true, trim(c[i], chr(10) || ' ' || chr(13) || chr(9)), an, i, ao + list_sum(list_transform(c[:i - 1], lambda x: len(x))) + len(c[i]) - len(ltrim(c[i], chr(10) || ' ' || chr(13) || chr(9))) FROM (SELECT *, unnest(range(2, len(c) + 1)) AS i FROM clauses WHERE len(c) > 1)),
    chunks AS (SELECT doc_id, an, cn, text[:start] AS before, CASE WHEN split THEN header || chr(10) || body ELSE body END AS content,
               CASE WHEN NOT whole THEN regexp_extract(header, '\d+') END AS dieu, CASE WHEN split THEN regexp_extract(body, '\d+') END AS khoan FROM flat)
"""


_PAGED = """SELECT doc_id, array_join(transform(split(text, '\n'), (l, i) -> CASE WHEN i % 5 = 0 THEN concat('--- Page ', i div 5 + 1, ' ---\n', l) ELSE l END), '\n') AS text FROM {docs}"""
_PAGED_SQL = "SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda l, i: CASE WHEN (i - 1) % 5 = 0 THEN '--- Page ' || ((i - 1) // 5 + 1) || ' ---' || chr(10) || l ELSE l END), chr(10)) AS text FROM plain"


@query("q_normalize_text", r"""
    WITH noisy AS (SELECT doc_id, nfc_normalize(concat('  ', replace(text, ' ', chr(9) || ' '), chr(10), ' ', chr(10), 'e', chr(769), chr(12), chr(8203), '  x ')) AS t FROM documents),
    clean AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\x{200b}]', '', 'g'), '[ \t]+', ' ', 'g'), '\s*\n\s*', chr(10), 'g') AS t FROM noisy)
    SELECT doc_id, trim(t, ' ' || chr(10) || chr(13)) AS text FROM clean""")
def q_normalize_text(spark, sf_dir):
    noisy = F.concat(F.lit("  "), F.replace(F.col("text"), F.lit(" "), F.lit("\t ")), F.lit("\n \né\x0c​  x "))
    return table(spark, sf_dir, "documents").select("doc_id", normalize_text(noisy).alias("text"))


@query("q_tokens", r"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS t FROM documents)")
def q_tokens(spark, sf_dir):
    t = tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", t.alias("t")).select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"))


@query("q_chunk_text", _CHUNKS_SQL.format(steps=_CHUNK_STEPS) + " SELECT doc_id, content, dieu, khoan FROM chunks")
def q_chunk_text(spark, sf_dir):
    return chunking.chunk_text(_lined(spark, sf_dir)).select("doc_id", "content", "dieu", "khoan")


@query("q_chunk_metadata", f"WITH plain AS ({_LINED_SQL}), lined AS ({_PAGED_SQL}), {_CHUNK_STEPS}" + r"""
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY an, cn) - 1 AS chunk_index, coalesce(CAST(regexp_extract_all(before, '--- Page (\d+) ---', 1)[-1] AS INT), 1) AS page_number,
           len(string_split(regexp_replace(before, '(?s)^.*--- Page \d+ ---\n?', ''), chr(10))) AS start_line, dieu, khoan, substr(content, 1, 300) AS content_preview FROM chunks""")
def q_chunk_metadata(spark, sf_dir):
    paged = spark.sql(_PAGED, docs=_lined(spark, sf_dir))
    return chunking.chunk_metadata(paged, "doc_id").select("doc_id", "chunk_index", "page_number", "start_line", "dieu", "khoan", "content_preview")


@query("q_recursive_split")
def q_recursive_split(spark, sf_dir):
    return chunking.recursive_split(table(spark, sf_dir, "documents"), "doc_id")


@query("q_pdf_page_join", "SELECT conv_id, string_agg('--- Page ' || turn || ' ---' || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def q_pdf_page_join(spark, sf_dir):
    return chunking.join_pages(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query("q_pdf_plain_join", "SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text FROM conversations WHERE text <> '' GROUP BY conv_id")
def q_pdf_plain_join(spark, sf_dir):
    return chunking.join_pages(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", marked=False)


@query("q_file_dispatch", """
    SELECT page_id, name, CASE WHEN lower(string_split(name, '.')[-1]) = 'pdf' THEN 'pdf' WHEN lower(string_split(name, '.')[-1]) IN ('jpg', 'jpeg', 'png', 'bmp') THEN 'image' END AS kind
    FROM (SELECT page_id, concat(url, '/f', page_id, ['.PDF', '.jpg', '.Jpeg', '.txt', '', '.png', '.tar.bmp'][page_id % 7 + 1]) AS name FROM pages)""")
def q_file_dispatch(spark, sf_dir):
    ends = F.array(*[F.lit(x) for x in (".PDF", ".jpg", ".Jpeg", ".txt", "", ".png", ".tar.bmp")])
    name = F.concat("url", F.lit("/f"), "page_id", F.get(ends, (F.col("page_id") % 7).cast("int")))
    return table(spark, sf_dir, "pages").select("page_id", name.alias("name")).withColumn("kind", values.file_kind(F.col("name")))


@query("q_accentless_search", "SELECT doc_id FROM documents WHERE strip_accents(text) ILIKE '%etre de%' OR strip_accents(source) ILIKE '%etre de%'")
def q_accentless_search(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(matches_any_accentless("être dé", F.col("text"), F.col("source"))).select("doc_id")


@query("q_collated_equality", "SELECT n_nationkey, n_name FROM nation WHERE lower(strip_accents(rtrim('Fránce  '))) = lower(strip_accents(rtrim(n_name))) OR n_nationkey = 3")
def q_collated_equality(spark, sf_dir):
    return table(spark, sf_dir, "nation").where(same_text(F.col("n_name"), F.lit("Fránce  ")) | (F.col("n_nationkey") == 3)).select("n_nationkey", "n_name")


@query("q_answer_overlap", r"""
    WITH pairs AS (SELECT a.conv_id, a.turn, a.text AS answer, q.text AS context FROM conversations AS a JOIN conversations AS q ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE a.role = 'assistant'),
    sets AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(answer), '\s+'), lambda x: x <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(lower(context), '\s+'), lambda x: x <> '')) AS c FROM pairs)
    SELECT conv_id, turn, contains(answer, 'Không tìm thấy thông tin') OR NOT (len(a) > 3 AND len(list_intersect(a, c)) / len(a) < 0.1) AS grounded FROM sets""")
def q_answer_overlap(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    asked = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("context"))
    pairs = c.where("role = 'assistant'").join(asked, ["conv_id", "turn"])
    return pairs.select("conv_id", "turn", overlaps(F.col("text"), F.col("context")).alias("grounded"))


@query("q_history_top20", """
    SELECT filename, summary, timestamp FROM (SELECT concat('file', conv_id, '.pdf') AS filename, text AS summary, concat('2026-01-', lpad(CAST(conv_id % 28 + 1 AS VARCHAR), 2, '0'), ' 10:00:', lpad(CAST(turn % 60 AS VARCHAR), 2, '0')) AS timestamp FROM conversations)
    ORDER BY timestamp DESC, filename, summary LIMIT 20""")
def q_history_top20(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    stamp = F.concat(F.lit("2026-01-"), F.lpad((F.col("conv_id") % 28 + 1).cast("string"), 2, "0"), F.lit(" 10:00:"), F.lpad((F.col("turn") % 60).cast("string"), 2, "0"))
    rows = c.select(F.concat(F.lit("file"), "conv_id", F.lit(".pdf")).alias("filename"), F.col("text").alias("summary"), stamp.alias("timestamp"))
    return append_history(rows.where("timestamp < '2026-01-15'"), rows.where("timestamp >= '2026-01-15'"))
