import re
import time
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sheaf.functions import values
from sheaf.functions.text import normalize_text, tokens
from sheaf.operators import chunking
from sheaf.operators.chunking import chunk_metadata, chunk_text, numbered, split_recursively

CASES = [
    ("page\x0c one\u0007", "page one"),
    (" a \t b  c\n \n\t\nd   e ", "a b c\nd e"),
    ("\t edge \n", "edge"),
    ("ĐƯỜNG PHỐ YÊN TĨNH", "ĐƯỜNG PHỐ YÊN TĨNH"),
    ("Điều 4. Giờ làm việc\n\nTừ tám giờ sáng.\n\nĐiều 5. Nghỉ trưa", "Điều 4. Giờ làm việc\nTừ tám giờ sáng.\nĐiều 5. Nghỉ trưa"),
    ("Biên bản (lần 2/3); ký: 7-9-2020. Xong?", "Biên bản (lần 2/3); ký: 7-9-2020. Xong?"),
    ("mưa rơi  \n  trên phố \n đêm", "mưa rơi\ntrên phố\nđêm"),
    ("", ""),
    (" \n\t \n", ""),
    (None, ""),
    (unicodedata.normalize("NFD", "Huế, Đà Nẵng"), "Huế, Đà Nẵng"),
]


def normal(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r[1] for r in rows.select("i", normalize_text(F.col("t"))).orderBy("i").collect()]


def test_normalize_cases(spark):
    assert normal(spark, [a for a, _ in CASES]) == [b for _, b in CASES]


def stated(text):
    text = unicodedata.normalize("NFC", text)
    text = "".join(c for c in text if unicodedata.category(c)[0] != "C" or c in "\n\r\t")
    text = re.sub(r"\s*\n\s*", "\n", re.sub(r"[ \t]+", " ", text))
    return text.strip()


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=" \t\n\r\x0c\xa0​　aééĐ.1"), min_size=30, max_size=60))
def test_normalize_random(spark, texts):
    assert normal(spark, texts) == [stated(t) for t in texts]


CHUNKS = [
    ("Điều 3. Mèo ngủ\nĐiều 4. Chó sủa", [("3", None), ("4", None)], None),
    ("Điều 5. Vườn\n1. Cây cam\n2. Cây bưởi\nĐiều 6. Ao cá", [("5", "1"), ("5", "2"), ("6", None)], None),
    ("ĐIỀU 2: Sông\nnước chảy\nĐiều 3. Núi", [("2", None), ("3", None)], None),
    ("Một đoạn kể chuyện không chia điều khoản.", [(None, None)], ["Một đoạn kể chuyện không chia điều khoản."]),
    ("Lời nói đầu\nĐiều 9. Chợ\n1. Bán rau\n2. Bán cá\nĐiều 10. Bến xe", [("9", "1"), ("9", "2"), ("10", None)], ["Điều 9.\n1. Bán rau", "Điều 9.\n2. Bán cá", "Điều 10. Bến xe"]),
    ("Điều 7. x\nKhoản 1. a\nKhoản 2) b\n13.200 triệu", [("7", "1"), ("7", "2"), ("7", "13")], None),
    ("Điều 8\nKhoản\n1. a\n(1) b\n2) c\r3. d", [("8", "1"), ("8", "2")], ["Điều 8\nKhoản\n1. a\n(1) b", "Điều 8\n2) c\r3. d"]),
    ("", [], []),
    (None, [], []),
]


def test_chunk_cases(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(CHUNKS)], "i int, text string")
    found = numbered(chunk_text(rows), "i").orderBy("i", "chunk_index").collect()
    for i, (_, marks, contents) in enumerate(CHUNKS):
        own = [r for r in found if r.i == i]
        assert [(r.dieu, r.khoan) for r in own] == marks
        assert contents is None or [r.content for r in own] == contents


def test_chunk_pages(spark):
    text = "--- Page 1 ---\nĐiều 1. a\nb\n--- Page 2 ---\nx\nĐiều 2. c"
    rows = spark.createDataFrame([(1, text)], "i int, text string")
    assert [(r.chunk_index, r.page_number, r.start_line) for r in chunk_metadata(rows, "i").orderBy("chunk_index").collect()] == [(0, 1, 1), (1, 2, 2)]
    again = "x\n--- Page 2 ---\nĐiều 1. a\n1. same\n--- Page 3 ---\ny\nĐiều 2. b\n 1. same\n\n2. z"
    found = chunk_metadata(spark.createDataFrame([(1, again)], "i int, text string"), "i").orderBy("chunk_index").collect()
    assert [(r.page_number, r.start_line, r.khoan) for r in found] == [(2, 2, "1"), (3, 3, "1"), (3, 5, "2")]
    plain = chunk_metadata(spark.createDataFrame([(1, "p\nq\nĐiều 1. a"), (2, "no article")], "i int, text string"), "i").orderBy("i").collect()
    assert [(r.page_number, r.start_line) for r in plain] == [(1, 3), (1, 1)]


@given(st.text(alphabet="ab \n", max_size=400), st.integers(5, 40))
def test_recursive_pieces(text, size):
    pieces = split_recursively(text, size, size // 4)
    assert all(0 < len(p) <= size for p in pieces)
    assert set("".join(pieces)) - set(" \n") == set(text) - set(" \n")
    if len(text) <= size:  # blanks count, at the ends too
        assert pieces == ([text.strip()] if text.strip() else [])


@pytest.mark.parametrize(("value", "flag"), [(" Dev ", True), ("OFF", False), ("maybe", None)])
def test_debug_flag(spark, value, flag):
    assert spark.range(1).select(values.debug_flag(F.lit(value))).first()[0] is flag


def test_small_functions(spark):
    row = spark.range(1).select(values.gigabytes(F.lit(3 * 2**30)), values.kilobytes(F.lit(1536)), values.iso_text(F.lit("2026-01-02 03:04:05.000600").cast("timestamp_ntz")), values.is_setting(F.lit("chunk_size")), values.keep_or_replace(F.lit(""), F.lit("x"))).first()
    assert list(row) == [3.0, 1.5, "2026-01-02T03:04:05.000600", True, "x"]


def test_chunks_of_many_articles_are_made_once_each(spark):
    """10,000 articles: places are summed below the explode, so neither time nor plan grows with their square."""
    text = "--- Page 7 ---\n" + "\n".join(f"Điều {i}. x\n1. a {i}\n2. b" for i in range(10_000))
    docs = spark.createDataFrame([(1, text)], "k long, text string")
    began = time.time()
    rows = chunking.chunk_metadata(docs, "k").collect()
    assert time.time() - began < 60 and len(rows) == 20_000
    last = max(rows, key=lambda r: r.chunk_index)
    assert (last.chunk_index, last.page_number, last.start_line, last.dieu, last.khoan) == (19_999, 7, 30_000, "9999", "2")
    plan = chunking.chunk_text(docs)._jdf.queryExecution().optimizedPlan().toString()
    above = plan.split("Generate")[0]
    assert "array_append" not in above


def test_a_long_text_goes_through_all_text_operators(spark):
    text = "Mở đầu\n" + "từ " * 300_000 + "\nĐiều 1. x\n1. y"
    docs = spark.createDataFrame([(1, text)], "k long, text string")
    assert [r.content for r in chunking.chunk_text(docs).collect()] == ["Điều 1.\n1. y"]
    assert docs.select(F.size(tokens(F.col("text"))).alias("n")).first().n == 300_000 + 7
    assert len(docs.select(normalize_text(F.col("text")).alias("t")).first().t) == len(text) - 1
    assert chunking.recursive_split(docs, "k").count() > 800


def test_texts_go_to_python_in_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    normalize_text(F.col("t"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 512
