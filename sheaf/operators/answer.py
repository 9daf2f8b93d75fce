"""Grounded answers: filter what was found, build the prompt, check the answer against it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_text, tokens

#: Thresholds, and the messages and prompt that callers know.
GROUNDED, KEPT, OVERLAP, FEW = 0.2, 3, 0.1, 3
NOTHING_FOUND = "Không tìm thấy thông tin phù hợp trong tài liệu."
NOT_RELIABLE = "Dữ liệu tìm thấy không đủ tin cậy để trả lời."
NOT_IN_CONTEXT = "Xin lỗi, tôi không thể tìm thấy câu trả lời chính xác trong tài liệu này mặc dù có dữ liệu liên quan."
NO_INFORMATION = "Không tìm thấy thông tin"
MODEL_ERROR = "Lỗi khi kết nối với mô hình AI: "
SOURCE = "Tài liệu "
PROMPT = """BẠN LÀ TRỢ LÝ PHÁP LUẬT CHUYÊN NGHIỆP.

YÊU CẦU BẮT BUỘC:
1. CHỈ sử dụng thông tin từ phần 'Context' dưới đây.
2. Nếu không tìm thấy thông tin chính xác, hãy trả lời: "Không tìm thấy thông tin phù hợp trong tài liệu".
3. KHÔNG tự ý suy luận hoặc sử dụng kiến thức bên ngoài.
4. KHÔNG viết sai nội dung pháp lý. Nếu nội dung có Điều/Khoản, phải dẫn chiếu đúng.

CONTEXT:
{context}

CÂU HỎI:
{query}

TRẢ LỜI:"""


def grounded(hits: DataFrame, threshold: float = GROUNDED, kept: int = KEPT) -> DataFrame:
    """The first hits that reach the threshold, in order of rank."""
    return hits.where(F.coalesce("final_score", F.lit(0.0)) >= threshold).orderBy("rank").limit(kept)


def decision(hits: DataFrame, threshold: float = GROUNDED) -> DataFrame:
    """One row: should_answer, and the message where not."""
    counts = hits.agg(F.count("*").alias("n"), F.count_if(F.coalesce("final_score", F.lit(0.0)) >= threshold).alias("good"))
    message = F.when(F.col("n") == 0, NOTHING_FOUND).when(F.col("good") == 0, NOT_RELIABLE)
    return counts.select((F.col("good") > 0).alias("should_answer"), message.alias("fallback_message"))


def prompt(kept: DataFrame, query: str, content: str = "content") -> DataFrame:
    """One row with the prompt: the kept chunks, numbered from 1 in order of rank, and the question."""
    listed = F.array_sort(F.collect_list(F.struct("rank", F.col(content).alias("c"))))
    sources = F.transform(listed, lambda x, i: F.concat(F.lit(SOURCE), (i + 1).cast("string"), F.lit(":\n"), x["c"]))
    head, tail = PROMPT.split("{context}")
    return kept.agg(F.concat(F.lit(head), F.array_join(sources, "\n\n"), F.lit(tail.replace("{query}", query))).alias("prompt"))


def overlaps(answer: Column, context: Column, tokenize: Callable[[Column], Column] = tokens) -> Column:
    """Whether an answer of more than three distinct words shares a tenth of them with the context; one that says nothing was found passes."""
    said, held = F.array_distinct(tokenize(F.lower(answer))), F.array_distinct(tokenize(F.lower(context)))
    share = F.size(F.array_intersect(said, held)) / F.size(said)
    return F.contains(answer, F.lit(NO_INFORMATION)) | ~((F.size(said) > FEW) & (share < OVERLAP))


def answer(query: str, search: Callable[[str], DataFrame], model: Callable[[str], str], content: str = "content") -> dict:
    """{answer, sources, grounded} for one question: normalise, search, check, ask the model, check its answer.

    search: from the normalised question to hits with content, final_score and rank. model: a function on the
    driver; its failure becomes the answer's text.
    """
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    clean = spark.createDataFrame([(query,)], "q string").select(normalize_text(F.col("q"))).first()[0]
    hits = search(clean).cache()
    try:
        told = decision(hits).first()
        if not told.should_answer:
            return {"answer": told.fallback_message, "sources": [], "grounded": False}
        kept = grounded(hits)
        sources = [r[0] for r in kept.select(content).collect()]  # KEPT rows
        try:
            said = model(prompt(kept, clean, content).first()[0]).strip()
        except Exception as e:  # noqa: BLE001  whatever the model raises is the answer
            said = MODEL_ERROR + str(e)
        row = spark.createDataFrame([(said, " ".join(sources))], "a string, c string")
        good = row.select(overlaps(F.col("a"), F.col("c"))).first()[0]
        return {"answer": said if good else NOT_IN_CONTEXT, "sources": sources, "grounded": good}
    finally:
        hits.unpersist()
