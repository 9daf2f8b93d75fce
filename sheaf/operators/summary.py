"""One-shot summaries: split a document, retrieve its most telling pieces, ask a model."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import embed
from ..sources.schemas import HISTORY
from .chunking import recursive_split
from .search import vector_search

#: The question that retrieves, how many pieces it brings, and the prompt.
QUESTION, PIECES = "Hay tom tat van ban nay", 4
PROMPT = """Ban la mot tro ly tom tat van ban chuyen nghiep.
Hay tom tat noi dung sau day thanh 5 y chinh quan trong nhat duoi dang danh sach bullet bang tieng Viet.
Noi dung: {context}
Tom tat:"""


def telling_pieces(doc: DataFrame, encoder: Callable[[list[str]], list[list[float]]], key: str = "doc_id", text: str = "text", k: int = PIECES) -> DataFrame:
    """The k pieces nearest to the question, nearest first: piece, content, distance. doc: one row."""
    pieces = recursive_split(doc, key, text).select("piece", "content")
    near = vector_search(embed(pieces, encoder, "piece"), encoder([QUESTION])[0], k, key="piece")
    return pieces.join(F.broadcast(near), F.col("piece") == F.col("id")).orderBy("distance", "piece").select("piece", "content", "distance")  # k rows


def summarise(doc: DataFrame, encoder: Callable[[list[str]], list[list[float]]], model: Callable[[str], str], **columns: str) -> str:
    """The model's answer to the prompt over a document's most telling pieces."""
    context = "\n\n".join(r.content for r in telling_pieces(doc, encoder, **columns).collect())
    return model(PROMPT.replace("{context}", context))


def history_entry(spark, filename: str, summary: str, at: datetime) -> DataFrame:
    """One row for the history of summaries."""
    return spark.createDataFrame([(filename, summary, at.strftime("%Y-%m-%d %H:%M:%S"))], HISTORY)
