"""Splitting documents: by articles and clauses, by pages, and by size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.values import preview

#: How articles and clauses start, and the mark before a page.
ARTICLE = r"(?miUd)^(Điều\s+\d+[:.]?)"
CLAUSE = r"(?mUd)^\s*(\d+[.)]|Khoản\s+\d+[.)]?)"
PAGE_MARK = r"--- Page (\d+) ---"
#: Size and overlap of pieces in characters, and where to split first.
SIZE, OVERLAP, SEPARATORS = 1000, 100, ("\n\n", "\n", " ", "")
#: Stands before a start while a text is split; normalised texts hold no control sign.
_MARK = "\u0001"
#: Pieces whose places are summed in one go.
BLOCK = 256


def _starts(text: Column, pattern: str, group: int) -> Column:
    return F.split(F.regexp_replace(text, pattern, f"{_MARK}${group}"), _MARK)


def _running(lengths: Column) -> Column:
    none = F.struct(F.array().cast("array<int>").alias("a"), F.lit(0).alias("n"))
    return F.aggregate(lengths, none, lambda x, n: F.struct(F.array_append(x["a"], x["n"]).alias("a"), (x["n"] + n).alias("n")))["a"]


def _offsets(pieces: Column) -> Column:
    """Where each piece starts, if they follow each other from 0 on.

    Sums run within blocks of BLOCK pieces and over the blocks, since an array that grows is copied with each element.
    """
    lengths = F.transform(pieces, lambda p: F.length(p))
    blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(pieces) / BLOCK).cast("int") - 1), lambda b: F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)))
    blocks = F.when(F.size(pieces) > 0, blocks).otherwise(F.array().cast("array<array<int>>"))
    bases = _running(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda x, n: x + n)))
    return F.flatten(F.zip_with(blocks, bases, lambda b, base: F.transform(_running(b), lambda n: n + base)))


def _placed(pieces: Column) -> Column:
    """Pieces but for the first, each as a struct of its start and itself."""
    return F.slice(F.zip_with(_offsets(pieces), pieces, lambda o, p: F.struct(o.alias("o"), p.alias("p"))), F.lit(2), F.size(pieces))


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def chunk_text(docs: DataFrame, text: str = "text", article: str = ARTICLE, clause: str = CLAUSE) -> DataFrame:
    """A row for each chunk: the columns of docs but the text, content, dieu, khoan, chunk_at (its place) and chunk_start.

    chunk_start: the character of the text, from 0, where the chunk's article, or its clause where it has one, starts.

    An article runs to the next; text before the first is dropped. An article with clauses gives a chunk for each
    clause, below the article's header; one without is a chunk. A text without articles is one chunk; an empty
    one gives none.
    """
    keep = [c for c in docs.columns if c != text]
    rows = docs.where(F.col(text).isNotNull() & (F.col(text) != "")).select(*keep, F.col(text).alias("_text"), _starts(F.col(text), article, 1).alias("_parts"))
    whole = F.size("_parts") == 1
    # places are made below the explode, once for a text; a column beside the explode would be made for each article
    articles = F.when(whole, F.array(F.struct(F.lit(0).alias("o"), F.col("_text").alias("p")))).otherwise(_placed(F.col("_parts")))
    rows = rows.select(*keep, whole.alias("_whole"), F.posexplode(articles).alias("_a", "_x")).select(*keep, "_whole", "_a", F.col("_x.o").alias("_o"), F.col("_x.p").alias("_article"))
    rows = rows.withColumn("_article", F.when(F.col("_whole"), F.col("_article")).otherwise(_trim(F.col("_article"))))
    header = F.regexp_extract("_article", article, 1)
    rows = rows.withColumn("_header", header).withColumn("_clauses", F.when(F.col("_whole"), F.array(F.col("_article"))).otherwise(_starts(F.col("_article"), clause, 0)))
    split = F.size("_clauses") > 1
    clauses = F.when(split, _placed(F.col("_clauses"))).otherwise(F.array(F.struct(F.lit(0).alias("o"), F.col("_article").alias("p"))))
    rows = rows.select(*keep, "_whole", "_a", "_o", "_header", split.alias("_split"), F.posexplode(clauses).alias("_c", "_y")).select(*keep, "_whole", "_a", "_o", "_header", "_split", "_c", F.col("_y.o").alias("_p"), F.col("_y.p").alias("_clause"))
    body = _trim(F.col("_clause"))
    blank = F.length("_clause") - F.length(F.regexp_replace("_clause", r"(?U)\A\s+", ""))
    start = F.col("_o") + F.when(F.col("_split"), F.col("_p") + blank).otherwise(0)
    rows = rows.select(
        *keep,
        F.struct("_a", "_c").alias("_at"),
        start.alias("chunk_start"),
        F.when(F.col("_split"), F.concat("_header", F.lit("\n"), body)).otherwise(F.col("_clause")).alias("content"),
        F.when(~F.col("_whole"), F.regexp_extract("_header", r"(?U)\d+", 0)).alias("dieu"),
        F.when(F.col("_split"), F.regexp_extract("_clause", r"(?U)\d+", 0)).alias("khoan"),
    )
    return rows.withColumnRenamed("_at", "chunk_at")


def numbered(chunks: DataFrame, key: str) -> DataFrame:
    """chunk_index 0, 1, 2 … within each document, in place of chunk_at."""
    index = F.row_number().over(Window.partitionBy(key).orderBy("chunk_at")) - 1
    return chunks.withColumn("chunk_index", index).drop("chunk_at")


def chunk_metadata(docs: DataFrame, key: str, text: str = "text", **patterns: str) -> DataFrame:
    """Chunks with index, page, first line in the page and a preview.

    Page and line are those of chunk_start: after the last page mark before it (page 1 without one), counting lines from
    the mark's next. The starts of a document's chunks, pages and lines are put in order by one window over the document, so the
    work grows with their number alone.
    """
    rows = docs.select(key, F.col(text).alias("_text"))
    chunks = chunk_text(rows, "_text", **patterns)
    chunks = chunks.select(key, F.col("chunk_start").alias("_start"), F.lit(1).alias("_kind"), F.lit(None).cast("int").alias("_page"), "chunk_at", "dieu", "khoan", preview(F.col("content")).alias("content_preview"))

    def events(starts: Column, kind: int, page: Column) -> DataFrame:
        found = rows.where("_text is not null").select(key, F.explode(starts).alias("_e")).select(key, F.col("_e.o").alias("_start"), F.lit(kind).alias("_kind"), page.alias("_page"))
        return found.select(*[F.col(f.name) if f.name in found.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in chunks.schema])

    lines = _placed(F.transform(F.split("_text", "\n"), lambda x: F.concat(x, F.lit("\n"))))
    marks = _placed(F.split(F.regexp_replace("_text", f"({PAGE_MARK})", f"{_MARK}$1"), _MARK))
    page = F.regexp_extract(F.col("_e.p"), PAGE_MARK, 1).cast("int")
    # at one place a line's start comes before a chunk's, and a mark, which counts only behind it, last
    every = events(lines, 0, F.lit(None).cast("int")).unionByName(chunks).unionByName(events(marks, 2, page))
    so_far = Window.partitionBy(key).orderBy("_start", "_kind", "chunk_at").rowsBetween(Window.unboundedPreceding, 0)
    every = every.withColumn("_lines", F.count_if(F.col("_kind") == 0).over(so_far)).withColumn("chunk_index", F.count_if(F.col("_kind") == 1).over(so_far).cast("int") - 1)
    every = every.withColumn("_before", F.last(F.when(F.col("_kind") == 2, F.col("_lines")), True).over(so_far)).withColumn("_page", F.last("_page", True).over(so_far))
    line = F.greatest(F.when(F.col("_before").isNull(), F.col("_lines") + 1).otherwise(F.col("_lines") - F.col("_before")), F.lit(1)).cast("int")
    return every.where("_kind = 1").select(key, "chunk_index", F.coalesce("_page", F.lit(1)).alias("page_number"), line.alias("start_line"), "dieu", "khoan", "content_preview")


def join_pages(pages: DataFrame, key: str, number: str, text: str, marked: bool = True) -> DataFrame:
    """A document's pages in order, as one text: each below its mark and a blank line apart, or plain without empty ones."""
    if marked:
        piece, gap = F.concat(F.lit("--- Page "), F.col(number).cast("string"), F.lit(" ---\n"), F.coalesce(F.col(text), F.lit(""))), "\n\n"
    else:
        pages, piece, gap = pages.where(F.coalesce(F.col(text), F.lit("")) != ""), F.col(text), ""
    held = F.array_sort(F.collect_list(F.struct(F.col(number).alias("n"), piece.alias("t"))))
    return pages.groupBy(key).agg(F.array_join(F.transform(held, lambda p: p["t"]), gap).alias("text"))


def split_recursively(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of up to `size` characters that overlap by up to `overlap`, split at the first separator that a text holds.

    A text of more than `size` characters is split, blanks at its ends included; pieces lose theirs afterwards.
    """
    at = next(i for i, s in enumerate(separators) if s == "" or s in text)
    separator, finer = separators[at], separators[at + 1 :]
    units = list(text) if not separator else [(separator if i else "") + u for i, u in enumerate(text.split(separator))]
    out: list[str] = []
    held: list[str] = []
    length = 0

    def close() -> None:
        if joined := "".join(held).strip():
            out.append(joined)

    for unit in (u for u in units if u):
        if len(unit) > size and finer:
            if held:
                close()
                held, length = [], 0
            out += split_recursively(unit, size, overlap, finer)
            continue
        if held and length + len(unit) > size:
            close()
            while held and (length > overlap or length + len(unit) > size):
                length -= len(held.pop(0))
        held.append(unit)
        length += len(unit)
    close()
    return out


def recursive_split(docs: DataFrame, key: str, text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """A row for each piece: key, piece, content."""
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, n, p) for i, t in enumerate(batch.column(1).to_pylist()) for n, p in enumerate(split_recursively(t, size, overlap))]
            at, number, piece = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(number, pa.int32()), pa.array(piece, pa.string())], ["_key", "piece", "content"])

    return rows.mapInArrow(split, f"_key {rows.schema['_key'].dataType.simpleString()}, piece int, content string").withColumnRenamed("_key", key)
