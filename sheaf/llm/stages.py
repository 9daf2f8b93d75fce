"""The stages of the corpus pipeline: (name, function of (spark, docs, sf_dir) that returns a DataFrame).

All but the last return the columns of documents. Names of working columns start with an underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, langid, packing, simhash, substring
from .common import write_table

#: Near copies: shingles of five words, the differing bits up to which fingerprints may be linked (64: all are), and the share of shingles in common.
NEAR_WORDS = 5
NEAR_BITS = 64
NEAR_SHARE = 0.8


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognisable language: a null text or no letter in it, whether or not any row has a label to learn from.

    Each row is judged alone, so null and repeated ids and repeated rows stay as they are.
    """
    model = langid.fit(docs, F.lit(True))
    marked = docs.withColumnsRenamed({c: f"_d_{c}" for c in docs.columns})
    if model.languages:
        known = langid.identify(marked, model, "_d_text").where(F.col("lang_pred") != langid.UNKNOWN)
    else:
        known = langid.lettered(marked, "_d_text")
    return known.select(*[F.col(f"_d_{c}").alias(c) for c in docs.columns])


def without(docs: DataFrame, dropped: DataFrame, text_hash: Column) -> DataFrame:
    """Rows of docs whose doc_id and text_hash are not in `dropped` (_key, _hash); a null id is a key like any other."""
    names = {c: f"_d_{c}" for c in docs.columns}
    rows = docs.select(*[F.col(c).alias(n) for c, n in names.items()], text_hash.alias("_own"))
    rows = rows.join(dropped, F.col("_d_doc_id").eqNullSafe(F.col("_key")) & (F.col("_own") == F.col("_hash")), "left_anti")
    return rows.select(*[F.col(n).alias(c) for c, n in names.items()])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one of equal texts, that of the largest doc_id (null last), and one of rows that repeat both id and text.

    A null text counts as empty. Texts of unlike hash move only if too many rows go for Spark to send their keys to all tasks.
    """
    hashed = F.xxhash64(F.coalesce("text", F.lit("")))
    found = exact_dedup.exact_dedup(docs, carry={"_hash": hashed})
    keys = write_table(found.groupBy(F.col("doc_id").alias("_key"), "_hash").agg(F.max("kept").alias("_kept"), F.count("*").alias("_n")).where("not _kept or _n > 1"), "exact-keys")
    rest = without(docs, keys.select("_key", "_hash"), hashed)
    again = keys.where("_kept").select("_key", "_hash")  # rows that repeat a kept one
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_id"), hashed.alias("_own"))
    rows = rows.join(again, F.col("_id").eqNullSafe(F.col("_key")) & (F.col("_own") == F.col("_hash")), "left_semi")
    return rest.unionByName(rows.groupBy("_id", "_own").agg(F.first("_row").alias("_row")).select("_row.*"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, that of the smallest doc_id (null last); rows alike in id and text stay or go together.

    Texts without words are near copies of each other, null ones too; texts shorter than a shingle are one shingle.
    """
    groups = simhash.simhash_groups(docs, ngram=NEAR_WORDS, max_bits=NEAR_BITS, min_similarity=NEAR_SHARE)
    dropped = groups.where("not kept").select(F.col("doc_id").alias("_key"), F.col("text_hash").alias("_hash")).distinct()
    return without(docs, write_table(dropped, "near-dropped"), F.xxhash64(F.coalesce("text", F.lit(""))))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated passages from texts, and documents of which nothing is left; other texts stay as they are, null and empty ones too.

    Passages are judged by doc_id, null last; rows that repeat an id count as copies of one document.
    """
    marked = docs.withColumnsRenamed({c: f"_d_{c}" for c in docs.columns}).withColumn("_no_text", F.col("_d_text").isNull())
    out = substring.remove_repeats(marked, "_d_text", "_d_doc_id", carry=[c for c in marked.columns if c not in ("_d_doc_id", "_d_text")], keep_text=True)
    changed = F.col("n_removed") > 0
    out = out.where(~changed | (F.col("kept") != "")).withColumn("_d_text", F.when(changed, F.col("kept")).when(~F.col("_no_text"), F.col("original")))
    if "n_chars" in docs.columns:
        out = out.withColumn("_d_n_chars", F.when(changed, F.length("_d_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_d_n_chars")))
    return out.select(*[F.col(f"_d_{c}").alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences; one row for each piece. A null text is packed as its end alone, repeated rows one by one."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), added_tokens=True)


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("simhash_near_dedup", near), ("substring_dedup", repeats), ("best_fit_packing", packed)]
