"""Scalar functions of listings, exports, configuration and files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words for true and false in settings, and extensions by kind of file.
TRUE_WORDS = ("1", "true", "yes", "on")
DEBUG_TRUE_WORDS = (*TRUE_WORDS, "debug", "development", "dev")
DEBUG_FALSE_WORDS = ("0", "false", "no", "off", "release", "production", "prod")
FILE_KINDS = {"pdf": ("pdf",), "image": ("jpg", "jpeg", "png", "bmp")}
#: Settings that configuration rows may change.
SETTINGS = ("MODEL_NAME", "MODEL_PATH", "FAISS_INDEX_PATH", "VECTOR_DIM", "CHUNK_SIZE", "CHUNK_OVERLAP", "OCR_LANG", "UPLOAD_DIR", "MAX_FILE_SIZE_MB", "BACKUP_DIR", "SSO_ENABLED", "SSO_PROVIDER_NAME", "SSO_SHARED_SECRET", "SSO_AUTO_CREATE_USERS")


def key_preview(key_hash: Column) -> Column:
    return F.concat(F.substring(key_hash, 1, 8), F.lit("..."))


def sha256_hex(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def typed_int(value: Column, data_type: Column) -> Column:
    return F.when(F.lower(data_type) == "int", F.trim(value).try_cast("long"))


def typed_bool(value: Column, data_type: Column) -> Column:
    return F.when(F.lower(data_type) == "bool", F.lower(value).isin(*TRUE_WORDS))


def is_setting(key: Column) -> Column:
    return F.upper(key).isin(*SETTINGS)


def debug_flag(value: Column) -> Column:
    """True or false for the known words; null where the value passes through."""
    word = F.lower(F.trim(value))
    return F.when(word.isin(*DEBUG_TRUE_WORDS), True).when(word.isin(*DEBUG_FALSE_WORDS), False)


def iso_text(ts: Column) -> Column:
    """ISO 8601 without zone; microseconds only where there are some."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))


def gigabytes(size: Column) -> Column:
    return F.round(size / 1024**3, 2)


def kilobytes(size: Column) -> Column:
    return F.round(size / 1024, 2)


def preview(content: Column, length: int = 300) -> Column:
    return F.substring(content, 1, length)


def file_kind(name: Column) -> Column:
    """pdf or image by the part after the last point, in any case; null if unsupported."""
    ext = F.lower(F.element_at(F.split(name, r"\."), -1))
    return F.when(ext.isin(*FILE_KINDS["pdf"]), "pdf").when(ext.isin(*FILE_KINDS["image"]), "image")


def keep_or_replace(new: Column, old: Column) -> Column:
    """The new value unless it is null or empty."""
    return F.coalesce(F.nullif(new, F.lit("")), old)
