from datetime import datetime

from pyspark.sql import functions as F

from sheaf.operators import settings, summary


def test_summary(spark):
    def length_encoder(texts):
        return [[float(len(t)), 1.0] for t in texts]

    doc = spark.createDataFrame([(1, "\n\n".join(c * 700 for c in "abcdef"))], "doc_id long, text string")
    seen = []
    told = summary.summarise(doc, length_encoder, lambda p: seen.append(p) or "- a")
    assert told == "- a" and summary.QUESTION not in seen[0] and seen[0].count("\n\n") == 3
    assert summary.telling_pieces(doc, length_encoder).count() == 4
    assert summary.history_entry(spark, "f", "s", datetime(2026, 1, 2)).first().timestamp == "2026-01-02 00:00:00"


def test_changed_settings():
    now = {"CHUNK_SIZE": 700, "OCR_LANG": "vie"}
    assert settings.changed_settings(now, {"chunk_size": 5, "ocr_lang": "eng", "other": 1}) == {"CHUNK_SIZE": 5, "OCR_LANG": "vie"}
    assert settings.changed_settings(now, {}) == now and now["CHUNK_SIZE"] == 700


def test_settings(spark):
    rows = [(1, "chunk_size", "500", "INT", True), (2, "CHUNK_SIZE", "700", "int", True), (3, "sso_enabled", "On", "bool", True), (4, "OCR_LANG", "eng", "string", False), (5, "OTHER", "1", "int", True)]
    configs = spark.createDataFrame(rows, "id long, config_key string, config_value string, data_type string, is_active boolean")
    assert settings.settings(configs, {"CHUNK_SIZE": 1, "OCR_LANG": "vie"}) == {"CHUNK_SIZE": 700, "OCR_LANG": "vie", "SSO_ENABLED": True}


def test_request_log(spark):
    requests = spark.createDataFrame([("/health", None), ("/admin/logs", 4.0)], "path string, ms double")
    kept = settings.logged(requests, ("/health",)).select(settings.log_detail(F.lit(None).cast("string"), F.col("ms")).alias("d")).collect()
    assert [r.d for r in kept] == ['{"query_params":null,"elapsed_ms":4.0}']
