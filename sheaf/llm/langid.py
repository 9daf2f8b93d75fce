"""Language identification by string kernels: blended-spectrum presence kernels, Nystroem landmarks, one-versus-rest kernel ridge regression.

The kernel of two texts is the number of n-grams of bytes, of lengths 1 to ORDERS, that both hold, over the geometric mean
of how many each holds. Training texts are a bounded sample, drawn evenly from the labelled languages; landmarks are some
of them. Texts are scored in batches: presence of the landmarks' n-grams times the landmarks, times the regression.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .chunks import trim
from .common import read_table, small_batches

ORDERS = 3
#: Bounds of the training sample: texts of a language, and landmarks in all.
PER_LANGUAGE = 400
LANDMARKS = 128
RIDGE = 1e-3
#: How sharply regression values become a score.
SHARP = 4.0
UNKNOWN = "und"
#: Texts of one matrix product.
BATCH = 64
_WORDLIKE = re.compile(r"[^\W\d_]")
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[b for b in range(128) if not 97 <= _FOLD[b] <= 122]] = 32


def has_letter(text: str | None) -> bool:
    """Whether a text has a sign of Unicode category L; numbers such as a superscript or a Roman numeral sign are none, nor are marks."""
    return bool(text) and any(m.group().isalpha() for m in _WORDLIKE.finditer(text))


def presence(text: bytes) -> np.ndarray:
    """Sorted codes of the n-grams that a text holds; A-Z in lower case, other ASCII signs as space."""
    data = _FOLD[np.frombuffer(text, np.uint8)].astype(np.int32)
    found, code = [], np.zeros(len(data), np.int32)
    for n in range(1, ORDERS + 1):
        if len(data) < n:
            break
        code = (code[: len(data) - n + 1] << 8) | data[n - 1 :]
        found.append(code + sum(256**k for k in range(1, n)))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int32)


class Slots:
    """Where each n-gram's code is among a model's: one table, given back after a task, since workers live on and it is large."""

    table, codes = None, np.zeros(0, np.int32)

    @classmethod
    def of(cls, codes: np.ndarray) -> np.ndarray:
        if cls.table is None:
            cls.table = np.full(sum(256**k for k in range(1, ORDERS + 1)), -1, np.int32)
        if cls.codes is not codes:
            cls.table[cls.codes] = -1
            cls.table[codes] = np.arange(len(codes))
            cls.codes = codes
        return cls.table

    @classmethod
    def clear(cls) -> None:
        cls.table, cls.codes = None, np.zeros(0, np.int32)


class Model:
    """Landmarks and regression; predicts languages of texts."""

    def __init__(self, samples: list[np.ndarray], labels: list[str], landmarks: int = LANDMARKS):
        self.languages = sorted(set(labels))
        chosen = [i for lang in self.languages for i in [k for k, x in enumerate(labels) if x == lang][: max(1, landmarks // len(self.languages))]]
        self.codes = np.unique(np.concatenate([samples[i] for i in chosen])) if chosen else np.zeros(0, np.int32)
        self.points = np.zeros((len(chosen), len(self.codes)), np.float32)
        for r, i in enumerate(chosen):
            self.points[r, np.searchsorted(self.codes, samples[i])] = 1
        self.sizes = np.maximum(self.points.sum(1), 1)
        if chosen:
            near = self.kernel([samples[i] for i in chosen]).astype(float)
            values, vectors = np.linalg.eigh((near + near.T) / 2)
            keep = values > 1e-8 * values[-1]
            half = vectors[:, keep] / np.sqrt(values[keep])
            features = self.kernel(samples).astype(float) @ half
            target = np.where(np.array(labels)[:, None] == np.array(self.languages), 1.0, -1.0)
            solved = np.linalg.solve(features.T @ features + RIDGE * len(samples) * np.eye(features.shape[1]), features.T @ target)
            self.weights = (half @ solved).astype(np.float32)

    def kernel(self, samples: list[np.ndarray]) -> np.ndarray:
        """Kernel of each text with each landmark."""
        slots = Slots.of(self.codes)
        out = np.empty((len(samples), len(self.points)), np.float32)
        for i in range(0, len(samples), BATCH):
            own = samples[i : i + BATCH]
            held = np.zeros((len(own), len(self.codes)), np.float32)
            for r, s in enumerate(own):
                at = slots[s]
                held[r, at[at >= 0]] = 1
            out[i : i + BATCH] = held @ self.points.T / np.sqrt(np.array([[max(1, len(s))] for s in own], np.float32) * self.sizes)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; UNKNOWN and 0 for a text without a letter. Of languages with one value the first by name is taken."""
        lettered = [i for i, t in enumerate(texts) if has_letter(t)] if self.languages else []
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if lettered:
            value = self.kernel([presence(texts[i].encode()) for i in lettered]) @ self.weights
            share = np.exp(SHARP * (value - value.max(1, keepdims=True)).astype(float))
            share /= share.sum(1, keepdims=True)
            best = share.argmax(1)
            for i, b, s in zip(lettered, best.tolist(), share[np.arange(len(best)), best].tolist(), strict=True):
                names[i], scores[i] = self.languages[b], s
        return names, scores


def fit(docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS) -> Model:
    """Learn from rows that `learn` admits and whose text and language are not null: up to per_language texts a language, drawn by a hash of the id.

    The driver gets n-grams of per_language texts a language at most. Without labelled rows the model knows no language.
    """
    small_batches(docs.sparkSession)
    mark = F.xxhash64(F.col(id_col).cast("string"), F.lit("sample"))
    rows = docs.where(F.coalesce(learn, F.lit(False)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).agg(F.count("*")).collect()}  # a row for each language
    if not counts:
        return Model([], [])
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 2 * (per_language + 20) / n))])
    drawn = rows.where((mark.cast("double") / F.lit(2.0**64) + 0.5) <= share[F.col(lang_col)])
    drawn = drawn.select(F.col(lang_col).alias("lang"), mark.alias("_mark"), F.col(text_col).cast("binary").alias("_text"))
    drawn = drawn.withColumn("_rank", F.row_number().over(Window.partitionBy("lang").orderBy("_mark", F.xxhash64("_text")))).where(F.col("_rank") <= per_language)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([presence(t).tobytes() for t in batch.column(2).to_pylist()], pa.binary())], ["lang", "_mark", "codes"])

    found = sorted((r["lang"], r["_mark"], bytes(r["codes"])) for r in drawn.drop("_rank").mapInArrow(seen, "lang string, _mark long, codes binary").collect())
    model = Model([np.frombuffer(c, np.int32) for _, _, c in found], [lang for lang, _, _ in found], landmarks)
    del found
    Slots.clear()  # of the driver
    trim()
    return model


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score added; a null text, or one without a letter, gives `und` and 0.

    Columns of docs named lang_pred or score are replaced. Repeated rows are predicted each; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the landmarks
    at, names = docs.columns.index(text_col), [*docs.columns, "lang_pred", "score"]

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = sent.value.predict(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names)
        Slots.clear()
        trim()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(predicted, f"{kinds}, lang_pred string, score double")


def lettered(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows of docs whose text has a letter, by the rule of Model.predict()."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([has_letter(t) for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)


def remainder(column: str = "doc_id", n: int = 3) -> Column:
    """crc32 of an id as text, modulo n."""
    return F.crc32(F.col(column).cast("string")) % n


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs, remainder() != 1)
    rows = identify(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", (remainder() == 1).alias("held_out"), "lang_pred", "score")


QUERIES = {"op2_language_id": op2_language_id}
ORACLE: dict[str, str] = {}
