"""Documents that cause trouble: nulls, empty and long texts, ties, repeated rows, and extra columns with clashing names."""

import random

EXTRA = "doc_id long, text string, lang string, source string, n_chars long, _id long, _text string, kind int, chunk long, part int, fp long, kept string, length long, score double, kind2 string"


def texts(n=60, seed=3):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "delta", "ééé", "x", "The", "of"]
    passage = " ".join(rng.choice(words) for _ in range(30))
    out = [None, "", "   ", "word", "\n\t", "ß", "日本語 text", "1234 !!", "a b", "a b", "a" * 20_000, "na " * 500]
    for _ in range(n):
        t = " ".join(rng.choice(words) for _ in range(rng.randint(1, 80)))
        kind = rng.random()
        out.append(f"{t}\n{passage}" if kind < 0.3 else f"{passage} {t} {passage}" if kind < 0.4 else out[-1] if kind < 0.5 else t)
    return out


def documents(spark, rows=None, schema=EXTRA):
    rows = list(enumerate(texts())) if rows is None else rows
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, "s", None, 7, "other", 1, 2, 3, 4, "k", 5, 0.5, "x") for i, t in rows], schema)


def empty(spark):
    return spark.createDataFrame([], EXTRA)
