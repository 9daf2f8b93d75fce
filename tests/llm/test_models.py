import math
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from trouble import documents, empty, texts

from sheaf.llm import ctw, langid, neighbours

SMALL = "/root/testdata/sf0.001"


def test_language_accuracy(spark):
    truth = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang")
    rows = langid.op2_language_id(spark, SMALL).join(truth, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 200 and sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_language_trouble(spark):
    docs = documents(spark)
    model = langid.fit(docs, F.lit(True))
    rows = langid.identify(docs, model).collect()
    assert {r.doc_id for r in rows if r.lang_pred == "und"} == {0, 1, 2, 4, 7}
    assert len(rows) == docs.count() and model.languages == ["en"]
    nothing = langid.fit(empty(spark), F.lit(True))
    assert {r.lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"}
    assert langid.identify(empty(spark), model).count() == 0


def test_driver_gives_back_the_table_of_a_fit(spark):
    assert langid.fit(documents(spark, [(i, t) for i, t in enumerate(texts())]).withColumn("lang", F.lit("a")), F.lit(True)).languages
    assert langid.Slots.table is None  # 67 MB


def test_presence_kernel():
    a, b = langid.presence(b"Abc, abd"), langid.presence(b"abcabd")
    grams = lambda t: {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    assert len(a) == len(grams(b"abc  abd")) and len(np.intersect1d(a, b)) == len(grams(b"abc  abd") & grams(b"abcabd"))


def test_language_model_is_ridge_regression_on_nystroem_features():
    rng = np.random.default_rng(6)
    texts = ["".join(rng.choice(list("abcde" if i % 2 else "defgh"), rng.integers(3, 30))) for i in range(40)]
    labels = ["x" if i % 2 else "y" for i in range(40)]
    model = langid.Model([langid.presence(t.encode()) for t in texts], labels, landmarks=10)
    grams = lambda t: {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    marks = [t for lang in ("x", "y") for t in [t for t, own in zip(texts, labels, strict=True) if own == lang][:5]]
    held = set().union(*map(grams, marks))
    kernel = lambda a, b: np.array([[len(grams(s) & grams(t)) / math.sqrt(len(grams(s)) * len(grams(t) & held)) for t in b] for s in a])
    values, vectors = np.linalg.eigh(kernel(marks, marks))
    half = vectors / np.sqrt(values)
    x = kernel(texts, marks) @ half
    y = np.where(np.array(labels)[:, None] == np.array(["x", "y"]), 1.0, -1.0)
    w = half @ np.linalg.solve(x.T @ x + langid.RIDGE * len(texts) * np.eye(x.shape[1]), x.T @ y)
    asked = ["".join(rng.choice(list("abcdefgh"), 12)) for _ in range(30)]
    value = kernel(asked, marks) @ w
    names, scores = model.predict(asked)
    assert names == [("x", "y")[k] for k in value.argmax(1)]
    share = np.exp(langid.SHARP * value) / np.exp(langid.SHARP * value).sum(1, keepdims=True)
    assert np.allclose(scores, share.max(1), atol=1e-3)


def kt(n0, n1):
    return math.lgamma(n0 + 0.5) + math.lgamma(n1 + 0.5) - math.log(math.pi) - math.lgamma(n0 + n1 + 1)


class Tree:
    """Context-tree weighting by recursion, for tests."""

    def __init__(self, data, depth):
        self.depth, self.counts = depth, {}
        for text in data:
            full = b"\xff" * depth + text + b"\xff"
            for i in range(depth, len(full)):
                for bit in range(8):
                    for d in range(depth + 1):
                        node = self.counts.setdefault((full[i - d : i], bit, full[i] >> (8 - bit)), [0, 0])
                        node[full[i] >> (7 - bit) & 1] += 1
        self.children = {}
        for c, bit, p in self.counts:
            if c:
                self.children.setdefault((c[1:], bit, p), set()).add((c, bit, p))
        self.memo = {}

    def log_p(self, node):
        if node not in self.memo:
            own = kt(*self.counts[node])
            self.memo[node] = own if len(node[0]) == self.depth else np.logaddexp(math.log(0.5) + own, math.log(0.5) + sum(self.log_p(c) for c in self.children[node]))
        return self.memo[node]

    def score(self, text):
        full, total = b"\xff" * self.depth + text + b"\xff", 0.0
        for i in range(self.depth, len(full)):
            for bit in range(8):
                p, one = 0.5, full[i] >> (7 - bit) & 1
                for d in range(self.depth, -1, -1):
                    node = (full[i - d : i], bit, full[i] >> (8 - bit))
                    if node in self.counts:
                        n = self.counts[node]
                        w = 1.0 if d == self.depth else math.exp(math.log(0.5) + kt(*n) - self.log_p(node))
                        p = w * (n[one] + 0.5) / (sum(n) + 1) + (1 - w) * p
                total += math.log10(p)
        return total


@pytest.mark.parametrize("depth", [2, 4])
def test_scores(spark, depth):
    rows = [(i, (t or "")[:120] if t is not None else None) for i, t in enumerate(texts(25))] + [(3, "word")]
    learn = F.col("doc_id") % 3 != 1
    found = ctw.score_texts(documents(spark, rows), learn, depth=depth).collect()
    lower = lambda t: (t or "").encode().lower()
    tree = Tree([lower(t) for i, t in rows if i % 3 != 1], depth)
    counts = Counter(w for i, t in rows if i % 3 != 1 for w in [*lower(t).split(), None])
    n, v = sum(counts.values()), len(counts)
    expected = []
    for i, t in rows:
        words = [*lower(t).split(), None]
        expected.append((i, len(words), sum(counts[w] > 0 for w in words), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words), tree.score(lower(t))))
    got = sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in found)
    for a, b in zip(got, sorted(expected), strict=True):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], rel=1e-5)


def test_scores_without_learning(spark):
    docs = documents(spark, [(1, "ab"), (2, None)])
    rows = {r.doc_id: r for r in ctw.score_texts(docs, F.lit(False)).collect()}
    assert rows[1].score == pytest.approx(3 * 8 * math.log10(0.5)) and rows[2].n_tokens == 1 and rows[1].train_tokens == 0
    assert ctw.score_texts(empty(spark), F.lit(True)).count() == 0


@given(st.lists(st.floats(0.5, 1e6), min_size=1, max_size=20))
def test_log_gamma(xs):
    assert np.allclose(ctw.log_gamma(np.array(xs)), [math.lgamma(x) for x in xs], rtol=1e-10, atol=1e-9)


VECTORS = "vec_id long, embedding array<float>, label int, b int, q boolean, id long"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, True, 2) for i, v in rows], VECTORS)


def test_neighbours_recall(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 16)).astype(np.float32)
    table = vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    found = neighbours.nearest_neighbours(table, table.where("vec_id % 100 = 0"), block=700).collect()
    assert len(found) == 300
    hits = 0
    for q in range(0, 3000, 100):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        own = sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 11)) and all(abs(r.score - d[r.vec_id]) < 1e-12 for r in own)
        hits += len({r.vec_id for r in own} & set(np.lexsort((np.arange(3000), d))[:10]))
    assert hits >= 0.9 * 300


def test_neighbours_trouble(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [float("inf"), 1.0]), (7, []), (8, [2.0, 0.0]), (9, [2.0, 0.0]), (9, [2.0, 0.0]), (10, [1.0, 1.0, 1.0]), (None, [1.0, 0.0]), (100, [1.0, 0.5]), (100, [1.0, 0.5])]
    table = vectors(spark, rows)
    found = neighbours.nearest_neighbours(table, table.where("vec_id % 100 = 0"), k=3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in found] == [(0, 1, 1), (0, 2, 100), (0, 3, 8), (100, 1, 0), (100, 2, 1), (100, 3, 8)]
    assert found[0].score == 0.0
    nothing = vectors(spark, [])
    assert neighbours.nearest_neighbours(nothing, nothing).count() == 0 == neighbours.nearest_neighbours(table, nothing).count()


def test_neighbours_of_a_vector_that_many_rows_have(spark):
    rng = np.random.default_rng(3)
    hub = [1.0, 2.0, 0.0, -3.0]
    rows = [(i, hub if i % 3 else [float(x) for x in rng.standard_normal(4) * 3]) for i in range(3000)] + [(1, hub)] * 40
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    kept = neighbours.foremost(table.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 11)
    assert sorted(r.id for r in kept.where(F.col("v") == F.array(*map(F.lit, hub))).collect()) == [i for i in range(17) if i % 3]
    assert kept.count() == 1000 + 11
    # the limit stands below the shuffle as well as above
    plan = kept._jdf.queryExecution().optimizedPlan().toString() + kept._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan[plan.index("Exchange") :]
    found = neighbours.nearest_neighbours(table, table.where("vec_id % 100 = 0 or vec_id = 2"), block=100).collect()
    ids, x = np.arange(3000), np.array([r[1] for r in rows[:3000]])
    for q in {r.query_id for r in found}:
        dist = np.sqrt(np.cumsum((x - x[q]) ** 2, axis=1)[:, -1])
        order = np.lexsort((ids, dist))
        expected = order[order != q][:10].tolist()
        assert [r.vec_id for r in sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)] == expected
    assert {r.query_id for r in found} == {2, *range(0, 3000, 100)}


def test_neighbours_prune_cells(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL", 4)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((20, 24))[rng.integers(0, 20, 2000)] * 20 + rng.standard_normal((2000, 24))
    table = vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    x = x.astype(np.float32).astype(float) if table.schema["embedding"].dataType.simpleString() == "array<float>" else x
    found = neighbours.nearest_neighbours(table, table.where("vec_id % 100 = 0"), block=100).collect()
    hits = 0
    for q in range(0, 2000, 100):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len({r.vec_id for r in found if r.query_id == q} & set(np.argsort(d)[:10].tolist()))
    assert len(found) == 200 and hits >= 0.95 * 200
    points = x @ neighbours.projection(24, 10, 7)
    cells = neighbours.Cells(points, 20, 10)
    own = cells.of(points)
    assert len(cells.low) == 20 and np.bincount(own).min() >= 4
    assert ((points >= cells.low[own]) & (points <= cells.high[own])).all()
    reach = [len(cells.within(p, 60.0)) for p in points[::100]]
    assert np.mean(reach) < 10  # most cells are ruled out


@settings(max_examples=30, deadline=None)
@given(st.floats(0.01, 0.999), st.integers(1, 40))
def test_chi_square(p, m):
    x = neighbours.chi_square_quantile(p, m)
    steps = np.linspace(0, x, 20001)[1:] - x / 40000
    density = np.exp((m / 2 - 1) * np.log(steps) - steps / 2 - m / 2 * math.log(2) - math.lgamma(m / 2))
    assert density.sum() * x / 20000 == pytest.approx(p, abs=0.02)


LETTERLESS = ["²³", "½ 12", "Ⅷ", "́̈", "① ㊂", "__ 9", "\U0001f600", ""]


def test_letters_are_those_of_category_l(spark):
    """The rule of prediction is that of fitting, which Spark's \\p{L} is."""
    import unicodedata

    from sheaf.llm import langid

    assert not any(map(langid.has_letter, [None, *LETTERLESS])) and all(map(langid.has_letter, ["ª", "ʰ", "²a", "日", "ǅ", "½é"]))
    signs = [chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    assert [langid.has_letter(c) for c in signs] == [unicodedata.category(c).startswith("L") for c in signs]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate([*LETTERLESS, "some words here", "more words"])], "doc_id long, text string, lang string")
    found = langid.identify(docs, langid.fit(docs, F.lit(True)), "text").collect()
    assert [r.lang_pred for r in sorted(found, key=lambda r: r.doc_id)] == ["und"] * len(LETTERLESS) + ["en"] * 2
    assert langid.lettered(docs).count() == 2
