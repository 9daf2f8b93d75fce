import hashlib
import random
import zlib

import pytest
from oracle import SMALL, assert_same
from pyspark.sql import functions as F
from trouble import documents, empty

from sheaf.llm import manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def steps(tree, i):
    for level in tree[:-1]:
        run, at = level[i // 8 * 8 : i // 8 * 8 + 8], i % 8
        yield "".join(run[:at]), "".join(run[at + 1 :])
        i //= 8


def lower(text):
    return text and "".join(c.lower() if c.isascii() else c for c in text)


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    top = levels([trees[g][-1][0] for g in names])
    out = []
    for at, g in enumerate(names):
        for i, (_, _, own, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            way = [*steps(trees[g], i), *steps(top, at)]
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            told = leaf((*r[:4], lower(r[4]))) if bad else own
            for a, b in way:
                told = sha(a + told + b)
            out.append((r[0], own, trees[g][-1][0], top[-1][0], sha("".join(a + b for a, b in way)), told, told == top[-1][0]))
    return sorted(out, key=str)


def found(df):
    docs = df.select("doc_id", "source", "lang", "n_chars", "text")
    rows = [tuple(r) for r in docs.collect()]
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    made = manifest.manifest(df, manifest.FIELDS, tampered={"text": F.translate("text", manifest.UPPER, manifest.LOWER)}, when=third)
    return rows, sorted([tuple(r) for r in made.collect()], key=str)


def test_op12_gives_what_sql_gives(spark):
    assert_same(spark, manifest.op12_manifest, manifest.ORACLE["op12_manifest"], SMALL)


@pytest.mark.parametrize("groups,n,copy", [(1, 1, 512), (1, 65, 16), (3, 150, 16), (70, 300, 8)])
def test_proofs_are_those_of_brute_force(spark, monkeypatch, groups, n, copy):
    monkeypatch.setattr(manifest, "COPY", copy)
    rng = random.Random(n)
    rows = [(i, "s", rng.choice([None, *(f"l{g}é" for g in range(groups - 1))]) if rng.random() < 0.6 else None, i, rng.choice(["Text", "text", None, "", "Ünï"])) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)
    given, out = found(docs)
    assert out == brute(given)
    bad = [r for r in out if not r[6]]
    assert n < 60 or 0 < len(bad) < n / 2


def test_nulls_repeated_rows_and_clashing_names(spark):
    docs = documents(spark, [*enumerate(["A b", None, "", "x" * 30_000]), (2, "again"), (2, "again"), (None, "Of none"), (None, None)]).withColumns({"_g": F.lit(1), "_i": F.lit(2), "_level": F.lit("x"), "_h": F.lit(3), "root": F.lit("r")})
    given, out = found(docs)
    assert out == brute(given) and len(out) == 8
    assert manifest.manifest(empty(spark), manifest.FIELDS).count() == 0
    assert all(r.verified for r in manifest.manifest(docs, manifest.FIELDS).collect())


def test_no_copy_of_a_run_serves_many_leaves(spark, monkeypatch):
    monkeypatch.setattr(manifest, "COPY", 16)
    asked = []
    monkeypatch.setattr(manifest, "siblings", (lambda f: lambda *a: asked.append(f(*a)) or asked[-1])(manifest.siblings))
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.lit(1).alias("n_chars"), F.lit("t").alias("text"))
    assert manifest.manifest(docs, manifest.FIELDS).count() == 400
    most = asked[-1].withColumn("copy", F.floor(F.col("_i") / 16)).groupBy("_level", "copy").count().agg(F.max("count")).first()[0]
    assert most == 16
