import random

from pyspark.sql import functions as F

from sheaf.operators import blocks
from sheaf.operators.blocks import BlockIndex
from sheaf.operators.search import KeywordIndex, bm25_topk


def corpus(spark, n=600):
    """Rare words in few short chunks, common ones in all; equal chunks too."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([rng.choice(words[: rng.choice([5, 20, 60])]) for _ in range(rng.choice([3, 10, 40, 200]))] + ["all"])) for i in range(n)]
    rows += [(n + i, "rare rare w1") for i in range(5)] + [(n + 10, None), (n + 11, "")]
    return spark.createDataFrame(rows, "chunk_id long, content string")


ASKED = [["rare", "w1"], ["w3", "w3", "w50", "all"], ["all"], ["none"], ["w0", "w7", "w22", "w59"]]


def test_many_queries_give_what_one_gives_and_read_less(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(blocks, "WINDOW", 8)
    index = KeywordIndex.build(corpus(spark), "chunk_id", "content").save(str(tmp_path / "i"))
    held = BlockIndex.build(index, str(tmp_path / "b"))
    assert held.blocks.agg(F.sum(F.size("held")), F.max(F.size("held"))).first()[0] == index.postings.count()
    queries = spark.createDataFrame([(i, q) for i, q in enumerate(ASKED)], "query_id int, terms array<string>")
    found = {}
    for r in held.search(queries, 6).collect():
        found.setdefault(r.query_id, []).append((r.kw_rank, r.id, r.score))
    for i, q in enumerate(ASKED):
        one = [(r.kw_rank, r.id, r.score) for r in bm25_topk(index, q, 6).collect()]
        assert sorted(found.get(i, [])) == sorted(one), q
    # postings read, of those of the terms
    asked = held.asked(queries)
    first, rest = held.plan(asked, 6)
    count = lambda rows: {r.query_id: r.n for r in rows.groupBy("query_id").agg(F.sum(F.size("held")).alias("n")).collect()}
    read, whole = count(held.touched(asked, first.unionByName(rest))), count(held.touched(asked, held.bounds(asked).select("query_id", "window")))
    assert read[0] < whole[0] / 3 and read[1] < whole[1] / 2 and all(read[i] <= whole[i] for i in whole)


def test_fewer_hits_than_asked_for(spark, tmp_path):
    index = KeywordIndex.build(corpus(spark, 20), "chunk_id", "content")
    held = BlockIndex.build(index, str(tmp_path))
    queries = spark.createDataFrame([(0, ["rare"]), (1, [])], "query_id int, terms array<string>")
    assert sorted(r.id for r in held.search(queries, 50).collect()) == [20, 21, 22, 23, 24]
