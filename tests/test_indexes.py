import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sheaf.functions.text import matches_any
from sheaf.operators import listing, trigrams
from sheaf.operators import ranks
from sheaf.operators.ranks import RankedTable
from sheaf.operators.trigrams import TrigramIndex, literal_runs, pattern_grams

PATTERNS = ["alpha", "ALP", "al_ha", "al%ta", "be%mma x", "a", "_", "%", "ab", r"50\%", r"a\_b", r"\\", "ĐIỀU", "điều 1", "no such", "", None, "   ", "ΑΣ", "İst"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    words = ["alpha", "beta", "Gamma x", "50% off", "a_b", "axb", "c\\d", "Điều 1", "điều 12", "ΑΣ", "İstanbul", "日本語"]
    made = [(i, None if i % 13 == 0 else " ".join(rng.choice(words) for _ in range(rng.randint(0, 3))), rng.choice(["", None, "ab", "alphabet", rng.choice(words)])) for i in range(400)]
    return spark.createDataFrame(made + [(1000, "x" * 50_000 + "alpha", None)], "id long, name string, code string").cache()


@pytest.fixture(scope="module")
def index(spark, rows, tmp_path_factory):
    made = TrigramIndex(spark, str(tmp_path_factory.mktemp("grams")), ["name", "code"])
    made.append(rows.where("id % 2 = 0"))
    made.append(rows.where("id % 2 = 1"))
    return made


@pytest.mark.parametrize("pattern", PATTERNS)
def test_search_by_trigrams_finds_what_a_scan_finds(rows, index, pattern):
    exact = matches_any(pattern, F.col("name"), F.col("code"))
    exact = F.lit(True) if exact is None else F.coalesce(exact, F.lit(False))
    expected = sorted(r.id for r in rows.where(exact).collect())
    assert sorted(r.id for r in index.narrow(rows, pattern).where(exact).collect()) == expected


def test_candidates_are_few(rows, index):
    assert index.candidates("ab") is None and index.candidates("a%b_c") is None  # no run of three
    assert index.candidates("no such").count() == 0
    hits = rows.where(matches_any("Điều 12", F.col("name"), F.col("code"))).count()
    assert 0 < hits == index.candidates("Điều 12").count() < rows.count() / 4  # its rarest trigrams are in no other row
    assert index.candidates("alp") is None  # in over a fifth of all rows: a scan takes less


@given(st.text("ab%_\\", max_size=12))
def test_runs_hold_no_wildcard(pattern):
    runs = literal_runs(pattern)
    plain = pattern.replace("\\\\", "").replace("\\%", "").replace("\\_", "")
    assert sum(map(len, runs)) <= len(pattern) and (plain.count("%") + plain.count("_") > 0 or len(runs) <= 1)
    assert all(len(g) == 3 for g in pattern_grams(pattern))


def test_listing_takes_the_index(rows, index):
    spec = listing.ListSpec("t", ("name", "code"))
    for pattern in ("50% off", "Điều"):
        plain = listing.page({"t": rows}, spec, 1, 50, search=pattern).collect()
        assert listing.page({"t": rows}, spec, 1, 50, trigrams=index, search=pattern).collect() == plain and plain
        assert listing.total({"t": rows}, spec, index, search=pattern).collect() == listing.total({"t": rows}, spec, search=pattern).collect()


def test_an_index_without_rows_narrows_nothing(spark, rows, tmp_path):
    assert TrigramIndex(spark, str(tmp_path / "none"), ["name"]).candidates("alpha") is None


def test_deep_pages(spark, tmp_path):
    table = spark.range(2_000_000).select(F.col("id"), (F.col("id") % 7).alias("kind"), F.lit("x").alias("name"))
    ranked = RankedTable.build(table, str(tmp_path), ("id",), range_rows=100_000)
    spec = listing.ListSpec("t", equal=("kind",))
    found = listing.page({}, spec, 100_000, 20, ranked=ranked)  # the last page
    assert [r.id for r in found.collect()] == list(range(19, -1, -1))
    assert max(n for _, n in ranked.counts()) < 300_000 and len(ranked.counts()) == 20
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    filters = [x for x in found._jdf.queryExecution().explainString(mode).split("\n") if x.startswith("PartitionFilters")]
    assert filters and all("_range" in x and "=" in x for x in filters)  # one range is read
    some = listing.page({}, spec, 3_000, 20, ranked=ranked, kind=3)
    assert [r.id for r in some.collect()] == [i for i in range(1_999_999, -1, -1) if i % 7 == 3][2_999 * 20 : 3_000 * 20]
    assert listing.page({}, spec, 100_001, 20, ranked=ranked).count() == 0
    with pytest.raises(ValueError):
        listing.page({}, listing.ListSpec("t", order=("name",)), 1, 20, ranked=ranked)


def test_pages_over_ranges(spark, tmp_path):
    """Pages that lie across ranges, an order of two columns, and an empty table."""
    made = [(i % 5, i) for i in range(103)]
    table = spark.createDataFrame(made, "a int, id long")
    ranked = RankedTable.build(table, str(tmp_path / "a"), ("a", "id"), range_rows=10)
    expected = sorted(made, reverse=True)
    for offset, size in ((0, 7), (8, 25), (95, 20), (0, 200), (103, 5)):
        assert [tuple(r) for r in ranked.slice(offset, size).collect()] == expected[offset : offset + size]
        assert [tuple(r) for r in ranked.slice(offset, size, F.col("a") != 2).collect()] == [r for r in expected if r[0] != 2][offset : offset + size]
    assert RankedTable.build(table.limit(0), str(tmp_path / "b"), ("id",)).counts() == []


def test_ranges_grow_in_place_of_their_number(spark, tmp_path, monkeypatch):
    """A page comes from ranges numbered within themselves, however many rows were asked for in a range."""
    monkeypatch.setattr(ranks, "RANGES", 4)
    ranked = RankedTable.build(spark.range(1000).select("id"), str(tmp_path), ("id",), range_rows=10)
    assert len(ranked.counts()) == 4
    page = ranked.slice(600, 20)
    assert [r.id for r in page.collect()] == list(range(399, 379, -1))
    assert "TakeOrdered" not in page._jdf.queryExecution().executedPlan().toString()  # which sends all rows before the page
