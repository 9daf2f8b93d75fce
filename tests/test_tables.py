import pytest
from pyspark.sql import functions as F

from sheaf.operators import mutate
from sheaf.operators.listing import LISTINGS, ListSpec, page, predicate, total
from sheaf.sources import files, schemas, snapshot
from sheaf.sources.schemas import TABLES
from sheaf.streaming import ingest

ROWS = "id long, name string, flag boolean, ref long"


def test_filters(spark):
    rows = {"t": spark.createDataFrame([(1, "A%b", False, 0), (2, None, True, 1), (3, "axb", True, None)], ROWS)}
    spec = ListSpec("t", ("name",), equal=("flag", "ref"), equal_text=("name",))
    ids = lambda **f: sorted(r.id for r in page(rows, spec, **f).collect())
    assert ids(search="a_b") == [1, 3]  # a wildcard
    assert ids(search="A\\%") == [1]
    assert ids(search="") == [1, 2, 3] == ids(name="")
    assert ids(flag=False) == [1] == ids(ref=0)
    assert total(rows, spec, search="A").first().total == 2
    for bad in ({"number": 0}, {"size": 101}, {"size": 0}):
        with pytest.raises(ValueError):
            page(rows, spec, **bad)
    with pytest.raises(ValueError):
        predicate(spec, other=1)


def test_listings_fit_the_schemas(spark):
    tables = {name: spark.createDataFrame([], schemas.schema(name)) for name in TABLES}
    for spec in LISTINGS.values():
        assert page(tables, spec, search="x").count() == 0


def test_page_plan(spark):
    tables = {name: spark.createDataFrame([], schemas.schema(name)) for name in ("system_logs",)}
    plan = page(tables, LISTINGS["system_logs"], 2, 10, action="x")._jdf.queryExecution().optimizedPlan().toString()
    assert "Limit" in plan and "Offset" in plan


def test_changes(spark):
    t = spark.createDataFrame([(1, "a", True, None), (2, "b", True, 1), (3, "c", False, 1)], ROWS)
    new = spark.createDataFrame([(4, "a", True, 1), (5, "d", True, 9), (6, "e", True, 2), (7, "e", True, 2)], ROWS)
    rules = mutate.Rules(unique=("name",), refs=(("ref", t, "id"),), parent="ref")
    after, refused = mutate.insert(t, new, rules)
    assert sorted(r.id for r in after.collect()) == [1, 2, 3, 6]
    assert {r.id: r.reason for r in refused.collect()} == {4: "409 name", 5: "404 ref", 7: "409 name"}
    changes = spark.createDataFrame([(1, "a", 1), (2, None, None), (3, "b", None), (8, "z", None)], "id long, name string, ref long")
    after, refused = mutate.update(t, changes, rules)
    assert {r.id: r.reason for r in refused.collect()} == {1: "400 ref", 3: "409 name", 8: "404 id"}
    assert {r.id: (r.name, r.ref) for r in after.collect()} == {1: ("a", None), 2: ("b", 1), 3: ("c", 1)}
    cleared, _ = mutate.update(t, spark.createDataFrame([(2, None)], "id long, ref long"), mutate.Rules(), clears=("ref",))
    assert {r.id: r.ref for r in cleared.collect()} == {1: None, 2: None, 3: 1}
    keys = spark.createDataFrame([(1,), (3,), (3,), (5,)], "id long")
    after, refused = mutate.delete(t, keys, guards=((t, "ref"),))
    assert sorted(r.id for r in after.collect()) == [1, 2]
    assert {r.id: r.reason for r in refused.collect()} == {1: "400 in use", 5: "404 id"}
    assert {r.id: r.flag for r in mutate.toggle(t, keys, "flag", own=3).collect()} == {1: False, 2: True, 3: False}


def test_snapshot(spark, tmp_path):
    users = spark.sql("SELECT 1L id, 'ü' username, CAST(NULL AS STRING) email, TIMESTAMP_NTZ'2026-01-02 03:04:05.5' created_at, true is_active")
    folder = snapshot.backup({"users": users}, str(tmp_path), "b1")
    back = snapshot.restore(spark, folder, ["users", "positions"])
    assert back["users"].columns == schemas.schema("users").names
    row = back["users"].first()
    assert (row.id, row.username, row.email, str(row.created_at), row.role) == (1, "ü", None, "2026-01-02 03:04:05.500000", None)
    assert back["positions"].count() == 0
    assert snapshot.list_backups(spark, str(tmp_path)) == ["b1"] and snapshot.list_backups(spark, f"{tmp_path}/none") == []
    assert files.folder_size(spark, folder).first().files >= 1 and files.folder_size(spark, f"{tmp_path}/none").first().files == 0


def test_an_append_holds_each_id_once_and_refuses_two_contents(spark, tmp_path):
    store = str(tmp_path / "store")
    chunks = lambda *rows: spark.createDataFrame([(i, c, {}) for i, c in rows], schemas.CHUNKS)
    vectors = lambda *ids: spark.createDataFrame([(i, [float(n)]) for n, i in enumerate(ids)], schemas.VECTORS)
    files.append_store(chunks((1, "a"), (1, "a"), (2, "b"), (None, "x"), (None, "x")), vectors(1, 1, 2, None), store)
    kept, points = files.read_store(spark, store)
    assert sorted((r.chunk_id or 0, r.content) for r in kept.collect()) == [(0, "x"), (0, "x"), (1, "a"), (2, "b")]
    assert sorted(r.chunk_id or 0 for r in points.collect()) == [0, 1, 2]
    for bad in (((2, "other"), (3, "c")), ((4, "d"), (4, "e"))):
        with pytest.raises(ValueError, match="more than one content"):
            files.append_store(chunks(*bad), vectors(*[i for i, _ in bad]), store)
        assert files.read_store(spark, store)[0].count() == 4
    files.append_store(chunks((2, "b"), (3, None)), vectors(2, 3), store)
    assert files.read_store(spark, store)[0].count() == 5


def test_store_in_snapshots(spark, tmp_path):
    store, kept = str(tmp_path / "store"), str(tmp_path / "kept")
    chunks = lambda *ids: spark.createDataFrame([(i, f"c{i}", {}) for i in ids], schemas.CHUNKS)
    vectors = lambda *ids: spark.createDataFrame([(i, [float(i)]) for i in ids], schemas.VECTORS)
    held = lambda: [sorted(r.chunk_id for r in t.collect()) for t in files.read_store(spark, store)]
    files.append_store(chunks(1, 2), vectors(1, 2), store)
    chunks(3).write.mode("append").parquet(f"{store}/chunks")  # an append that failed midway
    files.append_store(chunks(2, 3), vectors(2, 3), store)
    assert held() == [[1, 2, 3], [1, 2, 3]]
    users = spark.sql("SELECT 1L id, 'u' username")
    folder = snapshot.backup({"users": users}, kept, "b1", store, 7)
    plain = snapshot.backup({"users": users}, kept, "b2")
    (tmp_path / "kept" / "b0" / "users").mkdir(parents=True)
    rows = snapshot.backup_listing(spark, kept).collect()
    assert [(r.name, r.tables, r.created_by, r.has_store, r.has_manifest) for r in rows] == [("b2", "users", None, False, True), ("b1", "users", 7, True, True), ("b0", "users", None, False, False)]
    assert all(r.created_at is not None for r in rows)
    files.append_store(chunks(4), vectors(4), store)
    assert not snapshot.restore_store(spark, plain, store) and held()[0] == [1, 2, 3, 4]
    assert snapshot.restore_store(spark, folder, store) and held() == [[1, 2, 3], [1, 2, 3]]
    assert not snapshot.restore_store(spark, f"{kept}/none", store)
    with pytest.raises(FileNotFoundError):
        snapshot.restore(spark, f"{kept}/none")
    assert snapshot.backup_listing(spark, f"{kept}/none").count() == 0


def test_history(spark, tmp_path):
    assert files.read_history(spark, f"{tmp_path}/none.json").count() == 0
    (tmp_path / "h.json").write_text('[{"filename": "a", "summary": "s", "timestamp": "2026-01-01 00:00:00"}]')
    old = files.read_history(spark, f"{tmp_path}/h.json")
    new = spark.createDataFrame([(f"f{i}", "x", f"2026-02-01 00:00:{i:02}") for i in range(25)], schemas.HISTORY)
    kept = files.append_history(old, new).collect()
    assert len(kept) == 20 and kept[0].filename == "f24"
    (tmp_path / "bad.json").write_text("{not json")
    assert files.read_history(spark, f"{tmp_path}/bad.json").count() == 0


READERS = {"pdf": lambda b: b.decode().split("\f"), "image": lambda b: [b.decode()]}


def test_files_and_ingestion(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.PDF").write_text("Điều 1. Một\n\fĐiều 2. Hai")
    (source / "b.png").write_text("  ảnh ")
    (source / "c.txt").write_text("x")
    found = {r.path.rsplit("/", 1)[1]: (r.text, r.error) for r in files.extract_text(files.read_files(spark, str(source)), READERS).collect()}
    assert found == {"a.PDF": ("--- Page 1 ---\nĐiều 1. Một\n\n--- Page 2 ---\nĐiều 2. Hai", None), "b.png": ("ảnh", None), "c.txt": (None, files.UNSUPPORTED)}
    store = str(tmp_path / "store")
    assert all(t.count() == 0 for t in files.read_store(spark, store))
    ingest.watch(spark, str(source), READERS, lambda ts: [[float(len(t)), 1.0] for t in ts], store, str(tmp_path / "cp")).awaitTermination()
    chunks, vectors = files.read_store(spark, store)
    assert chunks.count() == 3 == vectors.count()
    assert {(r.d, r.k) for r in chunks.select(F.col("metadata")["dieu"].alias("d"), F.col("metadata")["khoan"].alias("k")).collect()} == {("1", None), ("2", None), (None, None)}
    ingest.watch(spark, str(source), READERS, lambda ts: [[0.0] for _ in ts], store, str(tmp_path / "cp")).awaitTermination()
    assert files.read_store(spark, store)[0].count() == 3  # nothing is taken twice


def test_request_rates_on_a_stream(spark, tmp_path):
    logs = spark.sql("SELECT 'GET' action, '{\"elapsed_ms\": 4}' detail, TIMESTAMP_NTZ'2026-01-01 00:01:00' created_at UNION ALL SELECT 'GET', '{\"elapsed_ms\": 8}', TIMESTAMP_NTZ'2026-01-01 00:02:00'")
    logs.write.parquet(f"{tmp_path}/logs")
    stream = spark.readStream.schema(logs.schema).parquet(f"{tmp_path}/logs")
    q = ingest.request_rates(stream).writeStream.outputMode("complete").format("memory").queryName("rates").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.requests, r.mean_elapsed_ms) for r in spark.table("rates").collect()] == [(2, 6.0)]


def test_export_without_a_workbook_library(spark, tmp_path):
    rows = spark.range(1)
    try:
        import openpyxl  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError):
            snapshot.write_workbook(rows, f"{tmp_path}/x.xlsx")


def test_changes_of_one_key_and_refused_changes(spark):
    from sheaf.operators import mutate

    table = spark.createDataFrame([(1, "a", 7), (2, "b", 7)], "id long, code string, ref long")
    refs = spark.createDataFrame([(7,)], "id long")
    rules = mutate.Rules(unique=("code",), refs=(("ref", refs, "id"),))
    new = spark.createDataFrame([(1, "x", 7), (3, "c", 9), (4, "c", 7), (5, "c", 7), (6, None, 7), (6, None, 7), (8, "a", None), (9, None, 7)], "id long, code string, ref long")
    rows, refused = mutate.insert(table, new, rules)
    assert sorted(r.id for r in rows.collect()) == [1, 2, 4, 6, 9]
    assert sorted((r.id, r.reason) for r in refused.collect()) == [(1, "409 id"), (3, "404 ref"), (5, "409 code"), (6, "409 id"), (8, "409 code")]
    changes = spark.createDataFrame([(1, "y"), (1, "z"), (2, "a"), (9, "q")], "id long, code string")
    rows, refused = mutate.update(table, changes, rules)
    assert sorted((r.id, r.code) for r in rows.collect()) == [(1, "y"), (2, "b")]
    assert sorted((r.id, r.reason) for r in refused.collect()) == [(1, "409 id"), (2, "409 code"), (9, "404 id")]
    assert sorted((r.id, r.code) for r in mutate.upsert(table.drop("ref"), changes, "id").collect()) == [(1, "y"), (2, "a"), (9, "q")]
