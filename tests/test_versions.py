import pytest
from pyspark.sql import functions as F

from sheaf.sources import snapshot, versions
from sheaf.sources.files import append_store, read_store
from sheaf.sources.schemas import CHUNKS, VECTORS, schema
from sheaf.sources.versions import Conflict, Warehouse

NAMES = ("permission_groups", "issuing_units", "departments")


def groups(spark, n):
    return spark.createDataFrame([(i, f"g{i}", f"c{i}", None, True, None, None) for i in range(n)], schema("permission_groups"))


def store(spark, n):
    return spark.createDataFrame([(i, f"t{i}", {"a": "b"}) for i in range(n)], CHUNKS), spark.createDataFrame([(i, [1.0, float(i)]) for i in range(n)], VECTORS)


def made(spark, tmp_path):
    """A warehouse with two groups and two chunks, and a snapshot with five of each."""
    append_store(*store(spark, 5), str(tmp_path / "store"))
    folder = snapshot.backup({"permission_groups": groups(spark, 5)}, str(tmp_path / "backups"), "b", str(tmp_path / "store"))
    house = Warehouse(spark, str(tmp_path / "house"))
    chunks, vectors = store(spark, 2)
    house.replace({"permission_groups": groups(spark, 2), "chunks": chunks, "vectors": vectors, "kept": spark.range(3).toDF("x")})
    return house, folder


def state(house):
    return {name: rows.count() for name, rows in house.tables().items()}


OLD = {"permission_groups": 2, "chunks": 2, "vectors": 2, "kept": 3}
NEW = {"permission_groups": 5, "issuing_units": 0, "departments": 0, "chunks": 5, "vectors": 5, "kept": 3}


def test_a_snapshot_takes_the_place_of_all_tables_at_once(spark, tmp_path):
    house, folder = made(spark, tmp_path)
    read_before = house.tables()
    assert state(house) == OLD and snapshot.restore_into(house, folder, list(NAMES)) == 2
    assert state(house) == NEW and {n: r.count() for n, r in read_before.items()} == OLD  # a reader keeps its version
    assert {n: r.count() for n, r in house.tables(1).items()} == OLD
    assert len(house.vacuum()) == 3 and state(house) == NEW


@pytest.mark.parametrize("step", range(8))
def test_a_failure_at_any_step_leaves_the_old_or_the_new_whole(spark, tmp_path, monkeypatch, step):
    """Steps: a folder for each of five tables, a draft, its rename, and none."""
    house, folder = made(spark, tmp_path)
    done = []

    def failing(real):
        def call(*args):
            done.append(real)
            if len(done) == step + 1:
                raise OSError("down")
            return real(*args)

        return call

    monkeypatch.setattr(versions.Versions, "new_folder", failing(versions.Versions.new_folder))
    monkeypatch.setattr(versions, "write_text", failing(versions.write_text))
    monkeypatch.setattr(versions, "rename", failing(versions.rename))
    if step < 7:
        with pytest.raises((OSError, Conflict)):
            snapshot.restore_into(house, folder, list(NAMES))
        monkeypatch.undo()
        assert state(house) == OLD
        snapshot.restore_into(house, folder, list(NAMES))
    else:
        snapshot.restore_into(house, folder, list(NAMES))
    assert state(house) == NEW


def test_a_table_that_fails_while_it_is_written_changes_nothing(spark, tmp_path):
    house, _ = made(spark, tmp_path)
    with pytest.raises(Exception, match="broken"):
        house.replace({"kept": spark.range(5).toDF("x"), "chunks": spark.range(3).select(F.when(F.col("id") == 1, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).alias("chunk_id"))})
    assert state(house) == OLD


def test_writers_of_one_version_do_not_overwrite_each_other(spark, tmp_path, monkeypatch):
    house, folder = made(spark, tmp_path)
    real = versions.Versions.commit

    def late(self, base, held):
        monkeypatch.setattr(versions.Versions, "commit", real)
        house.replace({"kept": spark.range(9).toDF("x")})  # another one is faster
        return real(self, base, held)

    monkeypatch.setattr(versions.Versions, "commit", late)
    with pytest.raises(Conflict):
        snapshot.restore_into(house, folder, list(NAMES))
    assert state(house) == OLD | {"kept": 9}


@pytest.mark.parametrize("fails", [1, 2, None])
def test_a_store_is_never_lost(spark, tmp_path, monkeypatch, fails):
    """The rename that fails: of the old store, of the copy, or none."""
    _, folder = made(spark, tmp_path)
    place = str(tmp_path / "live")
    append_store(*store(spark, 3), place)
    calls = []

    def rename(spark, old, new, real=versions.rename):
        calls.append(old)
        if len(calls) == fails:
            raise OSError("down")
        real(spark, old, new)

    monkeypatch.setattr(snapshot, "rename", rename)
    if fails:
        with pytest.raises(OSError):
            snapshot.restore_store(spark, folder, place)
        assert [t.count() for t in read_store(spark, place)] == [3, 3]
        monkeypatch.undo()
    assert snapshot.restore_store(spark, folder, place) and [t.count() for t in read_store(spark, place)] == [5, 5]


def test_a_store_set_aside_by_a_call_that_ended_comes_back(spark, tmp_path):
    _, folder = made(spark, tmp_path)
    place = str(tmp_path / "live")
    append_store(*store(spark, 3), f"{place}.replaced")
    assert snapshot.restore_store(spark, folder, place) and [t.count() for t in read_store(spark, place)] == [5, 5]
    assert not snapshot.restore_store(spark, str(tmp_path / "none"), place)
