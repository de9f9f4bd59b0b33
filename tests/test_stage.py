import os

from pyspark.sql import functions as F

from logwarden import schemas
from logwarden.sources.logs import scan_logs
from logwarden.stage import owner, release, shared_folder, written
from logwarden.streaming import store


def folders(spark):
    path = shared_folder(spark)
    return {x for x in os.listdir(path) if len(x) == 32} if os.path.isdir(path) else set()


def test_tables_go_with_their_owner(spark):
    before = folders(spark)
    with owner():
        inner = written(spark.range(5))
        assert inner.count() == 5 and len(folders(spark) - before) == 1
    assert folders(spark) == before
    outer = written(spark.range(3))
    assert outer.count() == 3
    release()
    assert not folders(spark) - before


def test_old_versions_of_the_state_go(spark, tmp_path, monkeypatch):
    """However many batches there are, two full states and the changes since are kept."""
    monkeypatch.setattr(store, "FULL_EVERY", 4)
    folder = str(tmp_path / "state")
    monkeypatch.setattr(store, "PARTS", 3)
    for n in range(1, 26):
        row = [(f"10.0.0.{n % 7}", n, n, 1, 0, False, False, 0, 4, False)]
        store.write_changes(spark, folder, n, spark.createDataFrame(row, schemas.STATE))
    kept = [x for x in os.listdir(folder) if x.startswith("version=")]
    assert len(kept) <= 8 and len(os.listdir(f"{folder}/complete")) <= 8
    got = {r["ip"]: r["score"] for r in store.state_before(spark, folder).collect()}
    assert got == {f"10.0.0.{k}": max(n for n in range(1, 26) if n % 7 == k) for k in range(7)}


def test_scan_without_files_has_the_same_columns(spark, tmp_path):
    path = tmp_path / "a.log"
    path.write_text("line\n")
    some = spark.createDataFrame([("G", 0, 0, str(path))], schemas.FILES)
    none = spark.createDataFrame([("G", 0, 0, "/no/such/file")], schemas.FILES)
    ts = F.lit(1).cast("bigint")
    there, empty = scan_logs(spark, some, ts), scan_logs(spark, none, ts)
    assert there.dtypes == empty.dtypes
    assert there.count() == 1 and empty.count() == 0
