"""Snapshots: as-of lookup, cleared files, reruns, what counts as changed, and pairs for a diff."""

from tessera.operators import diff
from tessera.sources.snapshots import Snapshots


def files(spark, rows):
    return spark.createDataFrame(list(rows.items()), "file_path string, content string")


def held(store, version=None):
    return {r.file_path: (r.content, r.version) for r in store.get(version).collect()}


def test_snapshots_by_version(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "store"))
    assert held(store) == {} and {r.file_path: r.status for r in store.compare(files(spark, {"a": "1"})).collect()} == {"a": "new"}
    store.create(files(spark, {"a": "1", "b": "x\ny", "n": None, "": ""}), 1)
    store.create(files(spark, {"a": "2", "b": "x\ny", "n": None}), 2)
    assert held(store, 1) == {"a": ("1", 1), "b": ("x\ny", 1), "n": (None, 1), "": ("", 1)}
    assert held(store) == {"a": ("2", 2), "b": ("x\ny", 1), "n": (None, 1), "": ("", 1)}
    store.create(files(spark, {"a": "2", "b": "x\ny", "n": None}), 2)  # the same version again
    assert held(store)["a"] == ("2", 2) and spark.read.parquet(store.path).count() == 5
    store.clear(3, files(spark, {"a": "", "zz": ""}))
    assert "a" not in held(store) and held(store, 2)["a"] == ("2", 2)
    now = files(spark, {"a": "2", "b": "x\nz", "n": None, "c": "new"})
    assert {r.file_path: r.status for r in store.compare(now).collect()} == {"a": "new", "b": "changed", "n": "unchanged", "c": "new", "": "deleted"}
    assert {r.file_path: r.changed for r in store.changed(now).collect()} == {"a": True, "b": True, "n": False, "c": True}
    ops = diff.line_diff(store.pairs(now), "file_path").where("op <> 'unchanged'").collect()
    assert {(r.op, r.line) for r in ops if r.file_path == "b"} == {("removed", "y"), ("added", "z")}
    store.create(files(spark, {"a": "3"}), 4)
    assert held(store)["a"] == ("3", 4)
    store.clear(5)
    assert held(store) == {} and len(held(store, 4)) == 4
