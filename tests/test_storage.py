"""Tables that change in place, and folders as a source."""

import os

import pytest
from pyspark.sql import functions as F

from granary.sources import files, folders
from granary.sources.buckets import BucketTable

ROWS = "document_id string, chunk_id long, text string, created_at long, updated_at long"


def table(spark, tmp_path, rows, **kw):
    how = {"keys": ("document_id", "chunk_id"), "by": ("document_id",), "buckets": 8} | kw
    return BucketTable(spark, f"file://{tmp_path}/table", **how).create(spark.createDataFrame(rows, ROWS))


def held(t):
    return sorted(tuple(r) for r in t.read().collect())


def written(tmp_path):
    """When each bucket's files were written, by name."""
    return {p.parent.name: p.name for p in tmp_path.glob("table/data/*/*.parquet")}


def test_upsert_in_place(spark, tmp_path):
    t = table(spark, tmp_path, [(f"d{i}", i, "old", 1, 1) for i in range(40)])
    before = written(tmp_path)
    batch = spark.createDataFrame([("d3", 3, "new", 9, 9), ("d3", 100, "more", 9, 9), ("d3", 3, "stale", 9, 5)], ROWS)
    t.upsert(batch, 0, latest="updated_at")
    want = sorted([(f"d{i}", i, "old", 1, 1) for i in range(40) if i != 3] + [("d3", 3, "new", 1, 9), ("d3", 100, "more", 9, 9)])
    assert held(t) == want
    after = written(tmp_path)
    assert len([b for b in before if before[b] != after[b]]) == 1  # only the bucket of d3
    t.upsert(spark.createDataFrame([("d3", 3, "again", 9, 99)], ROWS), 0)  # a batch that is known
    assert held(t) == want and written(tmp_path) == after
    assert not list(tmp_path.glob("table/pending/*"))


def test_documents_are_replaced_and_deleted(spark, tmp_path):
    t = table(spark, tmp_path, [(f"d{i % 5}", i, "old", 1, 1) for i in range(20)])
    t.replace(spark.createDataFrame([("d1", 500, "new", 2, 2), ("d9", 501, "new", 2, 2)], ROWS), 4)
    want = sorted([(f"d{i % 5}", i, "old", 1, 1) for i in range(20) if i % 5 != 1] + [("d1", 500, "new", 2, 2), ("d9", 501, "new", 2, 2)])
    assert held(t) == want
    t.delete(spark.createDataFrame([("d2",), ("d3",), ("none",)], "document_id string"))
    assert held(t) == [r for r in want if r[0] not in ("d2", "d3")]
    t.delete(t.read().select("document_id"), 5)
    assert held(t) == []
    t.upsert(spark.createDataFrame([], ROWS), 6)
    assert held(t) == [] and t.applied(6) and not t.applied(7)
    with pytest.raises(ValueError, match="exists"):
        t.create(t.read())
    with pytest.raises(ValueError, match="must have"):
        t.delete(spark.createDataFrame([(1,)], "chunk_id long"))
    with pytest.raises(ValueError, match="deal the table"):
        BucketTable(spark, t.path, ("chunk_id",), ("document_id",)).upsert(t.read())


def test_a_change_that_was_cut_off_is_finished(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path, [(f"d{i}", i, "old", 1, 1) for i in range(10)])
    batch = spark.createDataFrame([("d3", 3, "new", 9, 9)], ROWS)
    with monkeypatch.context() as m:
        m.setattr(BucketTable, "_place", lambda self, name: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            t.upsert(batch, 0)
    assert ("d3", 3, "old", 1, 1) in held(t)
    t.upsert(spark.createDataFrame([("d4", 4, "new", 9, 9)], ROWS), 1)
    assert {("d3", 3, "new", 1, 9), ("d4", 4, "new", 1, 9)} <= set(held(t)) and t.applied(0) and len(held(t)) == 10
    (tmp_path / "table/pending/7/rows").mkdir(parents=True)  # cut off before it was written whole
    t.recover()
    assert not (tmp_path / "table/pending/7").exists()


def test_a_stream_of_changes(spark, tmp_path):
    t = table(spark, tmp_path, [(f"d{i}", i, "old", 1, 1) for i in range(10)])
    for k in range(3):
        spark.createDataFrame([("d3", 3, f"v{k}", 9, k), (f"new{k}", k, "x", 9, 9)], ROWS).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    for run in range(2):  # a second query that starts anew has the same batches again
        s = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        s.writeStream.foreachBatch(t.sink(latest="updated_at")).option("checkpointLocation", f"{tmp_path}/check{run}").trigger(availableNow=True).start().awaitTermination()
        rows = {r[0]: r for r in held(t)}
        assert len(rows) == 13 and rows["d3"][2] in ("v0", "v1", "v2") and rows["d3"][3] == 1
        first = first if run else rows
    assert rows == first


def texts(folder, names):
    for name, size in names.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x" * size)


@pytest.fixture
def source(spark):
    spark.dataSource.register(folders.DocumentFolder)
    return spark


def test_folder_in_batch(source, tmp_path):
    texts(tmp_path, {"a.txt": 10, "b/c.md": 20, "b/d.bin": 5, ".hidden.txt": 1, "_tmp/x.txt": 1, "large.txt": 5000, "none.txt": 0})
    df = source.read.format("document_folder").option("max_bytes", 1000).option("suffixes", ".txt,.MD").load(str(tmp_path))
    got = {os.path.relpath(r["path"].removeprefix("file:"), tmp_path): (r["length"], None if r["content"] is None else len(r["content"])) for r in df.collect()}
    assert got == {"a.txt": (10, 10), "b/c.md": (20, 20), "large.txt": (5000, None), "none.txt": (0, 0)}
    assert files.inspected(df).where("error_code is not null").count() == 0 and files.inspected(df, 1000).where("error_code = 'FILE_TOO_LARGE'").count() == 1
    flat = source.read.format("document_folder").option("recursive", "false").load(f"file://{tmp_path}")
    assert flat.count() == 3
    (tmp_path / "empty").mkdir()
    assert source.read.format("document_folder").load(f"{tmp_path}/empty").count() == 0
    with pytest.raises(Exception, match="needs a path"):
        source.read.format("document_folder").load().count()


def test_folder_is_planned_by_bytes():
    folder = folders._Folder({"path": "/x", "partition_bytes": "10000", "max_bytes": "9000"})
    sizes = [100, 100, 9000, 50_000, 60_000, 4000, 0]
    planned = folder.planned([(f"f{i}", n, 0) for i, n in enumerate(sizes)])
    assert [[f[0] for f in p.files] for p in planned] == [["f0", "f1"], ["f2"], ["f3", "f4"], ["f5"], ["f6"]] and folder.planned([]) == []


def test_folder_as_a_stream(source, tmp_path):
    where = tmp_path / "in"
    texts(where, {"a.txt": 1, "b.txt": 2})

    def run():
        s = source.readStream.format("document_folder").load(str(where)).select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "length")
        s.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(once=True).start().awaitTermination()
        return sorted((r["name"], r["length"]) for r in source.read.parquet(f"{tmp_path}/out").collect())

    assert run() == [("a.txt", 1), ("b.txt", 2)]
    newest = max(p.stat().st_mtime_ns for p in where.iterdir())
    texts(where, {"c.txt": 3})
    os.utime(where / "c.txt", ns=(newest, newest))  # of the very same time
    assert run() == [("a.txt", 1), ("b.txt", 2), ("c.txt", 3)]
    assert run() == [("a.txt", 1), ("b.txt", 2), ("c.txt", 3)]
