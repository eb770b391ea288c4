from __future__ import annotations

import pytest

from feedback_engine.plans import jobs
from feedback_engine.sources import files
from feedback_engine.sources.manifest import CommitConflict, ManifestTable


def frame(spark, *ids):
    return spark.createDataFrame([(i, f"t{i}") for i in ids], "id long, text string")


def ids(df):
    return sorted(r["id"] for r in df.collect())


@pytest.fixture
def table(spark, tmp_path):
    return ManifestTable(spark, str(tmp_path / "table"))


def test_append_replace_and_retry(spark, table):
    assert not table.exists() and table.batches() == []
    with pytest.raises(FileNotFoundError):
        table.read()
    table.append(frame(spark, 1, 2), "a")
    table.append(frame(spark, 3), "b")
    table.append(frame(spark, 3), "b")  # the same batch again
    assert ids(table.read()) == [1, 2, 3] and table.batches() == ["a", "b"]
    old = table.read()
    table.replace(frame(spark, 9), "c")
    assert ids(table.read()) == [9] and ids(old) == [1, 2, 3]  # a reader keeps its version
    table.replace(frame(spark), "d")
    assert ids(table.read()) == [] and table.read().columns == ["id", "text"]


def test_failure_between_write_and_commit_leaves_the_old_table(spark, table, monkeypatch):
    table.append(frame(spark, 1), "a")

    def lost(self, row):
        raise OSError("executor lost")

    with monkeypatch.context() as patched:
        patched.setattr(ManifestTable, "_publish", lost)
        with pytest.raises(OSError):
            table.replace(frame(spark, 2, 3), "b")
    assert ids(table.read()) == [1] and table.batches() == ["a"]
    table.replace(frame(spark, 2, 3), "b")  # the retry
    assert ids(table.read()) == [2, 3]


def test_failed_batch_leaves_the_old_table(spark, table):
    table.append(frame(spark, 1), "a")
    broken = frame(spark, 2).selectExpr("id", "raise_error('broken') text")
    with pytest.raises(Exception, match="broken"):
        table.append(broken, "b")
    assert ids(table.read()) == [1]


def test_two_writers_of_one_version(spark, table, monkeypatch):
    table.append(frame(spark, 1), "a")
    real = ManifestTable._publish

    def overtaken(self, row):
        real(self, (row[0], "0", "other", row[3], ["a", "other"], row[5]))
        real(self, row)

    monkeypatch.setattr(ManifestTable, "_publish", overtaken)
    with pytest.raises(CommitConflict):
        table.append(frame(spark, 2), "b")


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "sink")
    files.append_or_replace(frame(spark, 1), path, "fail")
    with pytest.raises(FileExistsError):
        files.append_or_replace(frame(spark, 1), path, "fail")
    with pytest.raises(ValueError):
        files.append_or_replace(frame(spark, 1), path, "upsert")
    files.full_refresh(frame(spark, 4, 5), path, ["text"])
    assert ids(files.committed(spark, path)) == [4, 5]


def test_publish_retry_writes_nothing_twice(spark, tmp_path):
    layers = jobs.Layers(spark, str(tmp_path / "lake"))
    layers.write(frame(spark, 1), "warehouse", "t", "run-1")
    layers.write(frame(spark, 2), "warehouse", "t", "run-1")
    assert ids(layers.read("warehouse", "t")) == [1]
