"""One file for each row: counts, reuse, replacement, and nothing left by a write that fails."""

import time

import pytest
from pyspark.sql import functions as F

from cadenza.sources import filesink, sinks
from cadenza.sources.filesink import write_files


def rows(spark, n=200):
    i = F.col("id").cast("string")
    return spark.range(0, n, 1, 5).select(F.concat(F.lit("a/"), (F.col("id") % 7).cast("string"), F.lit("/u"), i, F.lit(".lab")).alias("rel_path"), F.concat(F.lit("né "), i).alias("content"))


def found(path):
    return {str(p.relative_to(path)): p.read_text() for p in path.rglob("*") if p.is_file() and not p.name.endswith(".crc")}


def test_files_counts_and_reuse(spark, tmp_path):
    root = tmp_path / "lab"
    d = rows(spark)
    first = write_files(d.where(F.col("content").endswith("0")), f"file://{root}")
    assert first == {"written": 20, "reused": 0, "bytes": sum(len(x.encode()) for x in found(root).values())}
    assert write_files(d, str(root)) | {"bytes": 0} == {"written": 180, "reused": 20, "bytes": 0}
    changed = d.withColumn("content", F.lit(b"\x00\xff"))
    assert write_files(changed, str(root))["written"] == 0 and found(root)["a/0/u0.lab"] == "né 0"
    assert write_files(changed.limit(1), str(root), replace=True)["written"] == 1
    assert (root / "a/0/u0.lab").read_bytes() == b"\x00\xff"
    assert write_files(d.limit(0), str(root)) == {"written": 0, "reused": 0, "bytes": 0}
    assert write_files(d.limit(1).withColumn("content", F.lit(None).cast("string")), str(tmp_path / "other"))["bytes"] == 0
    assert not [x for x in root.iterdir() if x.name.startswith("_")]


def test_a_failed_write_leaves_none_of_its_files(spark, tmp_path):
    root = tmp_path / "lab"
    kept = rows(spark, 10)
    write_files(kept, str(root))
    before = found(root)
    last = F.when(F.col("content") == "né 199", F.raise_error(F.lit("broken"))).otherwise(F.col("content"))
    with pytest.raises(Exception, match="broken"):
        write_files(rows(spark).withColumn("content", last).coalesce(3), str(root))
    for _ in range(60):  # tasks that were still at work when the write failed take their files away themselves
        if found(root) == before and {x.name for x in root.iterdir()} == {"a"}:
            break
        time.sleep(0.5)
    assert found(root) == before and {x.name for x in root.iterdir()} == {"a"}


def test_a_task_that_outlives_an_abort_leaves_nothing(tmp_path, monkeypatch):
    root = tmp_path / "lab"
    writer = filesink.FileWriter(str(root), "job", False)
    monkeypatch.setattr(filesink.TaskContext, "get", lambda: type("T", (), {"partitionId": lambda self: 0})())
    late = [{"rel_path": f"a/{i}", "content": "x"} for i in range(3)]
    assert writer.write(iter(late)).written == 3 and len(found(root / "a")) == 3
    writer.abort([None])
    assert not found(root)
    with pytest.raises(RuntimeError, match="aborted"):
        writer.write(iter(late))
    assert not found(root) and not [x for x in root.iterdir() if x.name.startswith("_")]


def test_a_task_killed_after_an_abort_leaves_nothing(tmp_path, monkeypatch):
    root = tmp_path / "lab"
    writer = filesink.FileWriter(str(root), "job", False)
    monkeypatch.setattr(filesink.TaskContext, "get", lambda: type("T", (), {"partitionId": lambda self: 0})())
    monkeypatch.setattr(filesink, "ASKED", 1, raising=False)
    left = []

    def late():
        yield {"rel_path": "a/0", "content": "x"}
        writer.abort([None])
        yield {"rel_path": "a/1", "content": "x"}
        left.append(found(root))  # what stays of a task that is killed now
        yield {"rel_path": "a/2", "content": "x"}

    with pytest.raises(Exception):
        writer.write(late())
    assert not any(left) and not found(tmp_path / "lab-staging") and not found(root)


def test_labs_are_written_and_read_by_many_tasks(spark, tmp_path, monkeypatch):
    tasks = []
    write = sinks.write_files
    monkeypatch.setattr(sinks, "write_files", lambda df, *more: (tasks.append(df.rdd.getNumPartitions()), write(df, *more))[1])
    u = spark.range(50).select(F.concat(F.lit("a/u"), F.col("id").cast("string"), F.lit(".wav")).alias("audio_path"), F.lit(" né \n x").alias("text"))
    assert sinks.write_labs(u.coalesce(1), str(tmp_path / "lab"))["written"] == 50 and tasks[0] >= 4
    asked = filesink.by_files(sinks.transcript_rows(u.union(u.limit(1).withColumn("audio_path", F.lit("a/none.wav")))).coalesce(1))
    there = filesink.read_files(asked, f"file://{tmp_path}/lab")
    assert there.rdd.getNumPartitions() >= 4
    assert {r["rel_path"]: bytes(r["content"]).decode() for r in there.collect()} == {f"a/u{i}.lab": "né x" for i in range(50)}
