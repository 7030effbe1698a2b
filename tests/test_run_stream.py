"""Runs as a stateful stream: legal moves, counts that survive a restart, runs that stall."""

from datetime import datetime, timedelta

from cadenza.streaming import recordings, runs

EVENT = "feature_key string, seq long, status string, split string, rows long, words long, ts timestamp"


def test_states_survive_a_restart(spark, tmp_path):
    at = lambda minutes: datetime(2024, 1, 1) + timedelta(minutes=minutes)

    def feed(*rows):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        runs.run_states(recordings.stream_table(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state", stalled="30 minutes", late="1 minute").awaitTermination()
        return {(r["feature_key"], r["seq"]): (r["status"], r["rows"], r["words"], r["reason"]) for r in spark.read.parquet(f"{tmp_path}/out").where("reason is null or reason <> 'stalled'").collect()}

    got = feed(("a", 3, "running", "train", 10, 4, at(2)), ("a", 1, "planned", None, None, None, at(0)), ("b", 2, "running", None, None, None, at(1)), ("a", 2, "running", "val", 5, 2, at(1)))
    assert got == {("a", 1): ("planned", 0, 0, None), ("a", 2): ("running", 5, 2, None), ("a", 3): ("running", 15, 6, None), ("b", 2): ("running", None, None, "illegal:none->running")}
    # a new process: the counts of both splits are still there
    got = feed(("a", 4, "running", "train", 30, 9, at(3)), ("a", 5, "planned", None, None, None, at(4)), ("b", 6, "planned", None, None, None, at(4)))
    assert got["a", 4] == ("running", 35, 11, None) and got["a", 5] == ("planned", None, None, "illegal:running->planned") and got["b", 6] == ("planned", 0, 0, None)
    got = feed(("c", 7, "planned", None, None, None, at(60)), ("b", 8, "running", None, None, None, at(59)), ("b", 9, "complete", "test", 1, 1, at(60)))
    assert got["b", 9] == ("complete", 1, 1, None)
    feed(("c", 10, "running", None, None, None, at(61)))
    out = spark.read.parquet(f"{tmp_path}/out").where("reason = 'stalled'").collect()
    assert [(r["feature_key"], r["seq"], r["status"]) for r in out] == [("a", 4, "running")]
    assert spark.read.parquet(f"{tmp_path}/out").where("odd <> (reason is not null)").count() == 0
