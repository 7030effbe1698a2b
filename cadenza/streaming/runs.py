"""SNK-06, ST-02 as a stateful stream: the states of feature runs, their legal moves and their counts by split."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What may follow a state; a run that is complete may be taken up again.
MOVES = {"": ("planned",), "planned": ("running",), "running": ("running", "complete"), "complete": ("running",)}
MADE = "feature_key string, seq long, status string, rows long, words long, reason string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


Move = Row("feature_key", "seq", "status", "rows", "words", "reason")


class Runs(StatefulProcessor):
    """One run: its status and its counts of each split are kept; a move that isn't legal changes neither."""

    def __init__(self, stalled_ms: int):
        self.stalled_ms = stalled_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "status string, seq long")
        self.counts = handle.getMapState("counts", "split string", "rows long, words long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        status, last = self.run.get() if self.run.exists() else ("", None)
        alive = None
        for r in sorted(rows, key=lambda r: r["seq"]):  # the rows of one run in one micro-batch
            if r["status"] not in MOVES[status]:
                yield Move(key[0], r["seq"], r["status"], None, None, f"illegal:{status or 'none'}->{r['status']}")
                continue
            status, last = r["status"], r["seq"]
            if r["split"] is not None:
                self.counts.updateValue((r["split"],), (r["rows"] or 0, r["words"] or 0))
            total = [x for _, x in self.counts.iterator()]
            alive = r["ts"]
            yield Move(key[0], r["seq"], status, sum(x[0] for x in total), sum(x[1] for x in total), None)
        if alive is not None:
            self.run.update((status, last))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if status == "running":
                self.handle.registerTimer(int(alive.timestamp() * 1000) + self.stalled_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        status, last = self.run.get()
        if status == "running":
            yield Move(key[0], last, status, None, None, "stalled")

    def close(self) -> None:
        pass


def run_states(stream: DataFrame, path: str, checkpoint: str, stalled: str = "1 hour", late: str = "10 minutes"):
    """Ledger events (feature_key, seq, status, split, rows, words, ts) to ``path``: every legal move with the run's totals after it (``reason`` null),
    and apart from them (``odd=true``) moves that aren't legal and runs that stay ``running`` for longer than ``stalled`` of event time.

    Each micro-batch is evaluated once and replaces itself if repeated; state survives a restart from ``checkpoint``.
    """
    spark = stream.sparkSession
    ms = int(spark.range(1).select(F.expr(f"unix_millis(timestamp'1970-01-01 00:00:00Z' + interval {stalled})")).first()[0])
    out = stream.withWatermark("ts", late).groupBy("feature_key").transformWithState(Runs(ms), MADE, "Append", "EventTime")

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("odd", F.col("reason").isNotNull()).write.mode("overwrite").partitionBy("odd").parquet(f"{path}/batch={batch_id}")

    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKS)  # map states and timers need it; a stream takes it when it starts
    try:
        return out.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
