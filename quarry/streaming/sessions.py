"""Streams: hourly counts with late rows, sessions by gap, incremental conversation index with state per thread."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

GAP_SECONDS, MOST_TURNS = 1800, 12
#: How long a stream knows a message again.
REMEMBER_SECONDS = 7 * 86400


def hourly_counts(events: DataFrame, at: str = "ts", key: str = "event_type", late: str = "2 hours") -> DataFrame:
    """Tumbling hours; rows later than ``late`` behind the newest are dropped by the watermark.  Works on batch frames as well."""
    e = events.withColumn("_at", F.col(at).cast("timestamp"))
    e = e.withWatermark("_at", late) if events.isStreaming else e
    g = e.groupBy(F.window("_at", "1 hour"), key).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), key, "n", "total")


def session_windows(events: DataFrame, key: str = "user_id", at: str = "ts", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    e = events.withColumn("_at", F.col(at).cast("timestamp"))
    e = e.withWatermark("_at", late) if events.isStreaming else e
    g = e.groupBy(F.session_window("_at", gap), key).agg(F.count("*").alias("n"))
    return g.select(key, F.col("session_window.start").cast("timestamp_ntz").alias("start"), F.col("session_window.end").cast("timestamp_ntz").alias("end"), "n")


def index_messages(messages: DataFrame, late: str = "2 hours") -> DataFrame:
    """(thread, message_id, at) -> (thread, message_id, episode, n_turns): episodes of at most MOST_TURNS messages, none with a gap of over GAP_SECONDS.

    A repeated message_id of a thread counts once, at its earliest time.  On a stream, messages wait until the watermark has passed
    them, so those that come in another order, by up to ``late``, give the rows that a batch over all of them gives; what is
    later still is dropped.  Ids are remembered for REMEMBER_SECONDS behind the watermark, beyond the end of an episode.
    """
    rows = messages.select("thread", "message_id", F.col("at").cast("timestamp").alias("at"))
    if not messages.isStreaming:
        return _episodes(rows)
    spark, store = messages.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(store, ""):
        raise ValueError(f"set {store} to the RocksDB provider: state by key and timers need it")
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    out = f"thread {types['thread']}, message_id {types['message_id']}, episode int, n_turns int"
    return rows.withWatermark("at", late).groupBy("thread").transformWithStateInPandas(_Index(types["message_id"]), out, "Append", "EventTime")


def _episodes(rows: DataFrame) -> DataFrame:
    once = rows.groupBy("thread", "message_id").agg(F.min("at").alias("at"))
    w = Window.partitionBy("thread").orderBy("at", "message_id")
    far = F.unix_micros("at") - F.lag(F.unix_micros("at")).over(w) > GAP_SECONDS * 1_000_000
    runs = once.withColumn("_far", F.coalesce(far, F.lit(True))).withColumn("_run", F.sum(F.col("_far").cast("int")).over(w))
    place = F.row_number().over(Window.partitionBy("thread", "_run").orderBy("at", "message_id")) - 1
    each = runs.withColumn("_p", place).withColumn("_part", F.floor(F.col("_p") / MOST_TURNS))
    number = F.dense_rank().over(Window.partitionBy("thread").orderBy("_run", "_part")) - 1
    return each.select("thread", "message_id", number.cast("int").alias("episode"), (F.col("_p") % MOST_TURNS + 1).cast("int").alias("n_turns"))


class _Index(StatefulProcessor):
    """State of a thread: messages that wait for the watermark, ids of late, and the open episode; timers stand at the waiting messages' times."""

    def __init__(self, id_type: str):
        self.id_type = id_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", f"message_id {self.id_type}", "ms long")
        self.seen = handle.getMapState("seen", f"message_id {self.id_type}", "ms long")
        self.open = handle.getValueState("open", "episode int, n int, ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            for m, at in zip(part["message_id"].tolist(), part["at"], strict=True):
                ms = int(pd.Timestamp(at).value // 1_000_000)
                if self.seen.containsKey((m,)):
                    continue
                if not self.waiting.containsKey((m,)) or self.waiting.getValue((m,))[0] > ms:
                    self.waiting.updateValue((m,), (ms,))
                    self.handle.registerTimer(ms + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        ready = sorted((v[0], k[0]) for k, v in self.waiting.iterator() if v[0] < mark)
        if not ready:  # an earlier timer of this batch has taken them
            return
        episode, n, last = self.open.get() if self.open.exists() else (-1, 0, 0)
        out = []
        for ms, m in ready:
            if episode < 0 or ms - last > GAP_SECONDS * 1000 or n >= MOST_TURNS:
                episode, n = episode + 1, 0
            n, last = n + 1, ms
            out.append((key[0], m, episode, n))
            self.waiting.removeKey((m,))
            self.seen.updateValue((m,), (ms,))
        self.open.update((episode, n, last))
        for k in [k for k, v in self.seen.iterator() if v[0] < mark - REMEMBER_SECONDS * 1000]:
            self.seen.removeKey(k)
        yield pd.DataFrame(out, columns=["thread", "message_id", "episode", "n_turns"])

    def close(self) -> None:
        pass
