"""Streams of answers with control: chunks, interruption flags that can be set, cleared and asked for, resets, and state that goes away.

`watch` is the streaming form, with one value per stream in RocksDB; `watched` says the same over windows, for tables. Both take rows
(stream_id, seq, kind, text, stage, ts) of these kinds:

chunk  goes to the buffer; while the stream isn't interrupted it is emitted, and a hit in the buffer interrupts the stream
set    interrupts the stream, with `text` as reason
clear  lifts the interruption; the buffer stays, so that what was hit there is hit again with the next chunk
reset  empties the buffer; an interruption stays
done   inspects the buffer a last time and forgets the stream

A stream without rows for `idle` of event time is forgotten as well: every batch moves its timer, and it fires when the watermark has passed. As
time is that of the rows, a bounded run ends by itself, and a replay forgets the same streams.

Defined results: null texts are empty; an empty chunk is never a hit; rows of a stream in one batch go by seq, and those of one seq by kind; other
kinds change nothing; rows behind the watermark are dropped by Spark, so that `delay` must cover what arrives late.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from veilspark.functions import fixed_values as V
from veilspark.streaming.monitor import BUFFER, buffer_hit, fragments, rolling

INPUT = "stream_id string, seq long, kind string, text string, stage string, ts timestamp"
OUTPUT = "stream_id string, seq long, kind string, interrupted boolean, matched_type string, text string"
STATE = "buffer string, interrupted boolean, reason string, stage string"
NAME = "watch"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Reasons of hits, and the stage of an interruption by one.
REASONS = {"exact_secret": "Detected protected secret in streaming output.", "restricted_token": "Detected restricted token in streaming output.", "partial_secret": "Detected partial leakage of protected asset."}
STAGE = "output_check"


class Watch(StatefulProcessor):
    """One stream: its buffer and its flag."""

    def __init__(self, assets: list[tuple[str, str]], tokens: list[str], size: int, idle_ms: int):
        self.values = [(v.lower(), fragments(v)) for v, _ in assets if v]
        self.words = [t.lower() for t in tokens]
        self.size, self.idle_ms = size, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState(NAME, STATE)

    def hit(self, buffer: str) -> str | None:
        low = buffer.lower()
        if any(v in low for v, _ in self.values):
            return "exact_secret"
        if any(w in low for w in self.words):
            return "restricted_token"
        return "partial_secret" if any(f in low for _, fs in self.values for f in fs) else None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        buffer, interrupted, reason, stage = self.state.get() if self.state.exists() else ("", False, "", "")
        out, gone, last = [], False, 0
        for r in sorted((r for x in rows for r in x.itertuples(index=False)), key=lambda r: (r.seq, r.kind)):
            text, gone = r.text or "", False
            last = max(last, int(r.ts.timestamp() * 1000))
            if r.kind in ("chunk", "done"):
                buffer = (buffer + text)[-self.size :] if r.kind == "chunk" else buffer
                found = self.hit(buffer) if text or r.kind == "done" else None
                if not interrupted:
                    out.append((key[0], r.seq, r.kind, found is not None, found, V.INTERRUPTED if found else text))
                if found:
                    interrupted, reason, stage = True, REASONS[found], STAGE
                if r.kind == "done":
                    buffer, interrupted, reason, stage, gone = "", False, "", "", True
            elif r.kind == "set":
                interrupted, reason, stage = True, text, r.stage or ""
            elif r.kind == "clear":
                interrupted, reason, stage = False, "", ""
            elif r.kind == "reset":
                buffer = ""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if gone:
            self.state.clear()
        else:
            self.state.update((buffer, interrupted, reason, stage))
            self.handle.registerTimer(last + self.idle_ms)
        yield pd.DataFrame(out, columns=["stream_id", "seq", "kind", "interrupted", "matched_type", "text"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter([])


def watch(rows: DataFrame, assets: list[tuple[str, str]], tokens: list[str], size: int = BUFFER, delay: str = "1 minute", idle_ms: int = 600_000) -> DataFrame:
    """A stream of `INPUT` rows as one of `OUTPUT` rows. Start it with `started`, as its state must be in RocksDB."""
    live = rows.withWatermark("ts", delay).groupBy("stream_id")
    return live.transformWithStateInPandas(Watch(assets, tokens, size, idle_ms), OUTPUT, "append", "EventTime")


def started(out: DataFrame, path: str, checkpoint: str, bounded: bool = True) -> StreamingQuery:
    """Writes the stream to Parquet with its state in RocksDB; the session's own choice of a state store is as it was afterwards."""
    conf, key = out.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(key, None)
    conf.set(key, ROCKSDB)
    try:
        to = out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
        return (to.trigger(availableNow=True) if bounded else to).start()
    finally:
        conf.set(key, before) if before is not None else conf.unset(key)


def flags(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(stream_id, interrupted, reason, stage) of all streams that have state, as of the last batch; streams that aren't there aren't interrupted."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", NAME).load()
    return state.select("key.stream_id", "value.interrupted", "value.reason", "value.stage")


def watched(rows: DataFrame, assets: list[tuple[str, str]], tokens: list[str], size: int = BUFFER) -> DataFrame:
    """A table's rows with emitted, interrupted, matched_type, and the flag after each: flagged, reason, flag_stage."""
    text = F.coalesce("text", F.lit(""))
    order = ["seq", "kind"]
    so_far = Window.partitionBy("stream_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("stream_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # a buffer lives from a reset, or from after a done, to the next
    x = rows.withColumn("__life", F.coalesce(F.sum(F.when(F.col("kind") == "done", 1).otherwise(0)).over(before), F.lit(0)))
    x = x.withColumn("__part", F.sum(F.when(F.col("kind") == "reset", 1).otherwise(0)).over(so_far))
    some = F.when((F.col("kind") == "chunk") & (text != ""), text)
    x = rolling(x, ["stream_id", "__life", "__part"], order, some, size, "__buffer")
    found = F.when(some.isNotNull() | (F.col("kind") == "done"), buffer_hit(F.col("__buffer"), assets, tokens)["matched_type"])
    x = x.withColumn("__hit", found)
    because = F.coalesce(*(F.when(F.col("__hit") == k, F.lit(r)) for k, r in REASONS.items()))
    state = lambda on, why, where: F.struct(on.alias("on"), why.alias("reason"), where.alias("stage"))
    change = (
        F.when(F.col("kind") == "set", state(F.lit(True), text, F.coalesce("stage", F.lit(""))))
        .when(F.col("kind").isin("clear", "done"), state(F.lit(False), F.lit(""), F.lit("")))
        .when(F.col("__hit").isNotNull(), state(F.lit(True), because, F.lit(STAGE)))
    )
    x = x.withColumn("__change", change)
    now, was = F.last("__change", ignorenulls=True).over(so_far), F.last("__change", ignorenulls=True).over(before)
    speaks = F.col("kind").isin("chunk", "done")
    x = x.withColumns({"emitted": speaks & ~F.coalesce(was["on"], F.lit(False)), "flagged": F.coalesce(now["on"], F.lit(False)), "reason": F.coalesce(now["reason"], F.lit("")), "flag_stage": F.coalesce(now["stage"], F.lit(""))})
    return x.withColumns({"interrupted": F.col("emitted") & F.col("__hit").isNotNull(), "matched_type": F.when(F.col("emitted"), F.col("__hit"))}).drop("__life", "__part", "__some", "__buffer", "__hit", "__change")
