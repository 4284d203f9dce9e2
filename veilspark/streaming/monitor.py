"""Stream monitoring: answers arrive in chunks, and the last 2000 characters of each are watched.

`inspect_chunks` is the batch form, over windows; `monitor_stream` is the stateful form, with one buffer per
stream in the state store. Both say the same about the same chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from veilspark.functions import fixed_values as V
from veilspark.functions import text as T
from veilspark.functions.rules import any_contained

BUFFER = 2000


def rolling(df: DataFrame, keys: list[str], order: list[str], text: Column, size: int, name: str) -> DataFrame:
    """Adds the last `size` characters of the texts of a key up to each row; null texts are none.

    Texts, each cut to its last `size` characters, are joined once per block of `size` characters, by where they begin. What a row needs lies in its block and
    the two before it, of which it takes a slice. So a row costs the same wherever in a stream it stands and however short its chunks are; windows hold numbers, and
    a block's texts are at most two times `size` characters."""
    own = Window.partitionBy(*keys).orderBy(*order)
    so_far = own.rowsBetween(Window.unboundedPreceding, 0)
    x = df.withColumn("__t", F.right(F.coalesce(text, F.lit("")), F.lit(size)))
    x = x.withColumn("__end", F.sum(F.length("__t")).over(so_far)).withColumn("__n", F.row_number().over(own))
    start = F.col("__end") - F.length("__t")
    x = x.withColumn("__block", F.max(F.when(F.length("__t") > 0, F.floor(start / size))).over(so_far))
    some = x.filter(F.length("__t") > 0).groupBy(*keys, "__block").agg(F.min(start).alias("start"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__n", "__t"))), lambda r: r["__t"]), "").alias("body"))
    blocks = Window.partitionBy(*keys).orderBy("__block")
    one, two = F.lag("body", 1).over(blocks), F.lag("body", 2).over(blocks)
    some = some.withColumn("__from", F.coalesce(F.lag("start", 2).over(blocks), F.lag("start", 1).over(blocks), "start")).withColumn("__body", F.concat(F.coalesce(two, F.lit("")), F.coalesce(one, F.lit("")), "body"))
    some = some.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("__block").alias("__at"), "__from", "__body")
    same = F.col("__block") == F.col("__at")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    x = x.join(some, same, "left")
    buffer = F.right(F.left("__body", (F.col("__end") - F.col("__from")).cast("int")), F.lit(size))
    return x.withColumn(name, F.coalesce(buffer, F.lit(""))).drop("__t", "__end", "__n", "__block", "__at", "__from", "__body", *(f"__{k}" for k in keys))


def buffers(df: DataFrame, stream_col: str, order_col: str, chunk_col: str, size: int = BUFFER) -> DataFrame:
    """Adds the rolling buffer after each chunk."""
    return rolling(df, [stream_col], [order_col], F.col(chunk_col), size, "buffer")


def buffer_hit(buffer: Column, assets: list[tuple[str, str]], tokens: list[str]) -> Column:
    """(matched_type, risk_level): a whole value, else a restricted token, else a piece of a value. assets: (value, risk)."""
    low = F.lower(buffer)
    kind = lambda k, r: F.struct(F.lit(k).alias("matched_type"), F.lit(r).alias("risk_level"))
    whole = [F.when(low.contains(v.lower()), kind("exact_secret", r)) for v, r in assets if v]
    word = [F.when(any_contained(low, [t.lower() for t in tokens]), kind("restricted_token", "high"))]
    part = [F.when(any_contained(low, fragments(v)), kind("partial_secret", r)) for v, r in assets if v]
    return F.coalesce(*whole, *word, *part)


def fragments(value: str) -> list[str]:
    """Pieces of 8 characters, and of 7 with one that is neither letter nor digit; longer ones hold one of these."""
    low = value.lower()
    cut = lambda n: [low[i : i + n] for i in range(len(low) - n + 1)]
    return sorted({*cut(8), *(f for f in cut(7) if not f.isalnum())})


def inspect_chunks(df: DataFrame, assets: list[tuple[str, str]], tokens: list[str], stream_col: str = "stream_id", order_col: str = "seq", chunk_col: str = "chunk") -> DataFrame:
    """Adds interrupted, matched_type, risk_level to each chunk. Empty chunks are never interrupted."""
    x = buffers(df, stream_col, order_col, chunk_col).withColumn("__hit", buffer_hit(F.col("buffer"), assets, tokens))
    some = F.length(F.coalesce(chunk_col, F.lit(""))) > 0
    return x.withColumns({"interrupted": some & F.col("__hit").isNotNull(), "matched_type": F.when(some, F.col("__hit.matched_type")), "risk_level": F.when(some, F.coalesce("__hit.risk_level", F.lit("low"))).otherwise("low")}).drop("__hit", "buffer")


def answers(inspected: DataFrame, stream_col: str = "stream_id", order_col: str = "seq", chunk_col: str = "chunk") -> DataFrame:
    """(stream, interrupted, stopped_at, response): the chunks in order, or a canned text instead of all of them."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"), F.coalesce(chunk_col, F.lit("")).alias("c")))), lambda r: r["c"])
    x = inspected.groupBy(stream_col).agg(F.bool_or("interrupted").alias("interrupted"), F.min(F.when(F.col("interrupted"), F.col(order_col))).alias("stopped_at"), F.array_join(ordered, "").alias("__text"))
    return x.select(stream_col, "interrupted", "stopped_at", F.when(F.col("interrupted"), V.INTERRUPTED).otherwise(F.col("__text")).alias("response"))


def check_output(df: DataFrame, assets: list[tuple[str, str]], tokens: list[str], text_col: str = "text") -> DataFrame:
    """Adds blocked and reason for whole outputs, each by itself."""
    hit = buffer_hit(F.right(F.coalesce(text_col, F.lit("")), F.lit(BUFFER)), assets, tokens)
    reason = F.when(hit["matched_type"] == "exact_secret", "Detected protected secret in streaming output.").when(hit["matched_type"] == "restricted_token", "Detected restricted token in streaming output.").when(hit["matched_type"] == "partial_secret", "Detected partial leakage of protected asset.").otherwise("Output passed.")
    return df.withColumns({"blocked": hit.isNotNull(), "reason": reason})


def monitor_stream(chunks: DataFrame, assets: list[tuple[str, str]], tokens: list[str], size: int = BUFFER, idle: str | None = None) -> DataFrame:
    """chunks: a stream (stream_id string, seq long, chunk string, done boolean). Emits (stream_id, seq, interrupted, matched_type, chunk): after an interruption a
    stream emits nothing more; `done` inspects the buffer a last time and clears the state. idle, such as "10 minutes", is for queries that run on:
    state goes after that time without a chunk. A bounded run (availableNow) must not have it, as Spark then waits for timeouts without end."""
    minutes = int(idle.split()[0]) * 60_000 if idle else 0
    values = [(v.lower(), fragments(v)) for v, _ in assets if v]
    words = [t.lower() for t in tokens]

    def kind(buffer: str) -> str | None:
        low = buffer.lower()
        if any(v in low for v, _ in values):
            return "exact_secret"
        if any(w in low for w in words):
            return "restricted_token"
        return "partial_secret" if any(f in low for _, fs in values for f in fs) else None

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        buffer, stopped = state.get if state.exists else ("", False)
        rows = []
        for r in sorted((r for x in batches for r in x.itertuples(index=False)), key=lambda r: r.seq):
            buffer = (buffer + (r.chunk or ""))[-size:]
            hit = kind(buffer) if not stopped and (r.chunk or r.done) else None
            if not stopped:
                rows.append((key[0], r.seq, hit is not None, hit, r.chunk if hit is None else V.INTERRUPTED))
            stopped = stopped or hit is not None
            if r.done:
                buffer, stopped = "", False
        state.update((buffer, stopped))
        if minutes:
            state.setTimeoutDuration(minutes)
        yield pd.DataFrame(rows, columns=["stream_id", "seq", "interrupted", "matched_type", "chunk"])

    return chunks.groupBy("stream_id").applyInPandasWithState(step, "stream_id string, seq long, interrupted boolean, matched_type string, chunk string", "buffer string, stopped boolean", "append", GroupStateTimeout.ProcessingTimeTimeout if minutes else GroupStateTimeout.NoTimeout)


def rebuilt_fragments(value: Column) -> Column:
    """The fragments as a column, for a table of assets."""
    return T.stream_fragments(value)
