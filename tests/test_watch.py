"""The stateful watch against its windowed form, its flags, and state that goes away."""

import datetime
import random

from pyspark.sql import functions as F

from veilspark.streaming import watch as W

ASSETS, TOKENS = [("picoCTF{secret_123}", "critical")], ["zzz"]
BEGAN = datetime.datetime(2024, 1, 1)


def run(spark, rows, top, batches, **options):
    """All rows in so many batches, by seq."""
    df = spark.createDataFrame(rows, W.INPUT)
    step = -(-(1 + max(r[1] for r in rows)) // batches)
    for k in range(batches):
        df.filter(F.col("seq").between(step * k, step * k + step - 1)).coalesce(1).write.json(f"{top}/in/{k}")
    live = spark.readStream.schema(W.INPUT).option("maxFilesPerTrigger", 1).json(f"{top}/in/*")
    W.started(W.watch(live, ASSETS, TOKENS, **options), f"{top}/out", f"{top}/state").awaitTermination()
    return df, spark.read.schema(W.OUTPUT).parquet(f"{top}/out")


def test_as_over_windows_in_any_batches(spark, tmp_path):
    rng, rows = random.Random(1), []
    for s in range(12):
        for q in range(rng.randint(3, 20)):
            kind = rng.choice(["chunk"] * 8 + ["set", "clear", "reset", "done", "other"])
            text = rng.choice(["pico", "CTF{", "secret_123}", " ok ", "", "zzz", None]) if kind == "chunk" else "why"
            rows.append((f"s{s}", q, kind, text, "input" if kind == "set" else None, BEGAN + datetime.timedelta(minutes=q)))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    df, out = run(spark, rows, tmp_path, 4, delay="10 hours", idle_ms=10**9)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    said = W.watched(df, ASSETS, TOKENS)
    columns = ["stream_id", "seq", "kind", "interrupted", "matched_type"]
    assert {tuple(r) for r in out.select(columns).collect()} == {tuple(r) for r in said.filter("emitted").select(columns).collect()}
    flags = {r.stream_id: (r.interrupted, r.reason, r.stage) for r in W.flags(spark, f"{tmp_path}/state").collect()}
    last = said.groupBy("stream_id").agg(F.max_by(F.struct("flagged", "reason", "flag_stage", "kind"), F.struct("seq", "kind")).alias("v"))
    for r in last.collect():
        assert (r.stream_id in flags) == (r.v.kind != "done")
        assert flags.get(r.stream_id, (False, "", "")) == (r.v.flagged, r.v.reason, r.v.flag_stage)
    assert any(x[0] for x in flags.values()) and not all(x[0] for x in flags.values())


def test_set_clear_reset_and_reasons(spark, tmp_path):
    at = lambda i: BEGAN + datetime.timedelta(seconds=i)
    rows = [
        ("set", 0, "chunk", "hello ", None, at(0)), ("set", 1, "set", "stopped by hand", "review", at(1)), ("set", 2, "chunk", "unheard", None, at(2)),
        ("clear", 0, "set", "x", "y", at(0)), ("clear", 1, "clear", None, None, at(1)), ("clear", 2, "chunk", "heard", None, at(2)),
        ("kept", 0, "chunk", "a zzz b", None, at(0)), ("kept", 1, "clear", None, None, at(1)), ("kept", 2, "chunk", "more", None, at(2)),
        ("reset", 0, "chunk", "a zzz b", None, at(0)), ("reset", 1, "clear", None, None, at(1)), ("reset", 2, "reset", None, None, at(2)), ("reset", 3, "chunk", "more", None, at(3)),
    ]
    _, out = run(spark, rows, tmp_path, 2, idle_ms=10**9)
    flags = {r.stream_id: (r.interrupted, r.reason, r.stage) for r in W.flags(spark, f"{tmp_path}/state").collect()}
    assert flags == {"set": (True, "stopped by hand", "review"), "clear": (False, "", ""), "kept": (True, W.REASONS["restricted_token"], W.STAGE), "reset": (False, "", "")}
    assert {(r.stream_id, r.seq) for r in out.filter("NOT interrupted").collect()} == {("set", 0), ("clear", 2), ("reset", 3)}


def test_streams_that_never_end_are_forgotten(spark, tmp_path):
    rows = [(f"old{i}", 0, "chunk", "zzz", None, BEGAN + datetime.timedelta(seconds=i)) for i in range(5)]
    rows += [(f"new{i}", 1, "chunk", "zzz", None, BEGAN + datetime.timedelta(hours=2, seconds=i)) for i in range(5)]
    run(spark, rows, tmp_path, 2, delay="1 minute", idle_ms=60_000 * 10)  # ends by itself
    assert sorted(r.stream_id for r in W.flags(spark, f"{tmp_path}/state").collect()) == [f"new{i}" for i in range(5)]


def test_a_secret_over_chunks_and_batches(spark, tmp_path):
    parts = ["pico", "CTF{sec", "ret_", "123}", "after"]
    _, out = run(spark, [("a", i, "chunk", p, None, BEGAN) for i, p in enumerate(parts)], tmp_path, 5, idle_ms=10**9)
    got = [(r.seq, r.interrupted, r.matched_type) for r in out.orderBy("seq").collect()]
    assert got == [(0, False, None), (1, True, "partial_secret")]
