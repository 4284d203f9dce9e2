"""Sources and sinks that go on: answers by lots, early stops, the event log, versioned registries."""

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from veilspark.operators import assets as A
from veilspark.sources import documents as D
from veilspark.sources import models as M
from veilspark.sources.registry_store import Conflict, RegistryStore

PROMPTS = [(f"k{i}", f"word{i} flag then more" if i % 3 else f"only {i} words here") for i in range(40)] + [("empty", ""), ("none", None)]


def chunks_of(prompts, stop="flag"):
    """Rows by plain loops."""
    out = set()
    for key, prompt in prompts:
        rows, said = [], ""
        for w in M.EchoClient().stream(prompt or "", "m", M.ModelOptions()):
            said += w
            rows.append((key, len(rows), w, False, stop in said, None))
            if stop in said:
                break
        out |= {*rows, (key, len(rows), "", True, stop in said, None if prompt else "empty_prompt")}
    return out


def test_client_is_never_asked_after_a_stop(spark):
    df = spark.createDataFrame(PROMPTS, "key string, prompt string")
    rows = {tuple(r) for r in M.stream(df, M.StrictClient(), "m", should_stop=lambda tail: "flag" in tail).collect()}
    assert rows == chunks_of(PROMPTS)
    unguarded = M.stream(df, M.StrictClient(), "m").filter("error_type = 'RuntimeError'").count()
    assert unguarded == sum("flag" in (p or "") for _, p in PROMPTS)


def test_answers_by_lots_and_after_a_restart(spark, tmp_path):
    cloudpickle.register_pickle_by_value(M)
    spark.dataSource.register(M.ModelChunks)
    path, df = f"file://{tmp_path}/lots", spark.createDataFrame(PROMPTS, "key string, prompt string")

    def run():
        live = spark.readStream.format("model_chunks").option("path", path).option("stop", "flag").load()
        q = live.writeStream.format("json").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        return {tuple(r) for r in spark.read.schema(live.schema).json(f"{tmp_path}/out").collect()}

    assert M.lots(path) == []
    n = M.publish(df.limit(20), path, size=6)
    assert M.lots(path) == list(range(n)) and n > 1
    first = run()
    assert first == chunks_of(PROMPTS[:20])
    assert run() == first  # nothing new
    M.publish(df.filter(~F.col("key").isin([k for k, _ in PROMPTS[:20]])), path, size=6)
    assert run() == chunks_of(PROMPTS)
    assert spark.read.json(f"{tmp_path}/out").count() == len(chunks_of(PROMPTS))


def test_failing_servers():
    class Down(M.EchoClient):
        def ping(self):
            raise ConnectionError

    assert M.check_connection(M.EchoClient())["success"]
    assert M.check_connection(Down())["error_type"] == "connection_error"


def test_event_log_is_written_once(spark, tmp_path):
    for k in range(3):
        spark.range(5 * k, 5 * k + 5).select(F.col("id").cast("string").alias("event_id"), F.lit("password=hunter22").alias("input_summary"), F.col("id").cast("int").alias("risk_score")).coalesce(1).write.json(f"{tmp_path}/in/{k}")
    failed = []

    def fail_once(number):
        if number == 1 and not failed:
            failed.append(number)
            raise OSError("lost after the write")

    def run():
        live = spark.readStream.schema(D.EVENT_SCHEMA).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in/*")
        D.append_event_stream(live, f"{tmp_path}/log", f"{tmp_path}/state", bounded=True, after=fail_once).awaitTermination()

    with pytest.raises(Exception, match="lost after the write"):
        run()
    run()
    log = D.read_event_batches(spark, f"{tmp_path}/log")
    assert sorted(int(r.event_id) for r in log.collect()) == list(range(15)) and failed == [1]
    assert log.select("batch").distinct().count() == 3 and log.filter("input_summary LIKE '%hunter22%'").count() == 0
    assert D.read_event_batches(spark, f"{tmp_path}/nothing").count() == 0


def test_versions_of_a_registry(spark, tmp_path):
    store, base = RegistryStore(spark, f"file://{tmp_path}/store"), A.default_assets(spark)
    assert store.version() == 0 and store.read().count() == 0
    assert store.publish(base, 0) == 1 and store.read().count() == base.count()
    one, two = RegistryStore(spark, store.path), RegistryStore(spark, store.path)
    seen, also = one.version(), two.version()
    one.publish(A.remove(one.read(seen), "a1"), seen)
    with pytest.raises(Conflict):
        two.publish(A.update(two.read(also), "a_flag", risk_level="low"), also)
    two.change(lambda r: A.update(r, "a_flag", risk_level="low"))
    now = {r.asset_id: r.risk_level for r in store.read().collect()}
    assert "a1" not in now and now["a_flag"] == "low" and len(now) == base.count() - 1
    assert store.read(1).count() == base.count()
    assert [(r.version, r.assets) for r in store.history().orderBy("version").collect()] == [(1, base.count()), (2, base.count() - 1), (3, base.count() - 1)]
    store.forget(3)
    assert store.versions() == [3] and store.read().count() == base.count() - 1


def test_a_writer_that_comes_between(spark, tmp_path, monkeypatch):
    """The manifest is there before the rename, though it wasn't when the version was asked for."""
    store, base = RegistryStore(spark, f"file://{tmp_path}/store"), A.default_assets(spark)
    store.publish(base, 0)
    store.publish(base.limit(3), 1)
    monkeypatch.setattr(store, "version", lambda: 1)
    with pytest.raises(Conflict):
        store.publish(base.limit(5), 1)
    monkeypatch.undo()
    assert store.versions() == [1, 2] and store.read().count() == 3


def test_a_large_registry_is_saved_in_several_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(D, "LOT", 7)
    rows = [(f"a{i % 45}", "n", "exact", f"v{i}", ["x\ny"], "high", ["owner"], ["exact_match"], True, None, "user") for i in range(50)]
    registry, path = spark.createDataFrame(rows, A.SCHEMA), f"file://{tmp_path}/saved"
    D.save_registry(registry.limit(3), path)
    D.save_registry(registry, path)  # in place of the one before
    held = spark.read.text(path, wholetext=True).selectExpr("get_json_object(value, '$.asset_count') AS n").collect()
    assert 1 < len(held) <= 8 and sum(int(r.n) for r in held) == 50
    assert sorted(map(str, D.load_assets(spark, path, pattern="*.txt").collect())) == sorted(map(str, registry.collect()))
    D.save_registry(registry.limit(0), path)
    assert D.load_assets(spark, path, pattern="*.txt").count() == 0
