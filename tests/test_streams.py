import json

import pytest

from veilspark import cli

from veilspark.sources import documents as D
from veilspark.sources import models as M
from veilspark.streaming import monitor as ST

ASSETS = [("picoCTF{secret_123}", "critical")]
SCHEMA = "stream_id string, seq long, chunk string, done boolean"
CHUNKS = [("a", 0, "pico", False), ("a", 1, "CTF", False), ("a", 2, "{secret_123}", False), ("a", 3, "more", True), ("b", 0, "all ", False), ("b", 1, "is well", True), ("c", 0, "picoCTF", False), ("c", 1, "{", False), ("d", 0, None, True)]


def test_batch_and_stream_agree(spark, tmp_path):
    df = spark.createDataFrame(CHUNKS, SCHEMA)
    batch = {(r.stream_id, r.seq): r.matched_type for r in ST.inspect_chunks(df, ASSETS, ["zzz"]).collect()}
    assert batch["a", 2] == "exact_secret" and batch["c", 1] == "partial_secret" and batch["a", 1] is None and batch["d", 0] is None
    said = {r.stream_id: r.response for r in ST.answers(ST.inspect_chunks(df, ASSETS, ["zzz"])).collect()}
    assert said["b"] == "all is well" and said["a"].startswith("此回應")
    df.coalesce(1).write.json(str(tmp_path / "in"))
    q = ST.monitor_stream(spark.readStream.schema(SCHEMA).json(str(tmp_path / "in")), ASSETS, ["zzz"]).writeStream.format("memory").queryName("watched").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.sql("SELECT * FROM watched").collect()
    assert {(r.stream_id, r.seq) for r in rows if r.interrupted} == {("a", 2), ("c", 1)}
    assert ("a", 3) not in {(r.stream_id, r.seq) for r in rows}


def test_models(spark):
    df = spark.createDataFrame([(1, "one two"), (2, ""), (3, None)], "key long, prompt string")
    got = {r.key: (r.text, r.success, r.error_type) for r in M.generate(df, M.EchoClient(), "m").collect()}
    assert got == {1: ("one two", True, None), 2: ("", False, "empty_prompt"), 3: ("", False, "empty_prompt")}
    chunks = M.stream(df, M.EchoClient(), "m", should_stop=lambda t: "one" in t).orderBy("key", "seq").collect()
    assert [(r.text, r.stopped_by_guard) for r in chunks if r.key == 1 and not r.done] == [("one ", True)]
    with pytest.raises(M.InvalidOptions):
        M.ModelOptions(top_p=2)
    assert "options" not in M.ModelOptions().payload("p", "m") and M.ModelOptions(seed=1).payload("p", "m")["options"] == {"seed": 1}


def test_loaders(spark, tmp_path):
    good, bad, shape = (tmp_path / n for n in ("good.json", "bad.json", "shape.json"))
    good.write_text('[{"asset_id": "x", "value": "v", "aliases": ["é"]}, 3]')
    bad.write_text("{")
    shape.write_text('{"a": 1}')
    assert [(r.asset_id, r.aliases, r.source) for r in D.load_assets(spark, str(good), "user").collect()] == [("x", ["é"], "user")]
    assert D.load_assets(spark, str(bad)).count() == 0 and D.load_assets(spark, str(tmp_path / "none")).count() == 0
    for path, kind in ((bad, "invalid"), (shape, "shape"), (tmp_path / "none", "missing")):
        with pytest.raises(D.RuleLoadError) as e:
            D.load_rules(spark, str(path))
        assert e.value.kind == kind
    assert D.load_or_default(spark, str(bad), {"d": 1}) == ({"d": 1}, True) and D.load_or_default(spark, str(shape), {}) == ({"a": 1}, False)
    log = tmp_path / "log.json"
    log.write_text(json.dumps({"event_id": "1", "risk_score": 5}) + "\n\n{broken\n")
    assert [r.risk_score for r in D.read_events(spark, str(log)).collect()] == [5]


def test_folders_of_assets(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"asset_id": "x", "value": "v"}, 3, null, "y", []]')
    (tmp_path / "b.json").write_text('{"assets": [{"asset_id": "z", "value": "w"}, 1]}')
    (tmp_path / "c.json").write_text("[{")
    (tmp_path / "d.txt").write_text('[{"asset_id": "no", "value": "no"}]')
    assert sorted(r.asset_id for r in D.load_assets(spark, str(tmp_path)).collect()) == ["x", "z"]
    assert [r.asset_id for r in D.load_assets(spark, str(tmp_path), pattern="*.txt").collect()] == ["no"]


def test_assets_are_matched_with_the_given_registry(spark, tmp_path, capsys):
    (tmp_path / "own.json").write_text('[{"asset_id": "mine", "name": "n", "type": "exact", "value": "BLUE-HERON-7", "aliases": [], "risk_level": "high", "allowed_roles": [], "protection_modes": ["exact_match"], "enabled": true}]')
    cli.main(["asset", "match", "say BLUE-HERON-7 now", "--registry", str(tmp_path / "own.json")], spark)
    assert [json.loads(r)["asset_id"] for r in capsys.readouterr().out.splitlines()] == ["mine"]


def test_buffers_of_long_streams(spark):
    rows = [("a", i, [None, "", f"<{i}>"][i % 3]) for i in range(60)]
    got = {r.seq: r.buffer for r in ST.buffers(spark.createDataFrame(rows, "stream_id string, seq long, chunk string"), "stream_id", "seq", "chunk", 10).collect()}
    assert all(got[i] == "".join(c or "" for _, j, c in rows if j <= i)[-10:] for i in range(60))
