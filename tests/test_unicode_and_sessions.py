"""Normal forms in the JVM against Python's, sessions in linear work, rolling buffers, and detectors of users."""

import random
import re
import sys
import unicodedata

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F

from veilspark.functions import fixed_values as V
from veilspark.functions import text as T
from veilspark.operators import detectors as DT
from veilspark.operators import leakage as LK
from veilspark.operators import outputs as O
from veilspark.streaming import monitor as ST


def chain(t):
    t = unicodedata.normalize("NFKC", t).translate({0x3000: " "} | {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)})
    return t.translate(dict.fromkeys(map(ord, V.ZERO_WIDTH))).translate(str.maketrans(*V.HOMOGLYPHS)).casefold()


def test_normal_forms_of_all_scripts(spark):
    rng = random.Random(1)
    every = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c <= 0xDFFF and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    marks = [chr(c) for c in range(0x300, 0x370)] + list("가각힣각ﬁ①㍿ｱﾞがİßẞſΣς")
    rows = ["x".join(every[i : i + 50]) for i in range(0, len(every), 50)] + every[:3000]
    rows += ["".join(rng.choice(marks + ["a", "é", "e"]) for _ in range(8)) for _ in range(3000)] + ["", None, "plain ASCII", "\U000e0001"]
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    got = df.select("t", T.nfkc(F.col("t")).alias("n"), T.casefold(F.col("t")).alias("c"), T.unicode_chain(F.col("t")).alias("u"))
    assert "Python" not in got._jdf.queryExecution().toString()
    for r in got.collect():
        assert (r.n, r.c, r.u) == ((None,) * 3 if r.t is None else (unicodedata.normalize("NFKC", r.t), r.t.casefold(), chain(r.t))), r.t


def test_pieces_of_a_long_session(spark):
    """One session of 100,000 turns besides short ones; no window, and no task for the session alone."""
    value = "not_a_real_flag"
    rng, said = random.Random(2), {0: "xx not_", 7: "a_real", 50_000: "NOT_A", 99_998: "flag"}
    rows = [("long", i, said.get(i, "nothing")) for i in range(100_000)] + [(f"s{i % 40}", i, rng.choice(["not_a", "flag", "", None, "real"])) for i in range(400)] + [(None, 1, "flag"), (None, 2, "x"), ("s1", None, "not_")]
    out = LK.session_pieces(spark.createDataFrame(rows, "s string, i int, text string").repartition(6), "s", "i", value)
    assert "Window" not in out._jdf.queryExecution().toString()
    got = {(r.s, r.i): r.accumulated_fragments for r in out.collect()}
    assert len(got) == len(rows)
    grams = {value[k : k + 4] for k in range(len(value) - 3)}
    hits = lambda t: {g for g in grams if g in (t or "").lower()}
    seen: dict = {}
    for s, i, t in sorted(rows, key=lambda r: (r[0] or "", -1 if r[1] is None else r[1])):
        assert got[s, i] == sorted(seen.setdefault(s, set())), (s, i)
        seen[s] |= hits(t)


def test_rolling_buffers(spark):
    rng = random.Random(3)
    for size, longest in ((10, 25), (7, 3), (1, 2), (50, 4)):
        rows = [(rng.choice(["a", "b", None]), i, rng.choice([None, "", "é" * rng.randint(1, longest), f"<{i}>", "x" * rng.randint(0, longest)])) for i in range(300)]
        got = {r.seq: r.buffer for r in ST.buffers(spark.createDataFrame(rows, "s string, seq long, chunk string").repartition(3), "s", "seq", "chunk", size).collect()}
        assert all(got[i] == "".join(c or "" for t, j, c in rows if t == s and j <= i)[-size:] for s, i, _ in rows)


def found(texts, matched, **more):
    return pd.DataFrame({"matched": matched, "confidence": 0.5, "rule": "r"} | more, index=texts.index)


def test_detectors(spark):
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests

    def picky(texts):
        if texts.str.contains("bad").any():
            raise ValueError("bad text")
        return found(texts, texts.str.len() > 3)

    rows = [(1, "good text"), (2, "bad text"), (3, None), (4, "good text"), (5, "hi")]
    df = spark.createDataFrame(rows, "id long, text string")
    detectors = [
        DT.Detector("picky", picky, lambda t, d: pd.DataFrame({"action": "BLOCK", "safe_prompt": t.str.upper()}, index=t.index)),
        DT.Detector("short", lambda t: found(t, True).head(0)),
        DT.Detector("columns", lambda t: pd.DataFrame({"matched": [True] * len(t)})),
        DT.Detector("types", lambda t: found(t, True, confidence="much")),
        DT.Detector("defends wrongly", lambda t: found(t, t == "hi"), lambda t, d: None),
    ]
    got = {(r.id, r.skill): r for r in DT.detections(df, ["id"], detectors).collect()}
    assert len(got) == 25
    assert [got[i, "picky"].matched for i in (1, 2, 3, 4, 5)] == [True, None, False, True, False]
    assert got[2, "picky"].error == "ValueError: bad text" and got[1, "picky"].safe_prompt == "GOOD TEXT" and got[5, "picky"].action is None
    for skill in ("short", "columns", "types"):
        assert all(got[i, skill].error.startswith("schema: ") and got[i, skill].matched is None for i in range(1, 6))
    assert got[5, "defends wrongly"].error.startswith("schema: ")
    assert DT.detections(df, ["id"], []).count() == 0 and DT.detections(df.limit(0), ["id"], detectors).count() == 0


def test_places_of_many_findings(spark):
    """More matches than a block holds, and none."""
    patterns = {"number": ("[0-9]+", "secret", "FULL_LEAK", "REDACT", "[N]")}
    rng = random.Random(6)
    texts = ["", "none", "7", "".join(rng.choice(["12", "é", "x", " ", "4567"]) for _ in range(5000)), "1 " * 256, "1 " * 257, "a1" * 600]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", O.findings(F.col("t"), patterns).alias("f")).collect():
        assert [(f.matched_text, f.start) for f in r.f] == [(m[0], m.start()) for m in re.finditer("[0-9]+", r.t)]
