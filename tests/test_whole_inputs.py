"""Queries over whole texts and all rows, against brute force."""

import unicodedata

from veilspark.functions import fixed_values as V
from veilspark.plans import queries_outputs, queries_prompts  # noqa: F401  the queries fill the registry
from veilspark.plans.registry import QUERIES

#: Turns that get no phrase of the probes; long ones, short ones, other scripts, controls.
TEXTS = {1: "plain ASCII words that go on for more than forty characters, and then a cafe", 4: "é first, then 漢字 and more: " + "tail " * 30, 7: "x", 12: "", 18: None, 26: "bell \x07 inside"}


def run(spark, tmp_path, name):
    spark.createDataFrame([(0, i, "user", t) for i, t in TEXTS.items()], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    return QUERIES[name](spark, str(tmp_path)).collect()


def test_confusables_of_whole_texts(spark, tmp_path):
    table = dict(zip(*V.HOMOGLYPHS))
    planted = {i: (t or "").translate(str.maketrans("ae", "ае")) for i, t in TEXTS.items()}
    want = sorted((i, c, table[c]) for i, t in planted.items() for c in unicodedata.normalize("NFKC", t) if c in table)
    assert sorted((r["turn"], r["from"], r["to"]) for r in run(spark, tmp_path, "NRM10_steps")) == want


def test_payloads_of_whole_texts(spark, tmp_path):
    got = {r.turn: (r.base64, r.hex) for r in run(spark, tmp_path, "NRM11")}
    whole = {i: t if t and "\x07" not in t else None for i, t in TEXTS.items()}  # what isn't readable decodes to nothing
    assert got == {i: (t, t if t and len(t.encode()) >= 2 else None) for i, t in whole.items()}


def test_escapes_of_whole_texts(spark, tmp_path):
    assert {r.turn: r.out for r in run(spark, tmp_path, "NRM16")} == {i: t or None for i, t in TEXTS.items()}


def test_history_of_whole_texts(spark, tmp_path):
    got = {r.turn: r.recent for r in run(spark, tmp_path, "WIN4")}
    assert got == {i: "|".join(t for j, t in TEXTS.items() if j <= i and t is not None) for i in TEXTS}


def test_scores_are_rounded_half_to_even(spark, tmp_path):
    spark.createDataFrame([(i, 1, "click", float(i)) for i in range(101)], "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_id: r.r for r in QUERIES["FN22"](spark, str(tmp_path)).collect()}
    assert got == {i: round(i / 8, 2) for i in range(101)}
