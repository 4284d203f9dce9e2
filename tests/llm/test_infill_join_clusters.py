"""Fill-in-the-middle, the Jaccard join and Lloyd's clusters against brute force, and their odd cases."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.llm import centroids, infill, metric_join
from veilspark.llm.common import mix

EXTRA = ["n", "form", "h", "nid", "label", "region", "key", "place", "cluster", "distance", "vector", "low", "component"]


def clashing(df):
    return df.withColumns({c: F.lit(1) for c in EXTRA if c not in df.columns})


# ---- fill in the middle -------------------------------------------------------------------------------------


def filled(doc_id, text):
    """The contract by plain loops: n, form, prefix and middle in code points, digests of output and text."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    told = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(told[i : i + 8], 16) for i in range(0, 32, 8)]
    n, sha = len(units), lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}"), sha(text)
    return n, "psm", len(p), len(m), sha(f"<P>{p}<S>{s}<M>{m}"), sha(text)


ODD = [None, "", " ", "a", "é", "漢字🙂 ab", "x<P>y", "<", "<S", "S>", "<<<S", "a <M> b", "ab\ncd\r\n\tE", "[`@{Zz", "\x00a", "word " * 30_000, "🙂" * 5000, "Z" * 4000]


def test_fill_in_middle(spark, monkeypatch):
    monkeypatch.setattr(infill, "HOT_BYTES", 3000)
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice("abYZ <>PSM.é漢🙂\n") for _ in range(rng.randint(0, 60))) for _ in range(400)] + ["the same text " * 9] * 200
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "repeated id"), (3, "repeated id"), (None, "no id"), (None, "other <S> text")]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))
    got = infill.fill_in_middle(df).collect()
    columns = ("n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
    assert sorted(str((r.doc_id, *(r[c] for c in columns))) for r in got) == sorted(str((i, *filled(i, t))) for i, t in rows)
    assert all(infill.restored(r.form, r.output) in texts + ["repeated id", "no id", "other <S> text", ""] for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert infill.fill_in_middle(df.limit(0)).count() == 0


def test_hot_texts_are_dealt_over_several_partitions(spark, monkeypatch):
    monkeypatch.setattr(infill, "HOT_BYTES", 3000)
    rows = [(i, "a hot text " * 10 if i % 3 == 0 else f"text {i}") for i in range(900)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as with more rows than one partition takes
    try:
        dealt = infill.dealt(spark.createDataFrame(rows, "doc_id long, text string"))
        spread = dealt.filter(F.col("text").startswith("a hot")).select(F.spark_partition_id().alias("p")).distinct().count()
        assert spread > 1 and dealt.count() == 900
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_elias_fano():
    rng = np.random.default_rng(3)
    for n, top in ((1, 1), (1, 10**6), (2, 3), (100, 100), (1000, 10**6), (70_000, 100_000), (5000, 5000)):
        values = np.sort(rng.choice(top + 1, n, replace=False))
        index = infill.EliasFano(values, top)
        ask = range(n) if n <= 1000 else rng.integers(0, n, 300).tolist() + [0, n - 1]
        assert [index.select(int(i)) for i in ask] == values[list(ask)].tolist()
        assert len(index.low) + len(index.high) <= n * (2 + max(0, np.log2(max(top, 1) / n))) / 8 + 4


# ---- Jaccard join -------------------------------------------------------------------------------------------


def corpus(seed, groups, copies, length, edits):
    rng, out = random.Random(seed), []
    word = lambda: f"w{rng.randrange(300)}"
    passage = [word() for _ in range(20)]
    for g in range(groups):
        base = [word() for _ in range(rng.randint(length // 2, length))]
        base[5:5] = passage if g % 2 else []
        for _ in range(rng.randint(1, copies)):
            words = list(base)
            for _ in range(rng.randint(0, edits)):
                words[rng.randrange(len(words))] = word()
            out.append(" ".join(words[: int(len(words) * rng.choice([1, 1, 1, 0.85]))]))
    return out


def components_of(spark, rows):
    got = metric_join.jaccard_components(clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)))
    return {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()}


def test_join_of_small_regions_and_odd_texts(spark):
    texts = corpus(1, 40, 6, 120, 6)
    texts += [None, "", " \t\n", "one two", "ONE\x0btwo", "one two three four five", "one two three four", "É é", "é é", "a b\x1fc d e f", texts[0], texts[0].upper(), texts[1].replace(" ", " \n"), "x " * 20_000, "x " * 9]
    rows = dict(enumerate(texts))
    assert components_of(spark, list(rows.items())) == metric_join.brute_force(rows)


@pytest.mark.parametrize("sent", [1 << 19, 0])
def test_join_of_large_regions(spark, monkeypatch, sent):
    """One loose group whose texts link here and there, split, salted and joined again, next to small groups."""
    for name, value in {"SMALL": 10, "PIVOTS": 3, "SALTED": 20, "FLUSH": 2000, "MOST_COPIES": 2.5, "MOST_SENT": sent}.items():
        monkeypatch.setattr(metric_join, name, value)
    rows = dict(enumerate(corpus(7, 6, 4, 80, 4) + corpus(9, 1, 1, 90, 0) * 3))
    rng, base = random.Random(4), [f"v{k}" for k in range(110)]
    for i in range(1000, 1045):
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(110)] = f"e{rng.randrange(40)}"
        rows[i] = " ".join(words)
    assert components_of(spark, list(rows.items())) == metric_join.brute_force(rows)


def test_join_at_the_threshold(spark):
    """Pairs of sets that share exactly four fifths, and one shingle less."""
    rows, at = {}, 0
    for size in (4, 5, 9, 18, 27, 90):
        for less in (0, 1):
            both = [f"{size}-{less}-{k}" for k in range(size * 8 // 9 + 4 - less)]
            one = both + [f"a{size}{less}{k}" for k in range(size // 9)]
            two = both + [f"b{size}{less}{k}" for k in range(size // 9)]
            rows |= {at: " ".join(one), at + 1: " ".join(two)}
            at += 2
    assert components_of(spark, list(rows.items())) == metric_join.brute_force(rows)


def test_join_of_repeated_rows_and_null_ids(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(5, text), (5, text), (3, text + " end"), (None, text), (9, "other words that are in no other text"), (None, "nothing like it"), (3, "a second text of id three")]
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in metric_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([("5", 56, "3"), ("5", 56, "3"), ("3", 57, "3"), ("None", 56, "3"), ("9", 4, "9"), ("None", 1, "None"), ("3", 2, "3")])
    assert metric_join.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_no_link_is_lost_to_the_triangle_inequality():
    rng = np.random.default_rng(5)
    for _ in range(20):
        base = mix(rng.integers(1, 2**62, 60, dtype=np.uint64))
        hs = [np.unique(np.concatenate([rng.choice(base, rng.integers(40, 60), replace=False), mix(rng.integers(1, 2**62, rng.integers(0, 8), dtype=np.uint64))])) for _ in range(25)]
        up = list(range(25))
        for i in range(25):
            for j in range(i):
                both = len(np.intersect1d(hs[i], hs[j]))
                if 5 * both >= 4 * (len(hs[i]) + len(hs[j]) - both) and up[i] != up[j]:
                    up = [up[j] if u == up[i] else u for u in up]
        mine = list(range(25))
        for i, j in metric_join.joined(hs, list(range(25))):
            mine = [mine[j] if u == mine[i] else u for u in mine]
        assert len(set(zip(up, mine))) == len(set(up)) == len(set(mine))


# ---- clusters -----------------------------------------------------------------------------------------------


def clusters_of(spark, rows, **options):
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4))
    return df, {r.vec_id: (r.cluster, r.distance) for r in centroids.centroid_clusters(df, **options).collect()}


def test_clusters_against_loops(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(i % 5, 0.4, 6)]) for i in range(300)]
    rows += [(1000 + i, rows[i][1]) for i in range(20)] + [(2000, [0.0] * 6), (2001, [-0.0] * 6)]
    _, got = clusters_of(spark, rows, dims=6, clusters=7, rounds=4)
    assert got == {i: (c, d) for i, c, d in centroids.brute_force([v for _, v in rows], [i for i, _ in rows], 7, 4)}


def test_vectors_that_are_left_out(spark):
    nan, inf, good = float("nan"), float("inf"), [1.0, 2.0]
    rows = [(1, good), (2, None), (3, []), (4, [1.0]), (5, [1.0, 2.0, 3.0]), (6, [1.0, None]), (7, [nan, 1.0]), (8, [1.0, inf]), (9, [-inf, 0.0]), (None, [5.0, 5.0]), (1, good), (1, [1.0, 3.0])]
    df, _ = clusters_of(spark, rows, dims=2, clusters=2, rounds=1)
    got = centroids.centroid_clusters(df, dims=2, clusters=2, rounds=1).collect()
    assert sorted(str(r.vec_id) for r in got) == ["1", "1", "1", "None"]
    assert centroids.centroid_clusters(df.limit(0), dims=2).count() == 0
    few = centroids.centroid_clusters(df, dims=2, clusters=40, rounds=2).collect()  # each a centroid, equal ones share the first
    assert all(r.distance == 0 and r.inertia == 0 for r in few) and len({r.cluster for r in few}) == 3


def test_large_components_are_exact(spark):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate([(2.0**40, -(2.0**40)), (2.0**40 + 2.0**18, 0.0), (1.0, 2.0), (3.0, -5.0), (3.0e38, -3.0e38), (2.0**22, 2.0**22)])]
    df, got = clusters_of(spark, rows, dims=2, clusters=3, rounds=3)
    rows = {r.vec_id: [float(x) for x in r.embedding] for r in df.collect()}
    want = centroids.brute_force(list(rows.values()), list(rows), 3, 3)
    assert got == {i: (c, d if d <= centroids.LARGEST else None) for i, c, d in want}


def test_digits():
    for x in (0, 1, -1, 2**39, -(2**40), 2**200 + 7, -(2**90) - 3):
        assert sum(d << (centroids.DIGIT * k) if d >= 0 else -(-d << (centroids.DIGIT * k)) for k, d in enumerate(centroids.digits(x))) == x


def test_equal_distances_go_to_the_lower_number():
    assert centroids.nearest(np.array([[0, 0], [2, 0]]), np.array([[1, 0], [-1, 0], [1, 0]]))[0].tolist() == [0, 0]
