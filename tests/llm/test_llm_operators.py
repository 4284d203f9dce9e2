"""Operators against brute force, exact round trips and held-out accuracy, and their odd cases."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veilspark.llm import cuckoo_dedup, decontam, kneser_ney, langid, licenses, minhash, pieces, pii, queries, token_rollup, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha bravo carbon delta echo fox golf hotel india jazz kilo lima mike nova oscar papa quest romeo sierra tango umbra vivid whisky xenon yankee zulu".split()
ODD = [None, "", "   ", "x", "é ü ñ 漢字 🙂", "a b c d", "word " * 30_000, "\x00\x01", "0" * 5000, "@" * 300 + "a@b", "1 " * 400]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS)[:2] for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    rows = [prose(rng, rng.randint(20, 150)) for _ in range(60)]
    for i in range(12):  # near copies, some of copies
        words = rows[i % 5].split()
        for _ in range(1 + i // 4 * 2):
            words[rng.randrange(len(words))] = f"edit{i}"
        rows.append(" ".join(words))
    rows += [rows[0]] * 9 + [rows[1].replace(" ", "\n\t")] + ODD
    return [(i, t, rng.choice(["en", "de", None]), f"s{i % 3}", 0) for i, t in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(5)


def odd_table(spark):
    """Nulls, repeated rows and extra columns with clashing names."""
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "same"), (None, "same"), (3, "x"), (3, "other")]
    names = ["ids", "decoded", "severity", "contamination", "node", "bucket", "rank", "digest", "keep_id", "label", "value", "text_a", "words"]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit(1) for n in names})


def test_cuckoo_index():
    index, keys = cuckoo_dedup.CuckooIndex(2), [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    assert all(index.insert(k, 1, i) for i, k in enumerate(keys)) and index.resizes > 0 and len(index) == 3000
    assert not index.insert(keys[7], 2, 3) and index.get(keys[7]) == [3, 3]
    assert all(k in index for k in keys) and hashlib.sha256(b"no").digest() not in index
    assert all(index.delete(k) for k in keys[:1000] if k != keys[7]) and keys[5] not in index and keys[7] in index
    assert index.delete(keys[7], 3) and not index.delete(keys[7]) and len(index) == 2000
    assert sorted(k for k, _ in index.items()) == sorted(keys[1000:])


def test_deletion_keeps_the_next_smallest():
    index, key = cuckoo_dedup.CuckooIndex(2), hashlib.sha256(b"k").digest()
    index.insert(key, 1, 5), index.insert(key, 1, 9)
    assert index.delete(key, 1, smallest=9) and index.get(key) == [1, 9]
    assert index.delete(key) and key not in index and not index.delete(key)


def test_groups_after_deletions(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("aaaaabcdefgh")) for i in range(400)] + [(None, "a"), (None, "n"), (7, "a"), (7, "a")]
    rows = [(i, t, i is not None and i % 3 == 0 or t in "gn") for i, t in rows]
    table = spark.createDataFrame(rows, "doc_id long, text string, dead boolean").repartition(4)
    hashed = table.select("doc_id", "dead", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))
    gone, stay = hashed.filter("dead"), hashed.filter("NOT dead")
    other = spark.createDataFrame([(1, b"never seen")], "doc_id long, digest binary")
    out = cuckoo_dedup.groups_after(cuckoo_dedup.live_groups(hashed), stay, gone.select("doc_id", "digest").unionByName(other)).collect()
    want = {}
    for i, t, dead in rows:
        if not dead:
            n, least = want.get(t, (0, None))
            want[t] = (n + 1, i if least is None else least if i is None else min(i, least))
    assert {bytes(r.digest): (r.group_size, r.keep_id) for r in out} == {hashlib.sha256(t.encode()).digest(): x for t, x in want.items()}


def test_exact_dedup(docs, corpus):
    groups = {}
    for i, t, *_ in corpus:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    want = {i: (g[0], len(g), i == g[0], hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in cuckoo_dedup.exact_dedup(docs).collect()}
    assert got == want
    assert {r.doc_id for r in cuckoo_dedup.deduplicated(docs).collect()} == {g[0] for g in groups.values()}


def test_near_dedup(spark, docs, corpus):
    idf = minhash.idf_table(docs.fillna("", "text")).dense()
    texts = {i: minhash.words_of(t or "") for i, t, *_ in corpus}
    feats = {i: minhash.shingles(w, minhash.word_hashes(w), idf) for i, w in texts.items() if w}
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(feats, 2):
        if texts[a] == texts[b] or minhash.similarity(feats[a], feats[b]) >= 0.8:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    assert got == {i: root(i) for i in texts}
    assert {r.doc_id for r in minhash.without_near_duplicates(docs).collect()} == {i for i in texts if root(i) == i}


def test_chain_component(spark):
    links = spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in range(40)] + [(b"x", b"y")], "a binary, b binary")
    for share in (3, 1000):
        got = {bytes(r.node): bytes(r.component) for r in minhash.components(links, share).collect()}
        assert len(got) == 43 and {got[bytes([i])] for i in range(41)} == {b"\0"} and got[b"y"] == b"x"
    assert minhash.components(links.limit(0)).count() == 0


def test_prefix_loses_no_pair():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 60)
    sets = []
    for _ in range(80):
        h = np.unique(rng.choice(pool, rng.integers(20, 50), replace=False))
        sets.append((h, (h % 5 + 1).astype(np.float32)))
    count = {x: sum(x in h for h, _ in sets) for x in pool.tolist()}
    for a, b in itertools.combinations(sets, 2):
        if minhash.similarity((a[0].view(np.uint64), a[1]), (b[0].view(np.uint64), b[1])) >= 0.8:
            (x, before_x), (y, before_y) = (minhash.prefix(h, w, s := h[[count[i] > 1 for i in h.tolist()]], np.array([count[i] for i in s.tolist()]), 0.8) for h, w in (a, b))
            both, i, j = np.intersect1d(x, y, return_indices=True)
            assert both.size
            at, total = i.argmin(), (a[1].sum(), b[1].sum())
            assert before_x[i[at]] + before_y[j[at]] <= sum(total) / 9 + 1e-3
            assert min(total[0] - before_x[i[at]], total[1] - before_y[j[at]]) >= 4 / 9 * sum(total) - 1e-3


def test_links_of_a_loose_group(spark):
    """One text with few and many edits, so that bucket leaders show only some links: all links against all pairs."""
    rng = random.Random(12)
    base = prose(rng, 90).split()
    texts = []
    for i in range(220):
        words = list(texts[rng.randrange(len(texts))].split() if texts and i % 3 else base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 6])):
            words[rng.randrange(len(words))] = rng.choice(WORDS) if i % 2 else f"e{i}x{rng.randrange(99)}"
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    idf = minhash.idf_table(df).dense()
    feats = [minhash.shingles(w := minhash.words_of(t), minhash.word_hashes(w), idf) for t in texts]
    want = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if want[a] != want[b] and minhash.similarity(feats[a], feats[b]) >= 0.8:
            low, high = sorted((want[a], want[b]))
            want = [low if x == high else x for x in want]
    assert 1 < len(set(want)) < len(want)
    assert {r.doc_id: r.class_id for r in minhash.near_duplicates(df).collect()} == dict(enumerate(want))
    # each text a component of its own: the rounds alone, without leaders
    rest = [(i, i, float(w.sum(dtype=float)), h.view(np.int64).tolist(), w.tolist()) for i, (h, w) in enumerate(feats)]
    links = minhash.links_between(spark.createDataFrame(rest, "nid long, cid long, total double, h array<long>, w array<float>"), 0.8)
    got = list(range(len(texts)))
    for r in [r for x in links for r in x.collect()]:
        low, high = sorted((got[r.a], got[r.b]))
        got = [low if x == high else x for x in got]
    equal = {}
    assert len(links) > 1 and [equal.setdefault(x, y) for x, y in zip(got, want)] == want and len(set(got)) == len(set(want))


def test_near_dedup_of_repeated_ids(spark):
    rng = random.Random(13)
    one, other = prose(rng, 60), prose(rng, 60)
    rows = [(1, one), (2, one), (2, other), (None, one), (None, prose(rng, 60)), (None, prose(rng, 60)), (7, None), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = minhash.without_near_duplicates(df).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == sorted((i or 0, t or "") for i, t in rows if t != one or i == 1)


def test_language(spark):
    rng = random.Random(1)
    make = lambda syl: " ".join("".join(rng.choice(syl) for _ in range(rng.randint(1, 3))) for _ in range(40))
    langs = {"aa": ["tha", "ing", "er", "on"], "bb": ["eau", "oi", "que", "ç"], "cc": ["ung", "sch", "ü", "ein"]}
    rows = [(i, make(langs[k]), k) for i, k in enumerate(rng.choice(list(langs)) for _ in range(200))] + [(900, None, "aa"), (901, "12 34", "aa"), (902, "The", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.language_id(df).collect()}
    for i, _, k in rows[:200]:
        assert got[i].lang_pred == k and 0 <= got[i].score <= 1 and got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[902].lang_pred in langs


def test_bundles_against_brute_force():
    rng = random.Random(12)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 6000)] + list("abcdeÄäßЖжİ")
    texts = ["", "12 3", "a", "Ab-ab", "жЖ ä"] + ["".join(rng.choice(letters + [" ", "."]) for _ in range(rng.randint(1, 400))) for _ in range(120)]
    space = langid.Hypervectors(64)
    got, has = space.bundle(texts)
    for t, row, ok in zip(texts, got, has):
        low = [ord(c.lower()[0]) if c.isalpha() else 0 for c in t]
        want, some = np.zeros(64), False
        for i, c in enumerate(low):
            if c:
                some = True
                u, v = low[i - 1] if i else 0, low[i + 1] if i + 1 < len(low) else 0
                want += np.roll(space.letter(u), 2) * np.roll(space.letter(c), 1) * space.letter(v)
        assert ok == some and (row == want).all()
    low = {c.lower()[0] for c in letters}
    assert len({space.letter(ord(c)).tobytes() for c in low}) == len(low)


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    out = [f"email:{m.start()}:{m.end()}" for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [f"ip:{m.start()}:{m.end()}" for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [f"card:{m.start()}:{m.end()}" for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
    return ",".join(out + [f"phone:{m.start()}:{m.end()}" for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15])


def test_personal_data(spark):
    rng = random.Random(2)
    bits = ["a.b@c.de", "x@y.z_q@r.st", "a@b", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.2.3.004", "4111 1111 1111 1111", "4111-1111-1111-1112", "41111111 11111111 1", "+1 (469) 555-8958", "+12", "+1 22.33-44 55 66 77 88 99 00", "é🙂", "word", "12", "..", "a..b@c..d", "%+-@x-.y", "John Smith", "123-45-6788", "(212) 555-0199", "my name is Jane Doe"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", "\n", "-"]) for _ in range(rng.randint(0, 12))) for _ in range(400)] + ODD
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.report(rows).collect():
        want = base_spans(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (texts[r.doc_id], want, r.spans)
        assert r.spans.startswith(want) and r.n_email == want.count("email")
    named = spark.createDataFrame([(1, "Hello, my name is Jane Doe. Mail a@b.com"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in pii.redacted(named).collect()}[2] is None


def test_decontamination(spark):
    rng = random.Random(3)
    item = "If Tom has 3 apples and Mary gives Tom 14 more apples for 2 dollars how many apples does Tom have in the end"
    swap = "If Omar has 8 apples and Priya gives Omar 91 more apples for 5 euros how many apples does Omar have in the end"
    mixed = "If Omar has 8 apples and Priya gives Anna 91 more apples for 5 euros how many apples does Jack have in the end"
    texts = [prose(rng, 30) + ". " + item + ". " + prose(rng, 30), swap, mixed, prose(rng, 200), " ".join(item.split()[:6]), None, ""]
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, "too short"), (None, item)], "item_id long, text string")
    got = {r.doc_id: r for r in decontam.decontaminate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bench).collect()}
    assert [got[i].contaminated for i in range(len(texts))] == [True, True, False, False, False, False, False]
    assert got[0].item_ids == [1] and got[1].coverage >= 0.9
    none = decontam.decontaminate(spark.createDataFrame([(1, item)], "doc_id long, text string"), bench.limit(0))
    assert not none.first().contaminated


def contaminates(item, text):
    return [i for i, _ in decontam.Matcher(decontam.TemplateIndex([(1, item)])).match_all([text])[0]] == [1]


def test_items_that_templates_leave_out():
    around = "They walked quietly along some river. {} Then they slept there."
    short, numbers, titled = "Define prime number please.", "12 34 56 78 90 11 22 33 44", "The Great Gatsby Was Written By Francis Scott Fitzgerald"
    for item in (short, numbers, titled, "小明有三个苹果和五个橘子请问他一共有多少个水果", "Yes."):
        assert contaminates(item, around.format(item + "\n")) and contaminates(item, item) and not contaminates(item, around.format(""))
    assert not contaminates(short, "Now define prime number please, he said.") and not contaminates(numbers, "12 34 56 78 0 90 11 22 33")
    assert not contaminates("小明有三个苹果和五个橘子请问他一共有多少个水果", "你好小明再见")
    assert contaminates(titled, "Read: the great Gatsby was written by Francis Scott Fitzgerald and more")


def test_words_against_the_pattern():
    rng = random.Random(21)
    everything = "".join(map(chr, range(0x110000)))
    pool = [*"aZé_1٣५๓ก漢かİßǅ½²。！.,!?\n -", "1.5", "1,000.7", "3..4", "Tom", "twenty", "\ud800"]
    texts = ["", ".", "1.", ",1,2.", "a" * 9000] + ["".join(rng.choice(pool) for _ in range(rng.randint(1, 90))) for _ in range(400)] + [everything, " ".join(everything)]
    x = decontam.Canonicaliser().words_of(texts)
    want = [decontam.plain_words(t) for t in texts]
    assert x.lens.tolist() == [len(w) for w in want] and x.template_lens.sum() == x.begins.sum() == len(x.code)
    first = [w[:1] + "".join(c.lower()[0] for c in w[1:]) for ws in want for w in ws]
    by_word = {}
    for w, h in zip(first, x.plain.tolist()):
        by_word.setdefault(h, set()).add("".join(c for c in w if c != "\u0307"))
    assert all(len(v) == 1 for v in by_word.values()) and len(by_word) > 100_000


def test_slots_of_several_words():
    item = "If Tom has 25 apples and Mary gives Tom 14 more apples how many apples does Tom have in the end"
    assert contaminates(item, item.replace("Tom", "Mary Ann").replace("25", "twenty-five").replace("Mary gives", "Bob gives"))
    assert not contaminates(item, item.replace("Tom has", "Ann Lee has").replace("Tom have", "Bob Ray have").replace("gives Tom", "gives Jack"))


def test_one_edit_hides_no_item():
    rng = random.Random(8)
    words = [a + b for a in WORDS for b in WORDS[:6]]
    for n in (18, 19, 21, 25, 32):
        item = rng.sample(words, n)
        for k in range(n):
            for edit in (["added", item[k]], ["changed"], []):
                assert contaminates(" ".join(item), prose(rng, 9) + " " + " ".join(item[:k] + edit + item[k + 1 :]) + " " + prose(rng, 9)), (n, k, edit)
        assert not contaminates(" ".join(item), " ".join(rng.sample(item, n))) and not contaminates(" ".join(item), " ".join(item[-8:] + prose(rng, 9).split() + item[:8]))  # two windows in the wrong order


def test_longest_rising_row():
    rng = random.Random(6)
    for _ in range(60):
        spots = list({(rng.randint(0, 6), rng.randint(0, 6)) for _ in range(rng.randint(1, 9))})
        got = decontam.rising(spots)
        assert all(a < c and b < d for (a, b), (c, d) in zip(got, got[1:])) and set(got) <= set(spots)
        rows = (r for k in range(1, len(spots) + 1) for r in itertools.combinations(sorted(spots), k))
        assert len(got) == max(len(r) for r in rows if all(a < c and b < d for (a, b), (c, d) in zip(r, r[1:])))


def test_toxicity(spark):
    rng = random.Random(4)
    bad = ["grim", "vile", "nasty"]
    rows, labels = [], []
    for i in range(400):
        words, toxic = prose(rng, 60).split(), i % 5 == 0
        for _ in range(rng.randint(1, 9) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words)))
        if i < 250:
            labels.append((i, int(toxic or i % 41 == 1)))
    df, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (3, None), (0, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(df, known).collect()}
    assert all(got[i].toxic == (i % 5 == 0) for i in range(400))
    many = [got[i].expected_severity for i, t in rows if sum(t.count(b) for b in bad) >= 8]
    few = [got[i].expected_severity for i, t in rows if sum(t.count(b) for b in bad) == 1]
    assert sum(many) / len(many) > sum(few) / len(few)
    assert not toxicity.toxicity(df, known.limit(0)).filter("toxic").count()


def test_kneser_ney(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randint(0, 40)).upper()) for i in range(120)] + [(500, None), (501, ""), (502, "never seen words"), (503, "É é")]
    got = {r.doc_id: r for r in kneser_ney.language_model_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    split = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    train = [split(t) for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    c, pairs = Counter(w for s in train for w in s), Counter(p for s in train for p in zip([0, *s], s))
    n, v = sum(c.values()), len(c)
    total, kinds, follows = Counter(), Counter(), Counter(w for _, w in pairs)
    for (u, _), k in pairs.items():
        total[u] += k
        kinds[u, min(k, 3)] += 1
    d2, d1 = ([0, *kneser_ney.discounts([float(sum(x == k for x in t.values())) for k in (1, 2, 3, 4)])] for t in (pairs, follows))
    left = sum(d1[min(k, 3)] for k in follows.values()) / len(pairs)

    def p(u, w):
        low = max(follows[w] - d1[min(follows[w], 3)], 0) / len(pairs) + left / (v + 1)
        if not total[u]:
            return low
        k = pairs[u, w]
        return max(k - d2[min(k, 3)], 0) / total[u] + sum(d2[j] * kinds[u, j] for j in (1, 2, 3)) / total[u] * low

    for i, t in rows:
        s, r = split(t), got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(s), sum(c[w] > 0 for w in s), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in s), rel_tol=1e-9)
        assert math.isclose(r.score, sum(math.log10(p(u, w)) for u, w in zip([0, *s], s)), rel_tol=1e-9)
    assert math.isclose(sum(p("alphabr", w) for w in c) + p("alphabr", "unknown"), 1, rel_tol=1e-9)


@pytest.mark.parametrize("order", [3, 4])
def test_kneser_ney_of_higher_order(spark, order):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(WORDS[:6]) for _ in range(rng.randint(0, 25)))) for i in range(150)] + [(500, None), (501, "never seen words alpha")]
    got = {r.doc_id: r for r in kneser_ney.language_model_scores(spark.createDataFrame(rows, "doc_id long, text string"), order).collect()}
    split = lambda t: [*(t or "").split(), "</s>"]
    grams = lambda s: [tuple((["<s>"] * (order - 1) + s)[i : i + order]) for i in range(len(s))]
    counts = {order: Counter(g for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1 for g in grams(split(t)))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    d = {k: [0, *kneser_ney.discounts([float(sum(x == j for x in c.values())) for j in (1, 2, 3, 4)])] for k, c in counts.items()}

    def p(g):
        k, c = len(g), counts[len(g)]
        own = {x: n for x, n in c.items() if x[:-1] == g[:-1]}
        low = p(g[1:]) if k > 1 else 1 / (len(c) + 1)
        if not own:
            return low
        return (max(c[g] - d[k][min(c[g], 3)], 0) + sum(d[k][min(n, 3)] for n in own.values()) * low) / sum(own.values())

    for i, t in rows:
        assert math.isclose(got[i].score, sum(math.log10(p(g)) for g in grams(split(t))), rel_tol=1e-9)


def test_missing_files_of_a_model(spark):
    df = spark.createDataFrame([(i, prose(random.Random(i), 30)) for i in range(20)], "doc_id long, text string")
    model = kneser_ney.train(df)
    assert model.files and kneser_ney.Scorer(model).score_all(["alpha bravo"]).n_tokens.tolist() == [3]
    model.folder += "-gone"
    with pytest.raises(FileNotFoundError):
        kneser_ney.Scorer(model).score_all(["alpha bravo"])


@pytest.mark.parametrize("n", [0, 1, 2, 15, 16, 5000])
def test_ranged_keys(n):
    rng = np.random.default_rng(n)
    key = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
    low, index = kneser_ney.ranged(key)
    other = np.sort(rng.integers(0, 2**64, 3000, dtype=np.uint64))
    assert kneser_ney.places_of(key, low, index).tolist() == list(range(len(key)))
    assert (kneser_ney.places_of(other, low, index) == -1).all()
    assert (kneser_ney._keys(kneser_ney._packed_keys(key)) == key).all()


def test_op7_tells_scrambled_texts(spark, tmp_path):
    texts = ["a b c"] * 20 + ["d b e"] * 20 + ["a b e"]  # every pair of the last one is seen as often as those of the others
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 != 1][:40] + [next(i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 1)]
    spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.perplexity for r in queries.op7_kneser_ney(spark, str(tmp_path)).collect()}
    assert got[ids[-1]] > 1.5 * got[ids[0]]


def test_sentencepiece(spark):
    import sentencepiece

    lib, rng = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model()), random.Random(7)
    texts = [t or "" for t in ODD] + ["".join(rng.choice("abehtinr \n\t▁é漢🙂  ") for _ in range(rng.randint(0, 50))) for _ in range(500)] + ["heh" * 900, " " * 3000 + "x", "<s> <0x41>"]
    coded = pieces.encode_decode(spark.createDataFrame(list(enumerate(texts)), "i long, text string")).collect()
    for r in coded:
        ids = lib.encode(texts[r.i])
        assert r.ids == ids and r.decoded == lib.decode(ids)
    back = pieces.decode_ids(spark.createDataFrame([([300, 12, 29000],), ([],), (None,), ([230, 3, 231],)], "ids array<int>"))
    got = [r.decoded for r in back.collect()]
    assert got == [lib.decode([300, 12, 29000]), "", None, lib.decode([230, 3, 231])]


def test_licenses(spark):
    rows = ["Licensed under CC BY-NC 4.0.", "cc by cc by", "GNU General Public License, version 3", "This work is licensed under the GNU General Public License, version 3.", "ALL RIGHTS reserved", "redistributed under MIT", "Permission is hereby granted, free of charge", None, ""]
    got = [r for r in licenses.license_report(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert [r.base_labels for r in got] == ["cc-by", "cc-by", "gpl", "gpl", "reserved", "", "", "", ""]
    assert (got[1].n_base, got[1].first_word, got[1].last_word) == (2, 0, 2) and got[7].first_word is None and got[0].n_words == 7
    assert "notice:gpl" in got[3].labels and "notice:gpl" not in got[2].labels and "notice:cc-by-nc" in got[0].labels
    a = licenses.compile_template("t", "one [[maybe]] two {{x|2}} end")
    ok = lambda t: a.longest(licenses.words_of(t), 0)
    assert ok("one two a end") == 4 and ok("one maybe two a b end") == 6 and ok("one two end") == -1 and ok("one two a b c end") == -1


def test_licenses_of_whole_wording():
    scanner, templates = licenses.LicenseScanner(), dict(licenses.TEMPLATES)
    labels = lambda t: {h[0] for h in scanner.scan(t)[1]}
    fill = lambda t: re.sub(r"\{\{.*?\}\}", "Some Holder", re.sub(r"\[\[.*?\]\]", "", t))
    for name in [n for n in templates if n.startswith("text:")]:
        text = fill(templates[name])
        assert {n for n in labels("Before. " + text + ". After.") if n.startswith("text:")} == {name}
        words = text.split()
        fixed = [k for k in range(1, len(words)) if not {"Some", "Holder"} & set(words[k - 1 : k + 1])]
        for k in fixed[:: len(fixed) // 9]:
            assert name not in labels(" ".join(words[:k] + ["altered"] + words[k:]))
    two = "Copyright 2020 Ann. All rights reserved. Copyright 2021 Bob. All rights reserved."
    assert [h[1:3] for h in scanner.scan(two)[1] if h[0] == "notice:reserved"] == [(0, 5 + 1), (6, 12)]


def test_license_positions_of_many_hits():
    words, hits = licenses.LicenseScanner().scan("cc by x " * 50_000)
    assert words == 150_000 and [h[1] for h in hits if h[3]] == list(range(0, 150_000, 3))


def test_rollup(spark, docs):
    roll = token_rollup.TokenRollup(spark)
    words = token_rollup.word_counts(docs)
    assert roll.totals().count() == 0
    assert roll.commit("a", token_rollup.inserts(words, "w")) and not roll.commit("a", token_rollup.inserts(words, "w"))
    want = {(r.source, r.lang): r.t for r in words.groupBy("source", "lang").agg(F.sum("tokens").alias("t")).collect()}
    assert {(r.source, r.lang): r.tokens for r in roll.totals().collect()} == want
    roll.commit("b", token_rollup.revisions(words, "w", words.withColumn("tokens", F.col("tokens") * 2), "w"))
    roll.compact()
    assert not roll.commit("b", token_rollup.inserts(words, "w")) and len(roll.manifest()["parts"]) == 1
    assert {(r.source, r.lang): r.tokens for r in roll.totals().collect()} == {k: 2 * v for k, v in want.items()}
    roll.commit("c", token_rollup.deletes(words.withColumn("tokens", F.col("tokens") * 2), "w"))
    assert roll.totals().count() == 0


def test_rollup_of_corpus(spark):
    import public_tokenizers
    import tiktoken

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    rng = random.Random(8)
    rows = [(i % 40, rng.choice([*ODD, prose(rng, 30)]), rng.choice(["en", None]), rng.choice(["hot", "hot", "s", None])) for i in range(120)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("tokens", F.lit("clash"))
    bpe, want = tiktoken.Encoding("test", pat_str=pattern, mergeable_ranks=token_rollup.load_ranks(path), special_tokens={}), Counter()
    for _, t, lang, source in rows:
        t = t or ""
        for name, n in (("byte_bpe_50k", len(bpe.encode_ordinary(t))), ("words_v1", len(re.findall(r"[^\x20\x09-\x0D]+", t)))):
            for column, x in (("docs", 1), ("tokens", n), ("chars", len(t))):
                want[source, lang, name, column] += x
    out = token_rollup.rollup_of_corpus(table, path, pattern).collect()
    got = {(r.source, r.lang, r.tokenizer, c): r[c] for r in out for c in ("docs", "tokens", "chars")}
    assert got == dict(want)
    assert token_rollup.rollup_of_corpus(table.limit(0), path, pattern).count() == 0


def test_rollup_measures_texts_beside_a_column_of_that_name(spark):
    table = spark.createDataFrame([("s", "en", "thirteen char", 5)], "source string, lang string, text string, chars long")
    roll = token_rollup.TokenRollup(spark)
    roll.commit("a", token_rollup.inserts(token_rollup.word_counts(table), "w"))
    assert [(r.docs, r.tokens, r.chars) for r in roll.totals().collect()] == [(1, 2, 13)]
    roll.commit("b", token_rollup.inserts(token_rollup.word_counts(table), "w", "chars"))
    assert [(r.docs, r.chars) for r in roll.totals().collect()] == [(2, 18)]


def test_readers_outlive_a_compaction(spark, docs):
    roll, words = token_rollup.TokenRollup(spark), token_rollup.word_counts(docs)
    roll.commit("a", token_rollup.inserts(words, "w")), roll.commit("b", token_rollup.inserts(words, "v"))
    planned = roll.totals()
    roll.compact()
    assert sorted(planned.collect(), key=str) == sorted(roll.totals().collect(), key=str)
    parts = roll.manifest()["old"]
    roll.commit("c", token_rollup.inserts(words, "u"))
    roll.compact()
    assert len(parts) == 2 and not any(roll._fs.exists(roll._path(p)) for p in parts)


def test_batch_names_survive_compaction(spark, docs):
    roll, words = token_rollup.TokenRollup(spark), token_rollup.word_counts(docs)
    for name in ("a", "b", "c"):
        assert roll.commit(name, token_rollup.inserts(words, "w"))
    before = sorted(roll.totals().collect(), key=str)
    roll.compact()
    assert roll.manifest()["names"] == [] and sorted(roll.totals().collect(), key=str) == before
    assert not any(roll.commit(name, token_rollup.inserts(words, "w")) for name in ("a", "b", "c"))
    assert roll.commit("d", token_rollup.deletes(words, "w")) and sorted(roll.totals().collect(), key=str) != before


def test_odd_tables(spark):
    odd = odd_table(spark)
    bench, labels = spark.createDataFrame([(1, "x")], "item_id long, text string"), spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    for table in (odd, odd.limit(0)):
        n = table.count()
        t = table.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s")})
        assert cuckoo_dedup.exact_dedup(t).count() == n and minhash.near_duplicates(t).count() == n and langid.language_id(t).count() == n
        assert pii.report(t).count() == n and decontam.decontaminate(t, bench).count() == n and toxicity.toxicity(t, labels).count() == n
        assert kneser_ney.language_model_scores(t).count() == n and pieces.encode_decode(t).count() == n and licenses.license_report(t).count() == n
        assert cuckoo_dedup.deduplicated(t).count() <= n and minhash.without_near_duplicates(t).columns == t.columns


def tables(top, spark, rows, labels, items):
    """Documents (with a column called as one of the operators' own), labels and benchmark as Parquet."""
    spark.createDataFrame(rows, DOCS).withColumn("node", F.lit("mine")).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return str(top)


def test_pipeline_against_what_was_planted(spark, tmp_path):
    """Of the documents that are planted it is known which go at which stage."""
    rng = random.Random(21)
    foul = lambda: " ".join(rng.choice(["vile", "scum", "filth"]) if rng.random() < 0.3 else rng.choice(WORDS) for _ in range(60))
    clean = [(i, prose(rng, 60)) for i in range(120)]
    toxic = [(i, foul()) for i in range(200, 260)]
    item = prose(rng, 40)
    near = clean[0][1].split()
    near[30] = "edited"
    more = [(500, clean[1][1]), (501, " ".join(near)), (502, prose(rng, 20) + " " + item + " " + prose(rng, 5)), (503, None), (504, ""), (505, "   "), (506, clean[2][1]), (506, clean[2][1]), (None, prose(rng, 50))]
    rows = [(i, t, rng.choice(["en", None]), None if i is None or i % 5 else "s", 0) for i, t in clean + toxic + more]
    labels = [(i, 1, 0) for i in range(60)] + [(i, 0, 1) for i in range(200, 230)] + [(None, 0, 1), (40, None, None)]
    folder = tables(tmp_path, spark, rows, labels, [(1, item), (2, None), (None, "")])
    out = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in out) == sorted([(False, i) for i, _ in clean] + [(False, 503), (False, 505), (True, None)])
    encoded = {r.doc_id: (r.n_tokens, r.text) for r in out}
    assert encoded[503] == (0, "") and encoded[3][1] == clean[3][1] and all(r.n_tokens == len(r.ids) for r in out)


def test_pipeline_of_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(tmp_path, spark, [], [], [])).count() == 0


def test_pipeline(spark, tmp_path, docs):
    rng = random.Random(9)
    item = prose(rng, 40)
    rows = docs.unionByName(spark.createDataFrame([(800, prose(rng, 20) + " " + item, "en", "s", 0), (801, prose(rng, 40) + " vile vile", "en", "s", 0)], DOCS))
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    exact = cuckoo_dedup.deduplicated(rows)
    want = {r.doc_id for r in decontam.without_contaminated(minhash.without_near_duplicates(exact), spark.read.parquet(f"{tmp_path}/benchmark.parquet")).collect()}
    assert set(out) == want and 800 not in out and 801 in out
    assert [f.name for f in corpus_pipeline.drop_near_copies(spark, rows, str(tmp_path)).schema] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(n.startswith("op") for n in queries.QUERIES)


def test_kneser_ney_sorts_each_order_once(spark, monkeypatch):
    """A chunk of texts is sorted once per order: contexts are the n-grams before and need no sort of their own."""
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["a", "b", "c", "dd"], rng.integers(0, 30))) for _ in range(60)] + ["", " "]
    model = kneser_ney.train(spark.createDataFrame([(t,) for t in texts], "text string"), order=4)
    keyed, real = [], kneser_ney.gram_key
    monkeypatch.setattr(kneser_ney, "gram_key", lambda h: keyed.append(len(h)) or real(h))
    scorer = kneser_ney.Scorer(model)
    whole = scorer.score_all(texts)
    assert keyed == [2, 3, 4]
    alone = np.vstack([scorer.score_all([t]).to_numpy() for t in texts])
    assert np.allclose(whole.to_numpy(), alone, rtol=1e-12) and scorer.score_all([]).empty
