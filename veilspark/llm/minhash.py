"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

Shingles are five consecutive lower-cased words (a shorter text is one shingle). A shingle weighs its
count times the mean inverse document frequency of its words, idf = 1 + ln((1 + documents) / (1 + documents with the word)).
Frequencies are counted over all documents in a sketch of 2^20 hashed words, so that what goes to the driver and the
workers is at most 2^20 numbers; words that share a place share its count.

1. Each text gives 30 samples, in 10 bands of 3. A sample is the smallest ln a over the text's shingles in
   improved consistent weighted sampling, with r, c ~ Gamma(2, 1) and beta ~ U(0, 1) drawn by the shingle's hash
   from pools of 65,536 values. Two texts of weighted Jaccard similarity 0.8 share a band with probability 0.9992.
2. Texts of equal words are one node. Nodes that share a band are a bucket. A bucket's most connected node
   leads it; every other node is compared with its leaders (a star, not all pairs).
3. A link inside a bucket that its leader can't show is still looked for, among the nodes of buckets that hold several
   components after that. Of each text the shingles that no other component has come first in one order of all shingles, then
   rare ones before frequent ones. Two linked texts x, y of weights X, Y overlap in at least s / (1 + s) (X + Y), so that before the first
   shingle they share, the two of them hold at most (1 - s) / (1 + s) (X + Y) together, and neither more than leaves room for the
   overlap. Per shingle the smallest such sums of two components tell which texts can have a partner there at all; the rest
   drops out. Rounds follow: each text left is compared with the one partner most of its shingles name, linked components
   become one, and more shingles belong to one component only. When a round links few, all pairs still possible under these bounds
   are compared. No link between texts that share a bucket is lost, and what is compared stays near the number of texts.
4. Linked nodes form components (large-star and small-star rounds), and a component's class id is its smallest id.

Defined results: texts without a word (null and empty ones too) are classes of their own; repeated rows share a
class, count twice in class_size and are kept or go together; of several texts of a class under its smallest id one is kept;
ids that are null are larger than others, and where all ids of a class are null so is class_id; an empty table
gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import chunks, cut, mix, prepare, text_or_empty, word_hashes

WORDS = 5
SIMILAR = 0.8
BANDS, ROWS = 10, 3
POOL_BITS = 16
SKETCH_BITS = 20
#: Rounds of single comparisons go on while they link this share of the texts that are left.
WORTH = 0.05
#: Links that one task joins in memory, about 100 MB.
LINKS_A_TASK = 200_000
#: Counts in an Arrow batch.
FEW = 1 << 14
#: Texts with their shingles in a partition, where there are few.
TEXTS_A_TASK = 1000

#: Every ASCII byte but letters and digits ends a word.
FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(FOLD).split()


def digest_of(words: list[bytes]) -> bytes | None:
    return xxhash.xxh3_128_digest(b" ".join(words)) if words else None


def bucket_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


class IdfTable:
    """idf by bucket of the sketch, 2 MB to send; `dense` gives the array to work with."""

    def __init__(self, idf: np.ndarray):
        self.idf = idf.astype(np.float16)

    def dense(self) -> np.ndarray:
        return self.idf.astype(np.float32)


# ---- document frequencies ---------------------------------------------------------------------------


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, docs = np.zeros(1 << SKETCH_BITS, np.int64), 0
    for b in batches:
        for _, part in chunks(b.column("text").to_pylist()):
            words, lens = [], []
            for t in part:
                w = words_of(t)
                words += w
                lens.append(len(w))
            doc = np.repeat(np.arange(len(part)), lens)
            seen = np.unique(doc << SKETCH_BITS | bucket_of(word_hashes(words)))
            n += np.bincount(seen & ((1 << SKETCH_BITS) - 1), minlength=1 << SKETCH_BITS)
            docs += sum(x > 0 for x in lens)
    some = np.flatnonzero(n)
    bucket, n = np.append(some, -1).astype(np.int32), np.append(n[some], docs)
    for i in range(0, len(bucket), FEW):
        yield pa.RecordBatch.from_arrays([pa.array(bucket[i : i + FEW]), pa.array(n[i : i + FEW])], names=["bucket", "n"])


def idf_table(docs: DataFrame) -> IdfTable:
    """idf of every bucket of the sketch; at most 2^20 counts come to the driver."""
    counts = docs.select("text").mapInArrow(_frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    bucket, n = counts.column("bucket").to_numpy(), counts.column("n").to_numpy().astype(np.float64)
    total, seen, df = n[bucket < 0].sum(), bucket >= 0, np.zeros(1 << SKETCH_BITS)
    df[bucket[seen]] = n[seen]
    return IdfTable(1 + np.log((1 + total) / (1 + df)))


# ---- shingles and samples ---------------------------------------------------------------------------


def shingles(words: list[bytes], hashes: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a text, ascending, and their weights."""
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.float32)
    w = idf[bucket_of(hashes)]
    if len(words) < WORDS:
        hashes = np.concatenate([hashes, np.zeros(WORDS - len(words), np.uint64)])
        w = np.full(WORDS, w.mean(), np.float32)
    n = len(hashes) - WORDS + 1
    h, weight = np.zeros(n, np.uint64), np.zeros(n, np.float32)
    for j in range(WORDS):
        h = h * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n]
        weight += w[j : j + n]
    h = mix(h)
    weight = np.round(weight * np.float32(64 / WORDS)) / np.float32(64)
    order = np.argsort(h, kind="stable")
    h, weight = h[order], weight[order]
    first = np.concatenate([[True], h[1:] != h[:-1]])
    if first.all():
        return h, weight
    at = np.flatnonzero(first)
    return h[at], np.add.reduceat(weight, at)


class Sampler:
    """Improved consistent weighted sampling; equal shingles of equal weight get equal draws everywhere."""

    def __init__(self, seed: int = 7):
        pool = np.random.default_rng(seed)
        r, c = (pool.gamma(2, 1, 1 << POOL_BITS) for _ in (0, 1))
        self.r, self.log_c, self.beta = r.astype(np.float32), np.log(c).astype(np.float32), pool.random(1 << POOL_BITS).astype(np.float32)
        self.inverse = (1 / self.r).astype(np.float32)
        # ln a = ln c - r (t - beta) - r = (ln c) - r t + (r beta - r)
        self.shift = (self.r * self.beta - self.r).astype(np.float32)
        self.keys = pool.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def bands(self, h: np.ndarray, weight: np.ndarray, first: np.ndarray) -> np.ndarray:
        """For texts whose shingles begin at `first`: one hash per band."""
        log_s = (np.round(np.log(weight.astype(np.float64)) * 1024) / 1024).astype(np.float32)
        low, out = np.uint64((1 << POOL_BITS) - 1), np.zeros((len(first), BANDS), np.uint64)
        for k, key in enumerate(self.keys):
            z = h * key
            i = (z >> np.uint64(64 - POOL_BITS)).astype(np.int32)
            j = ((z >> np.uint64(24)) & low).astype(np.int32)
            t = np.floor(log_s * self.inverse[i] + self.beta[i])
            log_a = self.log_c[j] - self.r[i] * t + self.shift[i]
            least = np.minimum.reduceat(log_a, first).view(np.uint32).astype(np.uint64)
            band = k // ROWS
            out[:, band] = out[:, band] * np.uint64(0x9E3779B97F4A7C15) + least + np.uint64(band + 1)
        return mix(out)


def _signed(table: IdfTable):
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, idf = Sampler(), table.dense()
        for b in batches:
            ids, texts = b.column("doc_id"), b.column("text").to_pylist()
            digests, rows = [], []
            for _, part in chunks(texts):
                features, which = [], []
                for i, t in enumerate(part):
                    words = words_of(t)
                    digests.append(digest_of(words))
                    rows.append(None)
                    if words:
                        features.append(shingles(words, word_hashes(words), idf))
                        which.append(len(rows) - 1)
                if features:
                    first = np.cumsum([0, *(len(h) for h, _ in features[:-1])])
                    made = sampler.bands(np.concatenate([h for h, _ in features]), np.concatenate([w for _, w in features]), first)
                    for i, x in zip(which, made.view(np.int64).tolist()):
                        rows[i] = x
            yield pa.RecordBatch.from_arrays([ids, b.column("row_key"), pa.array(digests, pa.binary()), pa.array(rows, pa.list_(pa.int64()))], names=["doc_id", "row_key", "node", "bands"])

    return signed


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two texts' shingles."""
    at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    hit = a[0][at] == b[0]
    both = float(np.minimum(a[1][at[hit]], b[1][hit]).sum(dtype=np.float64))
    return both / (float(a[1].sum(dtype=np.float64)) + float(b[1].sum(dtype=np.float64)) - both)


def _compared(table: IdfTable):
    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = table.dense()
        recent: OrderedDict[bytes, tuple[np.ndarray, np.ndarray]] = OrderedDict()

        def features(node: bytes, text: str) -> tuple[np.ndarray, np.ndarray]:
            x = recent.pop(node, None)
            if x is None:
                words = words_of(text)
                x = shingles(words, word_hashes(words), idf)
            recent[node] = x
            if len(recent) > 200:
                recent.popitem(last=False)
            return x

        for b in batches:
            one, two = b.column("a").to_pylist(), b.column("b").to_pylist()
            sims = [similarity(features(y, t), features(x, s)) for x, y, s, t in zip(one, two, b.column("text_a").to_pylist(), b.column("text_b").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(sims, pa.float64())], names=["a", "b", "similarity"])

    return compared


# ---- links that leaders can't show ----------------------------------------------------------------------


def _featured(table: IdfTable):
    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = table.dense()
        for b in batches:
            hs, ws, totals = [], [], []
            for t in b.column("text").to_pylist():
                words = words_of(t)
                h, w = shingles(words, word_hashes(words), idf)
                hs.append(h.view(np.int64))
                ws.append(w)
                totals.append(float(w.sum(dtype=np.float64)))
            yield pa.RecordBatch.from_arrays([b.column("component"), pa.array(totals, pa.float64()), pa.array(hs, pa.list_(pa.int64())), pa.array(ws, pa.list_(pa.float32()))], names=["component", "total", "h", "w"])

    return featured


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    """The rows of a column of lists without copies."""
    values, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[i:j] for i, j in zip(at[:-1], at[1:])]


def prefix(h: np.ndarray, weight: np.ndarray, shared: np.ndarray, count: np.ndarray, similar: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the shingles h of a text those among `shared` (with their counts), rare ones first, as long as at most the share 1 - `similar`
    of its weight comes before; and the weight before each. Shingles that aren't shared come before all others."""
    by = np.argsort(h, kind="stable")
    own = weight[by][np.searchsorted(h[by], shared)].astype(np.float64)
    total = weight.sum(dtype=np.float64)
    order = np.lexsort((shared, count))
    before = np.concatenate([[0.0], np.cumsum(own[order])[:-1]]) + (total - own.sum())
    k = int(np.searchsorted(before, (1 - similar + 1e-6) * total, "right"))
    return shared[order[:k]], before[:k]


def _prefixed(similar: float):
    def prefixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hs, befores = [], []
            for h, w, s, n in zip(*(_lists(b.column(c)) for c in ("h", "w", "shared", "counts"))):
                x, y = prefix(h, w, s, n, similar)
                hs.append(x)
                befores.append(y)
            yield pa.RecordBatch.from_arrays([b.column("nid"), b.column("cid"), b.column("total"), pa.array(hs, pa.list_(pa.int64())), pa.array(befores, pa.list_(pa.float64()))], names=["nid", "cid", "total", "hs", "befores"])

    return prefixed


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ha, wa, hb, wb = (_lists(b.column(c)) for c in ("h_a", "w_a", "h_b", "w_b"))
        sims = [similarity((p.view(np.uint64), q), (r.view(np.uint64), s)) for p, q, r, s in zip(ha, wa, hb, wb)]
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(sims, pa.float64())], names=["a", "b", "similarity"])


def _possible(rest: DataFrame, similar: float) -> DataFrame:
    """rest: nid, cid, total, h, w. For each text and each shingle of its prefix where a text of another component may link with it: nid, cid, total,
    h, before, slack, and mate: the text there with most room (slack, nid, cid)."""
    each = rest.select("nid", "cid", F.explode("h").alias("h"))
    common = each.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("cid").alias("x"), F.max("cid").alias("y")).filter("x <> y").select("h", "n")
    shared = each.select("nid", "h").join(common, "h").groupBy("nid").agg(F.collect_list(F.struct("h", "n")).alias("s")).select("nid", F.col("s.h").alias("shared"), F.col("s.n").alias("counts"))
    held = rest.join(shared, "nid").mapInArrow(_prefixed(similar), "nid long, cid long, total double, hs array<long>, befores array<double>")
    entry = held.select("nid", "cid", "total", F.explode(F.arrays_zip("hs", "befores")).alias("e")).select("nid", "cid", "total", F.col("e.hs").alias("h"), F.col("e.befores").alias("before"))
    entry = cut(entry.withColumn("slack", F.col("before") - (1 - similar) / (1 + similar) * F.col("total")))

    best = entry.groupBy("h", "cid").agg(F.min(F.struct("slack", "nid", "cid")).alias("low"), F.min("total").alias("least"))
    first = best.groupBy("h").agg(F.min("low").alias("one"), F.min(F.struct("least", "cid")).alias("small"))
    second = best.join(first, "h").groupBy("h").agg(
        F.first("one").alias("one"), F.first("small").alias("small"),
        F.min(F.when(F.col("cid") != F.col("one.cid"), F.col("low"))).alias("two"),
        F.min(F.when(F.col("cid") != F.col("small.cid"), F.col("least"))).alias("next"),
    ).filter("two IS NOT NULL")
    x = entry.join(second, "h").withColumns({"mate": F.when(F.col("cid") != F.col("one.cid"), F.col("one")).otherwise(F.col("two")), "least": F.when(F.col("cid") != F.col("small.cid"), F.col("small.least")).otherwise(F.col("next"))})
    room = (F.col("total") - F.col("before")) * ((1 + similar) / similar) - F.col("total")
    return x.filter((F.col("slack") + F.col("mate.slack") <= 1e-6 * F.col("total")) & (F.col("least") <= room + 1e-6 * F.col("total"))).select("nid", "cid", "total", "h", "before", "slack", "mate")


def _pairs_left(possible: DataFrame, similar: float) -> DataFrame:
    """All pairs (a, b) of different components that the bounds allow."""
    one, two = (possible.select("h", *(F.col(c).alias(f"{c}_{k}") for c in ("nid", "cid", "total", "before", "slack"))) for k in "ab")
    total, least = F.col("total_a") + F.col("total_b"), similar / (1 + similar)
    fits = (F.col("cid_a") != F.col("cid_b")) & (F.struct("total_a", "nid_a") < F.struct("total_b", "nid_b")) & (F.col("slack_a") + F.col("slack_b") <= 1e-6 * total)
    fits &= F.least(F.col("total_a") - F.col("before_a"), F.col("total_b") - F.col("before_b")) >= (least - 1e-6) * total
    return one.join(two, (one["h"] == two["h"]) & fits).select(F.col("nid_a").alias("a"), F.col("nid_b").alias("b")).distinct()


def packed(texts: DataFrame) -> DataFrame:
    """Few texts in few partitions, so that shuffles of them have few files."""
    return texts.coalesce(-(-texts.count() // TEXTS_A_TASK) or 1)


def links_between(rest: DataFrame, similar: float) -> list[DataFrame]:
    """rest: nid, cid, total, h, w. Links (a, b) between texts (nid) of different components (cid): enough of them to join all components that have any."""

    def verified(pairs: DataFrame) -> DataFrame:
        x = pairs.join(rest.select(F.col("nid").alias("a"), F.col("h").alias("h_a"), F.col("w").alias("w_a")), "a")
        x = x.join(rest.select(F.col("nid").alias("b"), F.col("h").alias("h_b"), F.col("w").alias("w_b")), "b")
        return cut(x.select("a", "b", "h_a", "w_a", "h_b", "w_b").mapInArrow(_verified, "a long, b long, similarity double").filter(F.col("similarity") >= similar - 1e-9).select("a", "b"))

    found = []
    while True:
        rest = packed(rest)
        possible = cut(_possible(rest, similar))
        texts = possible.agg(F.count_distinct("nid")).first()[0]
        if not texts:
            return found
        vote = possible.groupBy("nid", F.col("mate.nid").alias("mate")).agg(F.count(F.lit(1)).alias("n")).groupBy("nid").agg(F.max(F.struct("n", "mate"))["mate"].alias("mate"))
        links = verified(vote.select(F.least("nid", "mate").alias("a"), F.greatest("nid", "mate").alias("b")).distinct())
        n = links.count()
        found += [links] * (n > 0)
        if n < WORTH * texts:
            return [*found, verified(_pairs_left(possible, similar))]
        of = rest.select("nid", "cid")
        joined = links.join(of.toDF("a", "x"), "a").join(of.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        renamed = components(joined).select(F.col("node").alias("cid"), F.col("component").alias("to"))
        rest = cut(rest.join(possible.select("nid").distinct(), "nid").join(renamed, "cid", "left").withColumn("cid", F.coalesce("to", "cid")).drop("to"))


# ---- components -------------------------------------------------------------------------------------


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) of a partition, `LINKS_A_TASK` at a time, as links of each node to the smallest of its tree."""

    def smallest(u: list, v: list, type_: pa.DataType) -> pa.RecordBatch:
        up: dict = {}

        def root(x):
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        for x, y in zip(u, v):
            x, y = root(x), root(y)
            if x != y:
                up[max(x, y)] = min(x, y)
        low = [(x, root(x)) for x in list(up)]
        low = [(x, y) for x, y in low if x != y]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in low], type_), pa.array([y for _, y in low], type_)], names=["u", "v"])

    u, v, type_ = [], [], None
    for b in batches:
        type_ = b.column("u").type
        u += b.column("u").to_pylist()
        v += b.column("v").to_pylist()
        if len(u) >= LINKS_A_TASK:
            yield smallest(u, v, type_)
            u, v = [], []
    if u:
        yield smallest(u, v, type_)


def components(links: DataFrame, share: int = LINKS_A_TASK) -> DataFrame:
    """(node, component) for all nodes of links (a, b); a component is called after its smallest node.

    Each task first joins what its `share` of links joins. Where that is not all, large-star and small-star rounds
    follow until nothing changes. A round is one job, written to the shared folder.
    """
    e = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    mark = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        tasks = -(-now[0] // share)
        if tasks > 1 and tuple(now) != mark:
            mark = tuple(now)
            e = cut(e.coalesce(tasks).mapInArrow(_forest, e.schema))
            both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            e = cut(small.union(least.select("u", F.col("m").alias("v"))).distinct())
            continue
        if tasks == 1:
            e = cut(e.coalesce(1).mapInArrow(_forest, e.schema))
        return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())


# ---- the operator -----------------------------------------------------------------------------------


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """One row per row of docs: doc_id, class_id, class_size, kept, row_key (a hash of id and text)."""
    prepare(docs.sparkSession)
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), text_or_empty(docs[text_col]).alias("text"))
    idf = idf_table(docs)
    docs = docs.withColumn("row_key", _row_key("doc_id", "text"))
    rows = cut(docs.mapInArrow(_signed(idf), "doc_id long, row_key long, node binary, bands array<long>"))
    smallest = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key"))
    nodes = cut(rows.filter("node IS NOT NULL").groupBy("node").agg(smallest.alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands")))

    # buckets of two or more, and their members by how connected they are
    member = nodes.select("node", F.explode("bands").alias("bucket"))
    sizes = cut(member.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"))
    member = member.join(sizes, "bucket")
    rank = member.groupBy("node").agg(F.sum("size").alias("rank"))
    member = cut(member.join(rank, "node").select("bucket", "node", "rank"))

    needed = member.select("node").distinct().join(nodes.select("node", F.col("rep.doc_id").alias("id"), F.col("rep.row_key").alias("row_key")), "node")
    texts = docs.join(needed, (docs["row_key"] == needed["row_key"]) & docs["doc_id"].eqNullSafe(needed["id"])).select(docs["row_key"], "node", "text")
    texts = cut(texts.dropDuplicates(["row_key"]).select("node", "text"))  # repeated rows

    def compare(pairs: DataFrame) -> DataFrame:
        """Links among the pairs."""
        x = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        x = x.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        return cut(x.select("a", "b", "text_a", "text_b").mapInArrow(_compared(idf), "a binary, b binary, similarity double").filter(F.col("similarity") >= similar - 1e-9).select("a", "b"))

    # stars around the best connected nodes
    lead = cut(member.groupBy("bucket").agg(F.max(F.struct("rank", "node"))["node"].alias("leader")))
    pairs = member.join(lead, "bucket").filter("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b"))
    links = compare(pairs.distinct())
    part = cut(components(links))
    # a leader has been compared with all of its bucket; where the others are of one component, nothing is left to do
    state = member.join(lead, "bucket").filter("node <> leader").join(part, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    mixed = state.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("bucket")
    left = state.join(mixed, "bucket").select("node", "component").distinct()
    rest = cut(texts.join(left, "node").select("component", "text").mapInArrow(_featured(idf), "component binary, total double, h array<long>, w array<float>").withColumns({"nid": F.monotonically_increasing_id(), "cid": F.xxhash64("component")}))
    named = nodes.select("node", "rep", "copies").join(part, "node", "left").select("node", "rep", "copies", F.coalesce("component", "node").alias("component"))
    if more := links_between(rest, similar):
        of = rest.select("nid", "component")
        found = reduce(DataFrame.union, more).join(of.toDF("a", "x"), "a").join(of.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        merged = components(found).select(F.col("node").alias("component"), F.col("component").alias("to"))
        named = named.join(merged, "component", "left").withColumn("component", F.coalesce("to", "component")).drop("to")

    classes = named.groupBy("component").agg(F.min("rep").alias("low"), F.sum("copies").alias("class_size")).filter("class_size > 1")
    of_node = cut(named.select("node", "component").join(cut(classes), "component").select("node", "low", "class_size"))
    found = F.col("low").isNotNull()
    return rows.select("doc_id", "node", "row_key").join(of_node, "node", "left").select(
        "doc_id",
        F.when(found, F.col("low.doc_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"),
        F.when(found, F.col("doc_id").eqNullSafe(F.col("low.doc_id")) & (F.col("row_key") == F.col("low.row_key"))).otherwise(F.lit(True)).alias("kept"),
        "row_key",
    )


def _row_key(id_col: str, text_col: str) -> Column:
    """A row's id and text as one hash."""
    return F.xxhash64(id_col, text_col)


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, one text of each class, with their columns. A row goes by its id and its text, so that another
    text under the same id stays; rows that repeat the kept one stay with it."""
    gone = near_duplicates(docs, id_col, text_col).filter(~F.col("kept")).select(F.col("doc_id").alias("__id"), F.col("row_key").alias("__row")).distinct()
    own = docs[id_col].cast("long")
    return docs.join(gone, own.eqNullSafe(gone["__id"]) & (F.xxhash64(own, text_or_empty(docs[text_col])) == gone["__row"]), "left_anti")
