"""Language-model scores from an interpolated modified Kneser-Ney model of n-grams; the order is a parameter, 3 by default.

Counting: each task hashes its tokens, counts n-grams of the order and tokens in sorted runs of up to `RUN_TOKENS`
tokens, and sends each run in pieces, one per shard, as compressed arrays (each word once, and places in the list of words). A shard
merges its pieces. An n-gram's shard follows from its last two words, so that all that lower orders count (the
different words before each shorter n-gram) is in the same shard and needs no shuffle. The shard writes the n-grams of all orders as
sorted hash arrays and sends sums for contexts of one word and continuations to the shards of their words, which write sorted arrays
of words. So frequent words and n-grams reach a shard once per run, and rows of Spark stay few and of similar size. Shards are as many as
spark.sql.shuffle.partitions. The n-grams of a hot word before the last are split over several shards by their last word, so many that none
gets more than about half of a shard's mean; sums of longer contexts are added up when they are looked up. Which words are hot is told by a
sample of about `SAMPLED` texts; it decides where n-grams are counted and not how, so that results don't depend on it.

Scoring: workers map the arrays into memory and look tokens up by binary search, sorted per chunk of texts.
Of a 64-bit hash, an array holds 32 bits; those above follow from its place, as an index of the first bits tells where each range begins. An n-gram that was
not learned is thus taken for another one in about one of 2^32 cases. Rows of ones, the most frequent ones, need no numbers.
The store is a folder below spark.checkpoint.dir. A store that isn't a shared file system is copied
shard by shard to unlinked local files when first touched. The model names the files that were written; one that is missing is an error.

p(w|h) = max(c(hw) - D(c), 0) / c(h.) + g(h) p(w|h'), h' without the first word of h; at the end
p1(w) = max(N(.w) - D', 0) / N(..) + g' / (V + 1). c counts occurrences at the highest order, and different words before at lower
ones. Each order has three discounts D from its counts of counts 1 to 4. A context that was never seen passes p(w|h') on.

Defined results: texts are lower-cased in A-Z and split at blanks; each text, empty and null ones too,
has one end token and a start context of its own (as many start tokens as a context has words); rows with a null id are learned
from; without a training row the model is uniform over one unknown token; repeated rows are learned from as often as they occur.
"""

from __future__ import annotations

import math
import mmap
import os
import struct
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.common import chunks, crc32_id, cut, mix, prepare, shared_folder, text_or_empty, word_hash, word_hashes

ORDER = 3
RUN_TOKENS = 4_000_000
SAMPLED = 2000
SCORED_CHARS = 4_000_000
#: Characters whose words are numbered at once while counting; as checked, apart from the lots of other operators.
COUNTED_CHARS = 1_500_000
END, START = np.uint64(word_hash(b"\0end")), np.uint64(word_hash(b"\0start"))


def tokens_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, and the number of tokens of each text."""
    words, lens = [], []
    for t in texts:
        w = t.encode("utf-8", "surrogatepass").lower().split()
        words += w
        lens.append(len(w) + 1)
    n = np.array(lens, np.int64)
    ends = np.cumsum(n) - 1
    w = np.empty(int(n.sum()), np.uint64)
    inner = np.ones(len(w), bool)
    inner[ends] = False
    w[inner], w[ends] = word_hashes(words), END
    return w, n


def shifted(w: np.ndarray, n: np.ndarray, start) -> np.ndarray:
    """Of each token what stands before it, start where a text of n tokens begins."""
    u = np.empty_like(w)
    u[1:] = w[:-1]
    u[np.cumsum(n) - n] = start
    return u


def histories(w: np.ndarray, n: np.ndarray, order: int, start=START) -> list[np.ndarray]:
    """The tokens, those before them, those two before and so on."""
    h = [w]
    for _ in range(order - 1):
        h.append(shifted(h[-1], n, start))
    return h


def sorted_runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the keys, in which equal ones come as they like (a stable sort takes some times longer), and where in it each new key is."""
    order = np.argsort(key)
    own = key[order]
    new = np.ones(len(key), bool)
    new[1:] = own[1:] != own[:-1]
    return order, new


def distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, ascending, a place of each, and of each place the number of its key."""
    order, new = sorted_runs(key)
    at = np.empty(len(key), np.int64)
    at[order] = np.cumsum(new) - 1
    first = order[new]
    return key[first], first, at


def gram_key(h: list[np.ndarray]) -> np.ndarray:
    """Hash of n-grams; h has their words, the last ones first."""
    key = h[0]
    for u in h[1:]:
        key = mix(u * np.uint64(0x9E3779B97F4A7C15) + key)
    return key


def shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    """Equal ranges of the hash, in order."""
    return ((key >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


class Layout:
    """Which shard n-grams belong to: hot words before the last have several, one after the other."""

    def __init__(self, shards: int, hot: dict[int, int]):
        self.shards = shards
        self.hot = np.array(sorted(hot), np.uint64)
        self.parts = np.array([hot[k] for k in sorted(hot)], np.int64)

    def spread(self, u: np.ndarray) -> np.ndarray:
        """In how many shards n-grams are that have u before the last word."""
        if not len(self.hot):
            return np.ones(len(u), np.int64)
        at = np.minimum(np.searchsorted(self.hot, u), len(self.hot) - 1)
        return np.where(self.hot[at] == u, self.parts[at], 1)

    def shard(self, u: np.ndarray, part: np.ndarray | int) -> np.ndarray:
        return (shard_of(mix(u), self.shards) + part) % self.shards

    def gram(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Of n-grams that end in u, w."""
        return self.shard(u, (w % self.spread(u).astype(np.uint64)).astype(np.int64))


def narrow(a: np.ndarray) -> np.ndarray:
    """The same numbers in the smallest unsigned type that holds them."""
    most = int(a.max(initial=0))
    return a.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)


def summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, ascending, with the sums of their values."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return (key[first], *(np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values))


def _arrays(buffer, at: int = 0) -> dict[str, np.ndarray]:
    """The arrays of a shard's file, as views of the buffer."""
    size = struct.unpack_from("<I", buffer, at)[0]
    out, at = {}, at + 4 + size
    for line in bytes(buffer[at - size : at]).decode().split():
        name, dtype, *shape = line.split(":")
        shape = tuple(map(int, shape))
        out[name] = np.ndarray(shape, dtype, buffer, at)
        at += -(-out[name].nbytes // 8) * 8
    return out


def _file(arrays: dict[str, np.ndarray]) -> bytes:
    head = " ".join(":".join([n, a.dtype.str, *map(str, a.shape)]) for n, a in arrays.items()).encode()
    head += b" " * (-(len(head) + 4) % 8)
    return struct.pack("<I", len(head)) + head + b"".join(a.tobytes() + bytes(-a.nbytes % 8) for a in arrays.values())


def mapped(path: str) -> dict[str, np.ndarray]:
    """A shard's arrays, mapped without holding a file open: workers map many."""
    with open(path, "rb") as f:
        return _arrays(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False))


PER_RANGE = 16


def ranged(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending hashes as 32 bits each, and where the range of each of their first bits begins."""
    bits = max(0, (len(key) // PER_RANGE).bit_length())
    top = key >> np.uint64(64 - bits) if bits else np.zeros(len(key), np.uint64)
    return (key << np.uint64(bits) >> np.uint64(32)).astype(np.uint32), np.searchsorted(top, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.uint32)


def places_of(key: np.ndarray, low: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Where `ranged` hashes hold the keys; -1 where they don't."""
    bits = (len(index) - 1).bit_length() - 1
    top = (key >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)
    want, a, b = (key << np.uint64(bits) >> np.uint64(32)).astype(np.uint32), index[top].astype(np.int64), index[top + 1].astype(np.int64)
    if not len(low):
        return np.full(len(key), -1)
    for bit in reversed(range(int((b - a).max(initial=0)).bit_length())):
        then = a + (1 << bit)
        a = np.where((then <= b) & (low.take(then - 1, mode="clip") < want), then, a)
    return np.where((a < b) & (low.take(a, mode="clip") == want), a, -1)


def tabled(kind: str, key: np.ndarray, rows: np.ndarray, ones: list[int]) -> dict[str, np.ndarray]:
    """Arrays of a table: keys whose row is `ones`, and the other keys with their rows."""
    plain = (rows == ones).all(1)
    low, index = ranged(key[plain])
    rest, rest_index = ranged(key[~plain])
    return {f"{kind}-ones": low, f"{kind}-ones-index": index, f"{kind}-rest": rest, f"{kind}-rest-index": rest_index, f"{kind}-rows": narrow(rows[~plain])}


ONES = {"gram": [1], "context": [1, 1, 0, 0], "word": [1, 1, 1, 1, 0, 0]}


class Store:
    """Arrays in files of a shared folder."""

    def __init__(self, folder: str):
        self.folder = folder
        scheme, _, rest = folder.partition(":")
        self.local = "/" + rest.lstrip("/") if scheme == "file" else folder if "://" not in folder else None

    def write(self, name: str, arrays: dict[str, np.ndarray]) -> str:
        """Replaces the file at once, so that a retried task leaves a whole one."""
        if self.local:
            os.makedirs(self.local, exist_ok=True)
            draft = f"{self.local}/.{name}-{uuid.uuid4().hex}"
            with open(draft, "wb") as f:
                f.write(_file(arrays))
            os.replace(draft, f"{self.local}/{name}")
        else:
            from pyarrow import fs

            system, top = fs.FileSystem.from_uri(self.folder)
            system.create_dir(top, recursive=True)
            with system.open_output_stream(draft := f"{top}/.{name}-{uuid.uuid4().hex}") as f:
                f.write(_file(arrays))
            system.move(draft, f"{top}/{name}")
        return name

    def map(self, name: str) -> dict[str, np.ndarray]:
        if self.local:
            return mapped(f"{self.local}/{name}")
        from pyarrow import fs

        system, top = fs.FileSystem.from_uri(self.folder)
        with system.open_input_stream(f"{top}/{name}") as f, tempfile.NamedTemporaryFile() as copy:
            while block := f.read(1 << 22):
                copy.write(block)
            copy.flush()
            return mapped(copy.name)  # the mapping outlives the name


PIECES = "kind string, shard int, key binary, more binary, n binary"


def _packed(a: np.ndarray) -> bytes:
    """A type's width and the numbers, compressed."""
    a = narrow(a)
    return zstandard.compress(bytes([a.itemsize]) + a.tobytes(), 1)


def _numbers(b: bytes) -> np.ndarray:
    b = zstandard.decompress(b)
    return np.frombuffer(b, f"u{b[0]}", offset=1).astype(np.int64)


def _unpacked(column: pd.Series) -> np.ndarray:
    return np.concatenate([_numbers(b) for b in column]) if len(column) else np.zeros(0, np.int64)


def _packed_keys(key: np.ndarray) -> bytes:
    """Ascending hashes as steps, all first bytes of these, all second ones and so on, compressed."""
    steps = np.diff(key, prepend=np.uint64(0))
    return zstandard.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _keys(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(b), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _pieces(kind: str, key: np.ndarray, n: np.ndarray, shards: int) -> pd.DataFrame:
    """One row per shard of words; key is ascending, n has a number or a row of numbers for each."""
    at = np.searchsorted(shard_of(key, shards), np.arange(shards + 1))
    rows = [(kind, s, _packed_keys(key[a:b]), b"", _packed(n[a:b].ravel())) for s, (a, b) in enumerate(zip(at[:-1], at[1:])) if a < b]
    return pd.DataFrame(rows, columns=["kind", "shard", "key", "more", "n"])


def _gram_pieces(at: np.ndarray, n: np.ndarray, words: np.ndarray, layout: Layout) -> pd.DataFrame:
    """One row per shard of n-grams: key has the words in them; more the places in key of all last words, of all words before (ascending, as steps) and so on. words has all of them, ascending, at their places in it, the last words first."""
    shard = layout.gram(words[at[1]], words[at[0]])
    order = np.lexsort((at[0], at[1], shard))
    at, n, shard = at[:, order], n[order], shard[order]
    begin = np.searchsorted(shard, np.arange(layout.shards + 1)).tolist()
    rows, place = [], np.zeros(len(words), np.int64)
    for s, (a, b) in enumerate(zip(begin[:-1], begin[1:])):
        if a < b:
            own = np.zeros(len(words), bool)
            own[at[:, a:b]] = True
            own = np.flatnonzero(own)
            place[own] = np.arange(len(own))
            spots = [place[x[a:b]] for x in at]
            spots[1] = np.diff(spots[1], prepend=0)
            parts = [_packed(x) for x in spots]
            rows.append(("gram", s, _packed_keys(words[own]), b"".join(struct.pack("<I", len(x)) + x for x in parts), _packed(n[a:b])))
    return pd.DataFrame(rows, columns=["kind", "shard", "key", "more", "n"])


def _grams(x: pd.DataFrame, order: int) -> list[np.ndarray]:
    columns: list[list[np.ndarray]] = [[] for _ in range(order)]
    for key, more in zip(x.key, x.more):
        words, at = _keys(key), 0
        for k, column in enumerate(columns):
            size = struct.unpack_from("<I", more, at)[0]
            spots = _numbers(more[at + 4 : at + 4 + size])
            column.append(words[np.cumsum(spots) if k == 1 else spots])
            at += 4 + size
    return [np.concatenate(c) for c in columns]


def _joined(column: pd.Series) -> np.ndarray:
    return np.concatenate([_keys(b) for b in column]) if len(column) else np.zeros(0, np.uint64)


def _runs(layout: Layout, order: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pd.DataFrame]:
            w, n = (np.concatenate(c) for c in zip(*held))
            held.clear()
            words, _, at = distinct(np.append(w, START))
            count = np.bincount(at[:-1], minlength=len(words))
            yield _pieces("word", words[count > 0], count[count > 0], layout.shards)
            h = histories(at[:-1].astype(np.int32), n, order, at[-1])
            sort, new = sorted_runs(gram_key([words[c] for c in h]))
            count = np.diff(np.flatnonzero(new), append=len(new))
            yield _gram_pieces(np.array([c[sort[new]] for c in h]), count, words, layout)

        for x in batches:
            for _, part in chunks(x.text.tolist(), COUNTED_CHARS):
                held.append(tokens_of(part))
                if sum(len(w) for w, _ in held) >= RUN_TOKENS:
                    yield from flush()
        if held:
            yield from flush()

    return run


def hot_words(texts: DataFrame, shards: int) -> dict[int, int]:
    """Words that hold over half of a shard's mean of a sample, and over how many shards to split what ends in them and another; at most 2 * shards."""
    n = texts.count()

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            word, count = np.unique(tokens_of(x.text.tolist())[0], return_counts=True)
            yield pd.DataFrame({"word": word.view(np.int64), "n": count})

    words = cut(texts.sample(min(1.0, SAMPLED / max(n, 1)), 5).mapInPandas(counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    mean = (words.agg(F.sum("n")).first()[0] or 0) / (2 * shards)
    return {r.word % 2**64: min(shards, math.ceil(r.n / mean)) for r in words.filter(F.col("n") > mean).collect()}


SUMS = "kind string, shard int, key binary, more binary, n binary"


def _merge_runs(shards: int, folder: str, order: int):
    """N-grams: writes the shard, sends sums by context and by word. Words: sends their counts on."""

    def merge(x: pd.DataFrame) -> pd.DataFrame:
        kind, shard = x.kind.iloc[0], int(x.shard.iloc[0])
        n = _unpacked(x.n)
        if kind == "word":
            return _pieces("count", *summed(_joined(x.key), n), shards)
        h, arrays, stat = _grams(x, order), {}, np.zeros(3 + 4 * order)
        for k in range(order, 1, -1):
            key, first, at = distinct(gram_key(h))
            n = np.bincount(at, n, len(key)).astype(np.int64)
            h = [c[first] for c in h]
            arrays |= tabled(f"gram{k}", key, n[:, None], ONES["gram"])
            context = summed(gram_key(h[1:]), n, (n == 1).astype(np.int64), (n == 2).astype(np.int64), (n > 2).astype(np.int64))
            stat[_counts_at(k)] = [(n == j).sum() for j in (1, 2, 3, 4)]
            if k > 2:
                arrays |= tabled(f"context{k}", context[0], np.column_stack(context[1:]), ONES["context"])
                h, n = h[:-1], np.ones(len(key), np.int64)
        follows = summed(h[0], np.ones(len(key), np.int64))
        name = Store(folder).write(f"grams-{shard:06d}", arrays)
        top = pd.DataFrame([("stat", -1, b"", name.encode(), stat.tobytes())], columns=["kind", "shard", "key", "more", "n"])
        return pd.concat([_pieces("context", context[0], np.column_stack(context[1:]), shards), _pieces("follows", *follows, shards), top], ignore_index=True)

    return merge


def _counts_at(k: int) -> slice:
    """Where the counts of counts of order k are in the sums; those of order 1 are after those of order 2."""
    at = {2: 3, 1: 7}.get(k, 4 * k - 1)
    return slice(at, at + 4)


def _merge_words(shards: int, folder: str, order: int):
    """Writes a shard of words: count, continuations, context total, followers seen once, twice, more often."""

    def merge(x: pd.DataFrame) -> pd.DataFrame:
        shard = int(x.shard.iloc[0])
        if shard < 0:
            return pd.DataFrame({"values": [np.frombuffer(b, np.float64).tolist() for b in x.n], "file": [b.decode() for b in x.more]})
        keys, rows = [], []
        for kind, at, width in (("count", 0, 1), ("follows", 1, 1), ("context", 2, 4)):
            own = x[x.kind == kind]
            k = _joined(own.key)
            r = np.zeros((len(k), 6), np.int64)
            r[:, at : at + width] = _unpacked(own.n).reshape(-1, width)
            keys.append(k), rows.append(r)
        key, *columns = summed(np.concatenate(keys), *np.concatenate(rows).T)
        table = np.column_stack(columns) if columns else np.zeros((0, 6), np.int64)
        name = Store(folder).write(f"words-{shard:06d}", tabled("word", key, table, ONES["word"]))
        c, follows = table[:, 0], table[:, 1]
        return pd.DataFrame({"values": [[float(c.sum()), float((c > 0).sum()), float(follows.sum()), 0, 0, 0, 0, *(float((follows == k).sum()) for k in (1, 2, 3, 4)), *[0.0] * (4 * order - 8)]], "file": [name]})

    return merge


def discounts(n: list[float]) -> list[float]:
    """For counts 1, 2 and 3 or more. Where a count of counts is 0 (tiny tables) a fixed one stands in; none is below 0.05."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    raw = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] and n[k] else 0.5 * k for k in (1, 2, 3)]
    return [min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1)]


class Model:
    """What scoring needs: the store's folder, the names of its files (two per shard at most) and a few numbers."""

    def __init__(self, folder: str, layout: Layout, values: list[float], order: int, files: list[str]):
        self.folder, self.layout, self.shards, self.order, self.files = folder, layout, layout.shards, order, set(files)
        self.tokens, self.types, self.pairs = (int(v) for v in values[:3])
        self.gram_d = {k: discounts(values[_counts_at(k)]) for k in range(2, order + 1)}
        self.word_d = discounts(values[_counts_at(1)])
        n1, n2 = values[7], values[8]
        self.left = sum(d * n for d, n in zip(self.word_d, (n1, n2, self.types - n1 - n2))) / self.pairs if self.pairs else 1.0


def train(docs: DataFrame, text_col: str = "text", order: int = ORDER) -> Model:
    """Counts all rows of docs; only a few sums come to the driver."""
    if order < 2:
        raise ValueError("the order is 2 at least")
    spark: SparkSession = docs.sparkSession
    prepare(spark)
    shards, folder = int(spark.conf.get("spark.sql.shuffle.partitions")), shared_folder(spark, "kneser-ney")
    texts = docs.select(text_or_empty(docs[text_col]).alias("text"))
    layout = Layout(shards, hot_words(texts, shards))
    runs = texts.mapInPandas(_runs(layout, order), PIECES)
    sums = runs.groupBy("kind", "shard").applyInPandas(_merge_runs(shards, folder, order), SUMS)
    stats = sums.groupBy("shard").applyInPandas(_merge_words(shards, folder, order), "values array<double>, file string")
    row = stats.agg(F.collect_set("file").alias("files"), *(F.sum(F.col("values")[i]).alias(f"v{i}") for i in range(3 + 4 * order))).first()
    return Model(folder, layout, [row[f"v{i}"] or 0.0 for i in range(3 + 4 * order)], order, row.files)


class Scorer:
    def __init__(self, model: Model):
        self.model, self.store = model, Store(model.folder)
        self._open = lru_cache(maxsize=None)(self.store.map)

    def look_up(self, kind: str, key: np.ndarray, shard: np.ndarray, width: int) -> np.ndarray:
        """Rows of ascending distinct keys in their shards; zeros where there is none."""
        out = np.zeros((len(key), width), np.int64)
        shard = narrow(shard)  # up to 16 bits are sorted by counting
        order = np.argsort(shard, kind="stable")
        at = np.searchsorted(shard[order], np.arange(self.model.shards + 1)).tolist()
        for s in range(self.model.shards):
            mine = order[at[s] : at[s + 1]]
            name = f"{'words' if kind == 'word' else 'grams'}-{s:06d}"
            if len(mine) and name in self.model.files:  # other shards got no key
                table = self._open(name)
                spot = places_of(key[mine], table[f"{kind}-rest"], table[f"{kind}-rest-index"])
                out[mine[spot >= 0]] = table[f"{kind}-rows"][spot[spot >= 0]]
                mine = mine[spot < 0]
                spot = places_of(key[mine], table[f"{kind}-ones"], table[f"{kind}-ones-index"])
                out[mine[spot >= 0]] = ONES[kind.rstrip("0123456789")]
        return out

    def contexts(self, k: int, key: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Total and followers seen once, twice and more often, of contexts of more than one word, by their hashes and last words."""
        layout = self.model.layout
        spread, out = layout.spread(last), np.zeros((len(key), 4), np.int64)
        for part in range(int(spread.max(initial=0))):
            some = np.flatnonzero(spread > part)
            out[some] += self.look_up(f"context{k}", key[some], layout.shard(last[some], part), 4)
        return out

    def score_all(self, texts: list[str]) -> pd.DataFrame:
        """All numbers that follow from a word, an n-gram or a context are made once for each distinct one. A context is the n-gram before, so that it needs no sort
        of its own; one of start tokens alone is put behind all others for that."""
        m = self.model
        w, lens = tokens_of(texts)
        h = [np.append(c, START) for c in histories(w, lens, m.order)]
        words, _, at = distinct(h[0])
        table = self.look_up("word", words, shard_of(words, m.shards), 6)
        word_d, own = np.array([0, *m.word_d]), at[:-1]
        p = (np.maximum(table[:, 1] - word_d[np.minimum(table[:, 1], 3)], 0) / max(1, m.pairs) + m.left / (m.types + 1))[own]
        base, known = np.log10((table[:, 0] + 0.5) / (m.tokens + 0.5 * (m.types + 1)))[own], (table[:, 0] > 0)[own].astype(np.int64)
        context = table[:, 2:6]
        for k in range(2, m.order + 1):
            before = shifted(at[:-1], lens, at[-1])
            grams, first, at = distinct(gram_key(h[:k]))
            last = h[0][first]
            c = self.look_up(f"gram{k}", grams, m.layout.gram(h[1][first], last), 1)[:, 0]
            d, total = np.array([0, *m.gram_d[k]]), context[:, 0]
            some = np.maximum(total, 1)
            rest, total, some = (context[:, 1:] @ d[1:] / some)[before], total[before], some[before]
            p = np.where(total > 0, np.maximum(c - d[np.minimum(c, 3)], 0)[at[:-1]] / some + rest * p, p)
            if k < m.order:
                context = self.contexts(k + 1, grams, last)
        first = np.cumsum(lens) - lens
        total_of = lambda v: np.add.reduceat(v, first) if len(first) else v[:0]
        return pd.DataFrame({"n_tokens": lens, "n_known": total_of(known), "base_score": total_of(base), "score": total_of(np.log10(p))})


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "lm") -> DataFrame:
    """Adds a struct: n_tokens, n_known, base_score, score (log10), perplexity."""
    prepare(docs.sparkSession)

    @F.pandas_udf("n_tokens long, n_known long, base_score double, score double, perplexity double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for batch in batches:
            x = pd.concat([scorer.score_all(part) for _, part in chunks(batch.tolist(), SCORED_CHARS)], ignore_index=True) if len(batch) else scorer.score_all([])
            yield x.assign(perplexity=10 ** np.minimum(-x.score / np.maximum(x.n_tokens, 1), 300))

    return docs.withColumn(out_col, scored(text_or_empty(docs[text_col])))


def language_model_scores(docs: DataFrame, order: int = 2) -> DataFrame:
    """Learns from documents whose crc32 of the id as text, mod 5, is not 1; scores all. The query op7 asks for ORDER."""
    held = F.coalesce(crc32_id(F.col("doc_id")) % 5 == 1, F.lit(False))
    rows = docs.select("doc_id", "text")
    model = train(rows.filter(~held), order=order)
    x = score(rows, model)
    return x.select("doc_id", held.alias("held_out"), "lm.n_tokens", "lm.n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "lm.base_score", "lm.score", "lm.perplexity")
