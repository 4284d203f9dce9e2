"""Toxicity severity by cumulative-link ordinal regression.

P(grade > k) = sigmoid(w.x - t_k) with one weight vector w for all ordered thresholds t_1 < t_2 < t_3.
x holds sparse word features: 1 + ln(count) for each word of a fitted vocabulary, and one for the share
of the text's words that are in it. The expected severity is the sum of P(grade > k) over k = 0, 1, 2.

The model is fitted on at most `max_labelled` labelled rows (those with the smallest hashed ids). Copies among these
count once: a row goes if all four of its shingle signatures were seen in a row before. A word enters the vocabulary if
its rows are toxic so much more often than all are
that chance would give less than half a word of that kind among all words (Chernoff bound). Grades are
0 for not toxic, and for toxic rows 1, 2 or 3 by thirds of their share of vocabulary words (1 without any).

Defined results: null texts count as empty; rows without vocabulary words get the severity of the
thresholds alone; labels with null toxic or id are left out, of repeated labels of an id the largest counts;
without toxic labels every severity is 0; repeated rows repeat their result; columns called as the output are replaced, others stay.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import bounded_sample, cut, prepare, text_or_empty, word_hash

MAX_LABELLED = 20_000
MAX_WORDS = 512
GRADES = 3
REJECT_AT = 0.5
WORD = re.compile(r"[^\W\d_]+")


@dataclass
class SeverityModel:
    words: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1))
    cuts: np.ndarray = field(default_factory=lambda: np.full(GRADES, 50.0))

    def above(self, text: str) -> list[float]:
        """P(grade > k) for k = 0, 1, 2."""
        index = self._index()
        words = WORD.findall(text.lower())
        hits = Counter(index[w] for w in words if w in index)
        z = sum(self.weights[i] * (1 + math.log(n)) for i, n in hits.items())
        if hits:
            z += self.weights[-1] * share_feature(sum(hits.values()) / len(words))
        return [1 / (1 + math.exp(-max(-500.0, min(500.0, z - c)))) for c in self.cuts]

    def _index(self) -> dict[str, int]:
        if not hasattr(self, "_at"):
            self._at = {w: i for i, w in enumerate(self.words)}
        return self._at


def share_feature(share: float) -> float:
    return math.log1p(100 * share)


def fit_ordinal(x: np.ndarray, grade: np.ndarray, weight: np.ndarray, l2: float = 1e-3, steps: int = 800, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Weights and cuts of the proportional-odds model by Adam on the weighted log-likelihood."""
    n, d = x.shape
    share = weight / weight.sum()
    w = np.zeros(d)
    rates = np.clip([share[grade > k].sum() for k in range(GRADES)], 1e-3, 1 - 1e-3)
    start = np.log((1 - rates) / rates)
    base, gaps = start[0], np.log(np.maximum(np.diff(start), 0.05))
    params = np.concatenate([w, [base], gaps])
    m, v = np.zeros_like(params), np.zeros_like(params)
    rows = np.arange(n)
    for step in range(1, steps + 1):
        w, base, gaps = params[:d], params[d], params[d + 1 :]
        cuts = base + np.concatenate([[0], np.cumsum(np.exp(gaps))])
        up = 1 / (1 + np.exp(-np.clip((x @ w)[:, None] - cuts, -30, 30)))  # P(grade > k)
        edge = np.concatenate([np.ones((n, 1)), up, np.zeros((n, 1))], axis=1)
        slope = np.concatenate([np.zeros((n, 1)), up * (1 - up), np.zeros((n, 1))], axis=1)
        prob = np.maximum(edge[rows, grade] - edge[rows, grade + 1], 1e-9)
        g_low, g_high = share * slope[rows, grade] / prob, share * slope[rows, grade + 1] / prob
        g_z = g_low - g_high
        g_cut = np.zeros(GRADES)
        np.add.at(g_cut, grade[grade > 0] - 1, -g_low[grade > 0])
        np.add.at(g_cut, grade[grade < GRADES], g_high[grade < GRADES])
        tail = np.cumsum(g_cut[::-1])[::-1]
        grad = np.concatenate([x.T @ g_z - l2 * w, [tail[0]], tail[1:] * np.exp(gaps)])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        params = params + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return params[:d], params[d] + np.concatenate([[0], np.cumsum(np.exp(params[d + 1 :]))])


def signatures(words: list[str]) -> list[int]:
    """Four minima over hashed word trigrams; equal in copies, and seldom all equal in texts that only share a passage."""
    grams = {word_hash(" ".join(words[i : i + 3]).encode()) for i in range(max(1, len(words) - 2))} if words else {0}
    a = np.fromiter(grams, np.uint64, len(grams))
    return [int((a * np.uint64(k)).min() >> np.uint64(1)) for k in (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def fit_severity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED, max_words: int = MAX_WORDS) -> SeverityModel:
    """What reaches the driver is bounded by max_labelled and max_words."""
    prepare(docs.sparkSession)
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(labels["doc_id"].alias("__id")).agg(F.max("toxic").alias("__toxic"))
    sample = bounded_sample(known, F.col("__id"), max_labelled)
    rows = docs.select(docs[id_col].alias("__id"), text_or_empty(docs[text_col]).alias("__text")).join(F.broadcast(sample), "__id")  # at most max_labelled rows of 16 bytes

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 200):
                x = batch.iloc[at : at + 200]
                words = [WORD.findall(t.lower()) for t in x["__text"]]
                counts = [Counter(w) for w in words]
                yield pd.DataFrame({
                    "id": x["__id"].to_numpy(), "toxic": x["__toxic"].to_numpy("int32"), "marks": [signatures(w) for w in words], "total": [len(w) for w in words],
                    "words": [list(c) for c in counts], "counts": [list(c.values()) for c in counts],
                })

    table = rows.mapInPandas(counted, "id long, toxic int, marks array<long>, total long, words array<string>, counts array<long>")
    table = cut(table.withColumn("row", F.monotonically_increasing_id()))  # fixed by the checkpoint
    seen: set[tuple[int, ...]] = set()
    kept, n_toxic = [], 0
    for r in sorted(table.select("row", "id", "toxic", "marks").collect(), key=lambda r: (r.id, -r.toxic, r.marks)):
        if tuple(r.marks) not in seen:
            kept.append(r.row)
            n_toxic += r.toxic > 0
            seen.add(tuple(r.marks))
    if not n_toxic or n_toxic == len(kept):
        return SeverityModel()
    keep = table.sparkSession.createDataFrame([(i,) for i in kept], "row long")
    table = table.join(F.broadcast(keep), "row")  # at most max_labelled rows of 8 bytes
    rate = n_toxic / len(kept)
    by_word = table.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("k"))
    by_word = cut(by_word.filter("n > 1"))
    least = math.log(2 * max(1, by_word.count()))
    p = F.col("k") / F.col("n")
    surprise = F.col("n") * (F.when(p > 0, p * F.log(p / rate)).otherwise(0.0) + F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - rate))).otherwise(0.0))
    words = [r.word for r in by_word.filter(p > rate).withColumn("s", surprise).filter(F.col("s") > least).orderBy(F.desc("s"), "word").limit(max_words).collect()]
    words.sort()
    if not words:
        return SeverityModel()
    index = {w: i for i, w in enumerate(words)}
    lexicon = F.array(*map(F.lit, words))
    pairs = F.filter(F.arrays_zip("words", "counts"), lambda z: F.array_contains(lexicon, z["words"]))
    table = cut(table.select("id", "toxic", "total", pairs.alias("pairs")))
    empty = {r.bad: r["count"] for r in table.filter(F.size("pairs") == 0).groupBy((F.col("toxic") > 0).alias("bad")).count().collect()}
    rows = table.filter(F.size("pairs") > 0).orderBy("id").collect()
    x, number = np.zeros((len(rows) + 2, len(words) + 1), np.float32), np.ones(len(rows) + 2)
    toxic, share = np.zeros(len(rows) + 2, bool), np.zeros(len(rows) + 2)
    for i, r in enumerate(rows):
        for z in r.pairs:
            x[i, index[z["words"]]] = 1 + math.log(z["counts"])
        share[i] = sum(z["counts"] for z in r.pairs) / max(1, r.total)
        x[i, -1] = share_feature(share[i])
        toxic[i] = r.toxic > 0
    toxic[-1] = True  # the last two rows stand for all clean and all toxic rows without any of the words
    number[-2:] = [max(empty.get(False, 0), 1e-6), max(empty.get(True, 0), 1e-6)]
    some = share[toxic & (share > 0)]
    thirds = np.quantile(some, [1 / 3, 2 / 3]) if len(some) else np.array([0.0, 0.0])
    grade = np.where(toxic, 1 + (share > thirds[0]).astype(int) + (share > thirds[1]), 0)
    grade[-1] = 1
    weights, cuts = fit_ordinal(x, grade, number)
    return SeverityModel(words, weights, cuts)


def severity(docs: DataFrame, model: SeverityModel, text_col: str = "text", out_col: str = "severity") -> DataFrame:
    """Adds a struct: expected (0 to 3), and grade (the most probable one)."""
    prepare(docs.sparkSession)

    @F.pandas_udf("expected double, grade int")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            up = np.array([model.above(t) for t in batch]).reshape(-1, GRADES)
            edge = np.column_stack([np.ones(len(up)), up, np.zeros(len(up))])
            yield pd.DataFrame({"expected": up.sum(axis=1), "grade": (edge[:, :-1] - edge[:, 1:]).argmax(axis=1).astype("int32")})

    return docs.withColumn(out_col, score(text_or_empty(docs[text_col])))


def toxicity(docs: DataFrame, labels: DataFrame, reject_at: float = REJECT_AT) -> DataFrame:
    """(doc_id, expected_severity, grade, toxic): toxic if the expected severity is at least reject_at."""
    scored = severity(docs.select("doc_id", "text"), fit_severity(docs, labels))
    return scored.select("doc_id", F.col("severity.expected").alias("expected_severity"), F.col("severity.grade").alias("grade"), (F.col("severity.expected") >= reject_at).alias("toxic"))


def without_toxic(docs: DataFrame, labels: DataFrame, reject_at: float = REJECT_AT) -> DataFrame:
    """The rows of docs that aren't rejected, with their columns."""
    return severity(docs, fit_severity(docs, labels), out_col="__severity").filter(F.col("__severity.expected") < reject_at).drop("__severity")
