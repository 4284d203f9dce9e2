"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram's vector binds (multiplies) its letters'
vectors, the first rolled by two places and the second by one. A document's vector bundles (adds) those of its trigrams;
a language's prototype bundles the unit vectors of its training documents. Documents go to the language
whose prototype has the largest cosine with their own vector.

Prototypes are fitted on at most `max_train` labelled documents, those whose hashed ids are smallest, so
that the same rows are taken however the table is split. Prediction covers every whole text.

Defined results: a null text, or one without a letter, is `und` with score 0; equal cosines go to the
language first in alphabetical order; without any training row everything is `und`; repeated rows repeat
their result; other columns of the table are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import bounded_sample, chunks, crc32_id, prepare, text_or_empty

DIMS = 1024
MAX_TRAIN = 8000
#: Trigrams whose vectors are held at once.
BLOCK = 8192
LETTER = np.uint64((1 << 21) - 1)


class Hypervectors:
    """Vectors of letters and trigrams. A letter (lower-cased) has a vector of its own, drawn from the seed and its code
    point; number 0 stands for all that is between words."""

    def __init__(self, dims: int = DIMS, seed: int = 20260101):
        self.dims, self.seed = dims, seed
        self.letters = np.zeros(0x110000, np.uint64)
        for c in range(0x110000):
            if (x := chr(c)).isalpha():
                self.letters[c] = ord(x.lower()[0])
        self.known: dict[int, np.ndarray] = {}

    def letter(self, code: int) -> np.ndarray:
        """The vector of a letter; those drawn are kept, at most one for each letter there is."""
        if code not in self.known:
            self.known[code] = np.random.default_rng([self.seed, code]).integers(0, 2, self.dims, dtype=np.int8) * 2 - 1
        return self.known[code]

    def trigrams(self, grams: np.ndarray) -> np.ndarray:
        """A row for each trigram: its letters' vectors, the first rolled by two and the second by one, multiplied."""
        parts = np.stack([grams >> np.uint64(42), grams >> np.uint64(21) & LETTER, grams & LETTER])
        codes, at = np.unique(parts, return_inverse=True)
        base = np.stack([self.letter(c) for c in codes.tolist()])
        a, b, c = at.reshape(parts.shape)
        return (np.roll(base, 2, axis=1)[a] * np.roll(base, 1, axis=1)[b] * base[c]).astype(np.float32)

    def bundle(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A row for each text, and whether it has a letter."""
        lens = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        sym = self.letters[codes]
        doc = np.repeat(np.arange(len(texts), dtype=np.int32), lens)
        keep = np.ones(len(sym), bool)  # runs of what is between words count as one symbol
        keep[1:] = (sym[1:] != 0) | (sym[:-1] != 0) | (doc[1:] != doc[:-1])
        sym, doc = sym[keep], doc[keep]
        has = np.bincount(doc, sym > 0, len(texts)) > 0
        none = np.zeros(1, np.uint64)
        before = np.concatenate([none, sym[:-1]])
        before[np.concatenate([[True], doc[1:] != doc[:-1]])] = 0
        after = np.concatenate([sym[1:], none])
        after[np.concatenate([doc[1:] != doc[:-1], [True]])] = 0
        mid = sym > 0
        gram = before[mid] << np.uint64(42) | sym[mid] << np.uint64(21) | after[mid]
        kinds, gram = np.unique(gram, return_inverse=True)
        out = np.zeros((len(texts), self.dims), np.float32)
        if len(kinds):
            # how often each text has each trigram, by trigram; then sums of whole numbers in blocks, so any order gives the same
            cell, n = np.unique(gram * len(texts) + doc[mid], return_counts=True)
            gram, doc = cell // len(texts), cell % len(texts)
            for first in range(0, len(kinds), BLOCK):
                self._add(out, kinds[first : first + BLOCK], *(x[slice(*np.searchsorted(gram, [first, first + BLOCK]))] for x in (gram - first, doc, n)))
        return out, has

    def _add(self, out: np.ndarray, kinds: np.ndarray, gram: np.ndarray, doc: np.ndarray, n: np.ndarray) -> None:
        vectors = self.trigrams(kinds)
        if 32 * len(gram) >= len(kinds) * len(out):  # many texts share these trigrams
            for at in range(0, len(out), 256):
                mine = (doc >= at) & (doc < at + 256)
                counts = np.zeros((min(256, len(out) - at), len(kinds)), np.float32)
                counts[doc[mine] - at, gram[mine]] = n[mine]
                out[at : at + 256] += counts @ vectors
            return
        order = np.argsort(doc, kind="stable")
        for at in range(0, len(order), BLOCK):
            rows = order[at : at + BLOCK]
            docs, starts = np.unique(doc[rows], return_index=True)
            out[docs] += np.add.reduceat(vectors[gram[rows]] * n[rows, None].astype(np.float32), starts, axis=0)


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def fit_prototypes(train: DataFrame, text_col: str, lang_col: str, max_train: int = MAX_TRAIN, dims: int = DIMS, order_col: str | None = None) -> tuple[list[str], np.ndarray]:
    """Languages in alphabetical order, and a unit prototype for each. What reaches the driver has languages x dims values."""
    prepare(train.sparkSession)
    rows = train.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sample = bounded_sample(rows, F.col(order_col or text_col), max_train).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))

    def bundled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        space, sums = Hypervectors(dims), {}
        for x in batches:
            texts, langs = x.text.tolist(), x.lang.tolist()
            for at, part in chunks(texts):
                rows, has = space.bundle(part)
                rows = unit(rows)
                for i in np.flatnonzero(has):
                    sums.setdefault(langs[at + i], np.zeros(dims))
                    sums[langs[at + i]] += rows[i]
        for lang, v in sums.items():
            yield pd.DataFrame({"lang": lang, "dim": np.arange(dims), "value": v})

    rows = sample.mapInPandas(bundled, "lang string, dim int, value double").groupBy("lang", "dim").agg(F.sum("value").alias("value")).collect()
    langs = sorted({r.lang for r in rows})
    out = np.zeros((len(langs), dims))
    for r in rows:
        out[langs.index(r.lang), r.dim] = round(r.value, 6)
    return langs, unit(out).astype(np.float32)


def identify(docs: DataFrame, langs: list[str], prototypes: np.ndarray, text_col: str = "text", out_col: str = "language", dims: int = DIMS) -> DataFrame:
    """Adds a struct (lang, score): the language of the nearest prototype, and its cosine between 0 and 1."""
    prepare(docs.sparkSession)

    @F.pandas_udf("lang string, score double")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        space = Hypervectors(dims)
        for batch in batches:
            lang, score = [], []
            for _, part in chunks(batch.tolist()):
                rows, has = space.bundle(part)
                if not langs:
                    has[:] = False
                cos = unit(rows) @ prototypes.T if langs else np.zeros((len(part), 1))
                best = cos.argmax(axis=1)
                lang += [langs[b] if ok else "und" for b, ok in zip(best.tolist(), has.tolist())]
                score += np.where(has, np.clip(cos[np.arange(len(part)), best], 0, 1), 0.0).tolist()
            yield pd.DataFrame({"lang": pd.Series(lang, dtype=object), "score": pd.Series(score, dtype="float64")})

    return docs.withColumn(out_col, nearest(text_or_empty(docs[text_col])))


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_train: int = MAX_TRAIN) -> DataFrame:
    """Fits on the rows that aren't held out (crc32 of the id as text, mod 4, is not 2) and predicts all rows."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), docs[lang_col].alias("lang"))
    held = F.coalesce(crc32_id(F.col("doc_id")) % 4 == 2, F.lit(False))
    langs, prototypes = fit_prototypes(rows.filter(~held & F.col("doc_id").isNotNull()), "text", "lang", max_train, order_col="doc_id")
    return identify(rows.select("doc_id", "text"), langs, prototypes).select("doc_id", held.alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))
