"""Token counts in delta-maintained rollups.

The state is a folder of parts and numbered manifests. A batch is a table of signed changes (+1 insert,
-1 delete; a revision is a delete of the old count and an insert of the new one), summed by source,
language and tokenizer version before it is written as a part. Totals are the sums over the parts that the
latest manifest lists, each with the name of its batch. A batch counts from the moment its manifest is renamed into place: what failed
before leaves an unlisted part, and a name that the manifest has is not counted again. `compact` folds
the parts into one and leaves a marker file for each name, so that a late retry is still recognised and manifests
don't grow with the number of batches.

Counting runs in Arrow batches with a public byte-level BPE vocabulary (a parameter) or by words in the JVM.

Defined results: null texts count as empty (0 tokens); null sources and languages are groups of their own;
repeated rows count as often as they occur; an empty batch commits and changes nothing; other columns are
not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.common import cut, prepare, shared_folder, text_or_empty

KEYS = ["source", "lang", "tokenizer"]
SUMS = ["docs", "tokens", "chars"]
SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long, chars long"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def bpe_counts(docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", out_col: str = "tokens") -> DataFrame:
    """Adds the number of tokens of each whole text."""
    prepare(docs.sparkSession)

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        encoding = tiktoken.Encoding("veilspark", pat_str=pattern, mergeable_ranks=load_ranks(vocabulary), special_tokens={})
        for batch in batches:
            yield pd.Series([len(encoding.encode_ordinary(t)) for t in batch], dtype="int64")

    return docs.withColumn(out_col, count(text_or_empty(docs[text_col])))


def word_counts(docs: DataFrame, text_col: str = "text", out_col: str = "tokens") -> DataFrame:
    """Adds the number of runs without blanks."""
    blanks = r"[\x20\x09-\x0D]+"
    plain = F.regexp_replace(F.regexp_replace(text_or_empty(docs[text_col]), blanks, " "), "^ | $", "")
    return docs.withColumn(out_col, F.when(plain == "", F.lit(0).cast("long")).otherwise(F.length(plain) - F.length(F.translate(plain, " ", "")) + 1).cast("long"))


def inserts(counted: DataFrame, tokenizer: str, chars_col: str | None = None) -> DataFrame:
    """Changes that add documents. chars_col names a column with the length of each text, where the text isn't there any more; else the texts are measured."""
    return _signed(counted, tokenizer, F.lit(1), chars_col)


def deletes(counted: DataFrame, tokenizer: str, chars_col: str | None = None) -> DataFrame:
    return _signed(counted, tokenizer, F.lit(-1), chars_col)


def revisions(old: DataFrame, old_tokenizer: str, new: DataFrame, new_tokenizer: str, chars_col: str | None = None) -> DataFrame:
    return deletes(old, old_tokenizer, chars_col).unionByName(inserts(new, new_tokenizer, chars_col))


def _signed(counted: DataFrame, tokenizer: str, sign, chars_col: str | None) -> DataFrame:
    chars = F.col(chars_col) if chars_col else F.length(text_or_empty(F.col("text")))
    return counted.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), sign.cast("long").alias("docs"), (sign * F.col("tokens")).cast("long").alias("tokens"), (sign * chars).cast("long").alias("chars"))


class TokenRollup:
    """Additive totals in a shared folder; one writer at a time."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        prepare(spark)
        self.spark = spark
        self.folder = folder or shared_folder(spark, "token-rollup")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, below: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{below}" if below else self.folder)

    def manifest(self) -> dict:
        """The latest one: its number, the folders to read, and the names of the batches since the last compaction."""
        top = self._path("manifests")
        names = [s.getPath().getName() for s in self._fs.listStatus(top)] if self._fs.exists(top) else []
        numbers = [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]
        if not numbers:
            return {"number": 0, "parts": [], "names": [], "old": []}
        stream = self._fs.open(self._path(f"manifests/{max(numbers):012d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, old: dict, parts: list[str], names: list[str], gone: list[str]) -> None:
        """The rename makes the new state visible at once; a failure before it leaves the old state. gone: parts that nothing reads any more, but
        queries that were planned before."""
        number = old["number"] + 1
        draft, final = self._path(f"manifests/_draft-{uuid.uuid4().hex}"), self._path(f"manifests/{number:012d}.json")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps({"number": number, "parts": parts, "names": names, "old": gone}).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            raise RuntimeError(f"another writer has published manifest {number}")

    def _write(self, sums: DataFrame, name: str) -> str:
        part = f"parts/{name}-{uuid.uuid4().hex}"
        sums.write.parquet(f"{self.folder}/{part}")
        return part

    def _marker(self, batch: str):
        return self._path(f"names/{hashlib.sha256(batch.encode()).hexdigest()}")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds a batch of signed changes. False, and nothing done, if a batch of that name is in already."""
        now = self.manifest()
        if batch in now["names"] or self._fs.exists(self._marker(batch)):
            return False
        part = self._write(changes.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in SUMS)), "batch")
        self._publish(now, [*now["parts"], part], [*now["names"], batch], now.get("old", []))
        return True

    def totals(self) -> DataFrame:
        """Sums over all batches; groups whose sums are all 0 are gone."""
        parts = [f"{self.folder}/{p}" for p in self.manifest()["parts"]]
        rows = self.spark.read.schema(SCHEMA).parquet(*parts) if parts else self.spark.createDataFrame([], SCHEMA)
        return rows.groupBy(*KEYS).agg(*(F.sum(c).cast("long").alias(c) for c in SUMS)).filter(" OR ".join(f"{c} <> 0" for c in SUMS))

    def compact(self) -> None:
        """Folds all parts into one; the names of their batches stay known by markers, which are there before the names leave the manifest. The folded parts
        are removed by the next compaction, so that queries that were planned on them can end."""
        now = self.manifest()
        if len(now["parts"]) > 1:
            for batch in now["names"]:
                self._fs.create(self._marker(batch), True).close()
            self._publish(now, [self._write(self.totals(), "base")], [], now["parts"])
            for p in now.get("old", []):
                self._fs.delete(self._path(p), True)


def rollup_of_corpus(docs: DataFrame, vocabulary: str, pattern: str, bpe_name: str = "byte_bpe_50k", words_name: str = "words_v1") -> DataFrame:
    """Totals of a corpus: one batch inserts provisional word counts under the BPE's name, a second revises them to
    BPE counts and inserts the word counts under their own name; a retry of the second changes nothing."""
    rollup = TokenRollup(docs.sparkSession)
    rows = docs.select("source", "lang", "text", F.length(text_or_empty(docs["text"])).alias("chars"))
    both = bpe_counts(word_counts(rows, out_col="words"), vocabulary, pattern, out_col="bpe").select("source", "lang", "chars", "words", "bpe")
    both = cut(both)  # counted once; a few numbers for each document
    words, bpe = both.withColumn("tokens", F.col("words")), both.withColumn("tokens", F.col("bpe"))
    rollup.commit("provisional", inserts(words, bpe_name, "chars"))
    revised = revisions(words, bpe_name, bpe, bpe_name, "chars").unionByName(inserts(words, words_name, "chars"))
    rollup.commit("revised", revised)
    rollup.commit("revised", revised)
    rollup.compact()
    return rollup.totals()
