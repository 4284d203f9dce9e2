"""What the training-data operators share: shared folders, lineage cuts, word hashes.

Nothing outside this subpackage imports it, and it imports nothing from the rest of the library.
"""

from __future__ import annotations

import os
import re
import uuid
from pathlib import Path

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])

#: Rows and bytes in an Arrow batch. A batch holds whole texts; whichever comes first ends it, so that a batch is at most a few
#: megabytes and one text.
BATCH_ROWS, BATCH_BYTES = 1000, "8m"


def prepare(spark: SparkSession) -> None:
    """Lets Python workers import this package, bounds Arrow batches, and makes sure there is a checkpoint folder: that of
    `spark.checkpoint.dir`, or one of its own in local mode. On a cluster without that setting it raises an error."""
    sc = spark.sparkContext
    paths = [p for p in sc.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        sc.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    if not sc.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or f"file:///tmp/veilspark-{uuid.uuid4().hex}")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint folder; nothing is created."""
    prepare(spark)
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a reliable checkpoint, which outlives lost executors."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage by a table in the shared folder. Unlike a checkpoint it carries no constraints of the plan along, which would double from
    round to round of a loop."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def crc32_id(doc_id: Column) -> Column:
    """crc32 of the id as text."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def word_hash(word: bytes) -> int:
    """64 bits of a word, the same in every process."""
    return xxhash.xxh3_64_intdigest(word)


def word_hashes(words: list) -> np.ndarray:
    """The same for a list of bytes or strings."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit arrays."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def chunks(texts: list[str], chars: int = 400_000):
    """Lists of whole texts of about so many characters together, with the index of their first text."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield at, texts[at : i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield at, texts[at:]


def bounded_sample(df: DataFrame, key: Column, most: int) -> DataFrame:
    """The rows with the `most` smallest hashes of key (and rows that tie with the last): however the table is
    split, the same rows. Only hashes are sorted; rows stay where they are."""
    h = F.xxhash64(key)
    last = df.select(h.alias("h")).orderBy("h").limit(most).agg(F.max("h").alias("h")).first().h
    return df.filter(h <= last) if last is not None else df.limit(0)
