"""Exact deduplication with a cuckoo-filter index of live digests.

A digest is the SHA-256 of a text whose runs of blanks are single spaces. The index is sharded by
digest. Each shard is a cuckoo filter: two candidate buckets of four 16-bit fingerprints. Beside the
fingerprints stand, slot by slot, the whole keys and their payloads (the bucketed content): a
fingerprint hit counts only if the stored key is equal. When an insertion finds no place after
`MAX_KICKS` moves, the table doubles and is filled again from the stored keys.

Defined results:

* a null text counts as empty; empty texts are copies of each other;
* of equal texts the row with the smallest id stays; null ids never win against others, and where all
  ids of a group are null all of its rows stay;
* repeated rows (same id, same text) share one decision: both stay or both go; they count twice in
  `group_size`;
* an empty table gives an empty result; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import cut, prepare, text_or_empty

SLOTS = 4
MAX_KICKS = 200
BLANKS = r"[\x20\x09-\x0D]+"


class CuckooIndex:
    """Cuckoo filter over byte keys with slot-aligned content; payload is [live count, smallest id]."""

    def __init__(self, buckets: int = 64):
        self.live = 0
        self.resizes = 0
        self._allocate(buckets)

    def _allocate(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints = array("H", bytes(2 * SLOTS * buckets))
        self.keys: list[bytes | None] = [None] * (SLOTS * buckets)
        self.loads: list[list | None] = [None] * (SLOTS * buckets)

    def _places(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[:2], "little") or 1
        first = int.from_bytes(key[2:10], "little") & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & self.mask

    def _slot(self, key: bytes) -> int:
        mark, one, two = self._places(key)
        for b in (one, two):
            for s in range(b * SLOTS, b * SLOTS + SLOTS):
                if self.prints[s] == mark and self.keys[s] == key:
                    return s
        return -1

    def __len__(self) -> int:
        return self.live

    def __contains__(self, key: bytes) -> bool:
        return self._slot(key) >= 0

    def get(self, key: bytes) -> list | None:
        s = self._slot(key)
        return self.loads[s] if s >= 0 else None

    def insert(self, key: bytes, count: int, smallest: int | None) -> bool:
        """Adds to a live digest, or makes it live; True if it was new."""
        s = self._slot(key)
        if s >= 0:
            load = self.loads[s]
            load[0] += count
            if load[1] is None or smallest is not None and smallest < load[1]:
                load[1] = smallest
            return False
        self._place(key, [count, smallest])
        self.live += 1
        return True

    def delete(self, key: bytes, count: int = 1, smallest: int | None = None) -> bool:
        """Takes from a live digest; at no copies left its slot is free again. `smallest` is the smallest id of the copies that
        stay, as the rows of its bucket have it; the index itself holds no other ids. False if the digest isn't live."""
        s = self._slot(key)
        if s < 0:
            return False
        self.loads[s][0] -= count
        self.loads[s][1] = smallest
        if self.loads[s][0] <= 0:
            self.prints[s], self.keys[s], self.loads[s] = 0, None, None
            self.live -= 1
        return True

    def _place(self, key: bytes, load: list) -> None:
        mark, one, two = self._places(key)
        for b in (one, two):
            for s in range(b * SLOTS, b * SLOTS + SLOTS):
                if self.prints[s] == 0:
                    self.prints[s], self.keys[s], self.loads[s] = mark, key, load
                    return
        b = two
        for kick in range(MAX_KICKS):
            s = b * SLOTS + (kick * 7 + mark) % SLOTS
            mark, self.prints[s] = self.prints[s], mark
            key, self.keys[s] = self.keys[s], key
            load, self.loads[s] = self.loads[s], load
            b = self._other(b, mark)
            for s in range(b * SLOTS, b * SLOTS + SLOTS):
                if self.prints[s] == 0:
                    self.prints[s], self.keys[s], self.loads[s] = mark, key, load
                    return
        self._resize(key, load)

    def _resize(self, key: bytes, load: list) -> None:
        stored = [(k, x) for k, x in zip(self.keys, self.loads) if k is not None] + [(key, load)]
        self.resizes += 1
        self._allocate(2 * (self.mask + 1))
        for k, x in stored:
            self._place(k, x)

    def items(self) -> Iterator[tuple[bytes, list]]:
        return ((k, x) for k, x in zip(self.keys, self.loads) if k is not None)


GROUPS = "digest binary, keep_id long, group_size long"


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (digest, keep_id, group_size) of one shard into the index; its live digests out. Rows of negative size are
    deletions, and their keep_id is the smallest id that stays; they come after the insertions."""
    index = CuckooIndex()
    for b in batches:
        for key, smallest, n in zip(*(b.column(c).to_pylist() for c in ("digest", "keep_id", "group_size"))):
            if n < 0:
                index.delete(key, -n, smallest)
            else:
                index.insert(key, n, smallest)
    types = [("digest", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())]
    rows = []
    for key, (n, smallest) in index.items():
        rows.append((key, smallest, n))
        if len(rows) == 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), types)], names=[n for n, _ in types])
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), types)], names=[n for n, _ in types])


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest): SHA-256 of the text with runs of blanks made one space, computed in the JVM."""
    plain = F.regexp_replace(text_or_empty(docs[text_col]), BLANKS, " ")
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.unhex(F.sha2(plain.cast("binary"), 256)).alias("digest"))


def live_groups(digest_rows: DataFrame) -> DataFrame:
    """One row per distinct digest. Each task first indexes its own rows, so that a digest reaches its shard
    once per task at most, however many copies there are; the shards' indexes then merge these."""
    rows = digest_rows.select("digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    return rows.mapInArrow(_indexed, GROUPS).repartition("digest").mapInArrow(_indexed, GROUPS)


def groups_after(groups: DataFrame, stay: DataFrame, gone: DataFrame) -> DataFrame:
    """The live groups once rows are deleted: digests without a row left are gone, and a group whose smallest id went is called
    after the next one. groups: as `live_groups` returns them; stay and gone: rows (doc_id, digest) that remain and that go. A digest
    in gone that isn't live is passed over. Rows that stay are summed per task before they meet the deletions."""
    counted = gone.groupBy("digest").agg((-F.count(F.lit(1))).alias("group_size"))
    least = stay.groupBy("digest").agg(F.min("doc_id").alias("keep_id"))
    changes = counted.join(least, "digest", "left").select("digest", "keep_id", "group_size")
    rows = groups.select("digest", "keep_id", "group_size").unionByName(changes).repartition("digest")
    return rows.sortWithinPartitions(F.desc("group_size")).mapInArrow(_indexed, GROUPS)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Only groups of two or more rows go into the join back; where one of them is large, the side of the
    documents is split by adaptive execution.
    """
    prepare(docs.sparkSession)
    rows = cut(digests(docs, id_col, text_col))
    many = live_groups(rows).filter("group_size > 1").withColumn("found", F.lit(True))
    return rows.join(many, "digest", "left").select(
        "doc_id",
        F.when(F.col("found"), F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.when(F.col("found"), F.col("doc_id").eqNullSafe(F.col("keep_id"))).otherwise(F.lit(True)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    decided = exact_dedup(docs, id_col, text_col).filter(~F.col("kept")).select(F.col("doc_id").alias("__id"), F.unhex("text_sha256").alias("__digest")).distinct()
    plain = F.regexp_replace(text_or_empty(docs[text_col]), BLANKS, " ")
    digest = F.unhex(F.sha2(plain.cast("binary"), 256))
    return docs.join(decided, docs[id_col].cast("long").eqNullSafe(decided["__id"]) & (digest == decided["__digest"]), "left_anti")


ORACLE = """
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d
"""
