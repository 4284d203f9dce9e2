"""Fill-in-the-middle documents from an index of distinct texts.

1. Rows are dealt by a hash of their text, so that identical texts meet. Texts that hold more bytes in all than a task should take are dealt
   over several places; how many is found from sums per hash beforehand, and at most `HOT_GROUPS` hashes can be above the limit, as the limit is at
   least that share of all bytes.
2. In a partition, sorted by hash, equal texts follow each other. They are one entry of the index if their whole contents are equal, so
   that texts that share a hash only are entries of their own.
3. An entry's token boundaries (code points) are kept as an Elias-Fano list: the low bits of each boundary in one array, the high bits in
   unary in another. It is made once for the entry; each row of the entry is joined to it and selects its two seeded boundaries.

A unit is a run of ASCII letters or one other code point. Forms: plain, psm (prefix, suffix, middle) and spm.

Defined results: a null text is an empty one, which is plain; texts that hold a marker are plain, so that every output can be taken apart
again; a null id is hashed as an empty one; repeated rows repeat their result; an empty table gives an empty one; other columns are not
looked at; a text of any length is cut as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import prepare, text_or_empty

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, PLAIN_FROM, SPM_BELOW = 1, 90, 20
#: Texts of one hash that are more bytes than this, or than this share of all, are dealt over several places.
HOT_BYTES, HOT_GROUPS = 1 << 19, 200_000
#: Bytes that a row counts for besides its text.
ROW_BYTES = 512


class EliasFano:
    """A rising list of numbers up to `universe`: about 2 + log2(universe / length) bits for each."""

    def __init__(self, values: np.ndarray, universe: int):
        self.n = len(values)
        self.bits = max(0, (max(universe, 1) // max(self.n, 1)).bit_length() - 1)
        unary = np.zeros(self.n + (universe >> self.bits) + 1, np.uint8)
        unary[(values >> self.bits) + np.arange(self.n)] = 1
        self.high = np.packbits(unary, bitorder="little")
        low = values[:, None] >> np.arange(self.bits) & 1
        self.low = np.packbits(low.astype(np.uint8).ravel(), bitorder="little")
        # ones before each block of 64 bytes, to find a block by binary search
        ones = np.add.reduceat(np.bitwise_count(self.high).astype(np.int64), np.arange(0, len(self.high), 64))
        self.before = np.concatenate([[0], np.cumsum(ones)])

    def select(self, i: int) -> int:
        """The value number i, from 0."""
        block = int(np.searchsorted(self.before, i, "right")) - 1
        part = np.unpackbits(self.high[64 * block : 64 * block + 64], bitorder="little")
        high = 512 * block + int(np.flatnonzero(part)[i - self.before[block]]) - i
        first, last = i * self.bits, (i + 1) * self.bits
        some = np.unpackbits(self.low[first // 8 : -(-last // 8)], bitorder="little")[first % 8 :][: self.bits]
        return high << self.bits | int(some @ (1 << np.arange(self.bits))) if self.bits else high


def boundaries(text: str) -> np.ndarray:
    """Where units begin, and the end of the text, in code points; n + 1 numbers for n units."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = ((code | 32) >= 97) & ((code | 32) <= 122)
    begins = np.ones(len(code) + 1, bool)
    begins[1:-1] = ~(letter[1:] & letter[:-1])
    return np.flatnonzero(begins)


class Entry:
    """A distinct text with its boundaries."""

    def __init__(self, text: str):
        self.text = text
        at = boundaries(text)
        self.n = len(at) - 1 if text else 0
        self.at = EliasFano(at, len(text))
        self.plain = not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE))
        self.digest = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

    def cut(self, doc_id, seed: int) -> tuple[str, str, int | None, int | None]:
        """Form, output, and the code points of prefix and middle."""
        told = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
        h1, h2, h3, h4 = (int.from_bytes(told[i : i + 4], "big") for i in range(0, 16, 4))
        if self.plain or h3 % 100 >= PLAIN_FROM:
            return "plain", self.text, None, None
        one, two = sorted((h1 % (self.n + 1), h2 % (self.n + 1)))
        one, two = self.at.select(one), self.at.select(two)
        prefix, middle, suffix = self.text[:one], self.text[one:two], self.text[two:]
        if h4 % 100 < SPM_BELOW:
            return "spm", f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}", one, two - one
        return "psm", f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}", one, two - one


def restored(form: str, output: str) -> str:
    """The text that an output was made of."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    one, _, rest = output[len(first) :].partition(second)
    two, _, middle = rest.partition(MIDDLE)
    return one + middle + two if form == "psm" else two + middle + one


FIELDS = {"doc_id": pa.int64(), "n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output_sha256": pa.string(), "restored_sha256": pa.string()}


def _filled(seed: int, with_output: bool):
    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, same = None, []  # the entries of the hash that the rows are at
        fields = FIELDS | ({"output": pa.string()} if with_output else {})
        sha = lambda t: hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest()
        for b in batches:
            out = []
            for doc_id, key, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "key", "text"))):
                if key != at:
                    at, same = key, []
                entry = next((e for e in same if e.text == text), None)
                if entry is None:
                    same.append(entry := Entry(text))
                form, output, prefix, middle = entry.cut(doc_id, seed)
                again = restored(form, output)
                row = (doc_id, entry.n, form, prefix, middle, entry.digest if form == "plain" else sha(output), entry.digest if again == text else sha(again))
                out.append((*row, output) if with_output else row)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * len(fields), fields.values())], names=list(fields))

    return filled


def dealt(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, text) with the hash of their text, identical texts in one partition and one after another, very frequent ones in several."""
    keyed = rows.withColumn("key", F.xxhash64("text"))
    sizes = keyed.groupBy("key").agg(F.sum(F.octet_length("text") + F.lit(ROW_BYTES)).alias("bytes"), F.count(F.lit(1)).alias("copies"))
    most = max(HOT_BYTES, (rows.agg(F.sum(F.octet_length("text") + F.lit(ROW_BYTES))).first()[0] or 0) // HOT_GROUPS)
    hot = sizes.filter((F.col("bytes") > most) & (F.col("copies") > 1)).select(F.col("key").alias("hot"), F.ceil(F.col("bytes") / most).cast("int").alias("places"))
    placed = keyed.join(F.broadcast(hot), keyed["key"] == hot["hot"], "left").withColumn("place", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("places")), F.lit(0)))
    return placed.repartition("key", "place").sortWithinPartitions("key").select("doc_id", "key", "text")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, with_output: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 and, if asked for, output."""
    prepare(docs.sparkSession)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_or_empty(docs[text_col]).alias("text"))
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    return dealt(rows).mapInArrow(_filled(seed, with_output), schema + ", output string" * with_output)


ORACLE = f"""
WITH told AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS unit, sha256('{SEED}:' || doc_id) AS h FROM documents),
cuts AS (
  SELECT *, len(unit) AS n, CAST('0x' || h[1:8] AS UBIGINT) AS h1, CAST('0x' || h[9:16] AS UBIGINT) AS h2, CAST('0x' || h[17:24] AS UBIGINT) AS h3, CAST('0x' || h[25:32] AS UBIGINT) AS h4 FROM told),
parts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= {PLAIN_FROM} THEN 'plain' WHEN h4 % 100 < {SPM_BELOW} THEN 'spm' ELSE 'psm' END AS form FROM cuts),
pieces AS (
  SELECT doc_id, text, CAST(n AS BIGINT) AS n, form, coalesce(array_to_string(unit[1:a], ''), '') AS p, coalesce(array_to_string(unit[a + 1:b], ''), '') AS m, coalesce(array_to_string(unit[b + 1:n], ''), '') AS s FROM parts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM pieces"""
