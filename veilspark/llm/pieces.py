"""SentencePiece BPE by vectorised merge rounds.

The model file is a parameter and only read. Symbols of all words of a chunk lie in one flat array.
In each round every word finds its best-ranked adjacent pair by a segmented minimum and merges all of
that pair's occurrences from the left at once; merged arrays are compacted and finished words leave,
until no pair remains. Where a longer piece that contains the merged one ranks at least as well, a word
merges only the leftmost occurrence in that round: then the order of single merges can matter.

Words are runs of the space symbol with what follows up to the next one; no piece goes across such a
border or across a line feed (both are checked against the model when it is loaded). Words of more than `LONG`
symbols, such as blobs without blanks, take the same merges from a heap instead, in O(n log n).

Defined results: a null text is an empty one and has no ids; repeated rows repeat their result; other columns
stay, but for columns called as the output, which are replaced.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import chunks, prepare, text_or_empty

SPACE = "▁"
LONG = 2048
NONE = np.int32(2**31 - 1)


def read_model(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, type) in the order of ids, from the protocol buffer's first field."""
    data = open(path, "rb").read()

    def number(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[i]
            value |= (b & 127) << shift
            i, shift = i + 1, shift + 7
            if b < 128:
                return value, i

    def fields(i: int, end: int) -> Iterator[tuple[int, object]]:
        while i < end:
            tag, i = number(i)
            if tag & 7 == 0:
                value, i = number(i)
            elif tag & 7 == 2:
                n, i = number(i)
                value, i = (i, i + n), i + n
            else:
                n = 4 if tag & 7 == 5 else 8
                value, i = data[i : i + n], i + n
            yield tag >> 3, value

    out = []
    for tag, span in fields(0, len(data)):
        if tag == 1:
            x = dict(fields(*span))
            out.append((data[x[1][0] : x[1][1]].decode(), struct.unpack("<f", x.get(2, b"\0\0\0\0"))[0], x.get(3, 1)))
    return out


class PieceModel:
    NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6

    def __init__(self, path: str):
        pieces = read_model(path)
        self.size = len(pieces)
        normal = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == self.NORMAL}
        self.byte_id = np.array([next(i for i, (p, _, k) in enumerate(pieces) if k == self.BYTE and p == f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.code_id = np.full(0x110000, -1, np.int32)
        for p, i in normal.items():
            if len(p) == 1:
                self.code_id[ord(p)] = i
        order = {s: r for r, s in enumerate(sorted({s for _, s, _ in pieces}, reverse=True))}
        self.rank = np.array([order[s] for _, s, _ in pieces], np.int32)
        # longest piece chain: a piece is careful if a longer one around it ranks at least as well
        self.careful = np.zeros(self.size, bool)
        pairs = {}
        for p, i in normal.items():
            for k in range(1, len(p)):
                a, b = normal.get(p[:k]), normal.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = i
            for k in range(len(p)):
                for n in range(2, len(p) - (k == 0)):
                    if k + n <= len(p) and (j := normal.get(p[k : k + n])) is not None and j != i and self.rank[i] <= self.rank[j]:
                        self.careful[j] = True
            if "\n" in p and len(p) > 1 or re.search(f"[^{SPACE}]{SPACE}", p):
                raise ValueError(f"piece {i} goes across a word border")
        self.pairs = pairs
        self._build_table()
        raw = [bytes([int(p[3:5], 16)]) if k == self.BYTE else p.replace(SPACE, " ").encode() if k == self.NORMAL else " ⁇ ".encode() if k == self.UNKNOWN else b"" for p, _, k in pieces]
        self.raw_len = np.array([len(x) for x in raw], np.int64)
        self.raw_off = np.concatenate([[0], np.cumsum(self.raw_len)])[:-1]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.is_byte = np.array([k == self.BYTE for _, _, k in pieces])
        self.starts_space = np.array([p.startswith(SPACE) and k == self.NORMAL for p, _, k in pieces])

    # ---- encoding -------------------------------------------------------------------------------

    def _build_table(self) -> None:
        """Open addressing: a pair is in one of the `probes` slots from its first one on."""
        bits = 20
        self.shift = np.uint64(64 - bits)
        keys, ids = np.array(list(self.pairs), np.int64), np.array(list(self.pairs.values()), np.int32)
        self.slot_key = np.full((1 << bits) + 64, -1, np.int64)
        self.slot_id = np.full((1 << bits) + 64, -1, np.int32)
        slot, self.probes = self._first_slot(keys), 0
        while len(keys):
            free = self.slot_key[slot] < 0
            _, one = np.unique(slot, return_index=True)
            put = np.zeros(len(keys), bool)
            put[one] = True
            put &= free
            self.slot_key[slot[put]], self.slot_id[slot[put]] = keys[put], ids[put]
            keys, ids, slot = keys[~put], ids[~put], slot[~put] + 1
            self.probes += 1

    def _first_slot(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of the piece that two neighbours make; -1 if none."""
        key = left.astype(np.int64) * self.size + right
        key[(left < 0) | (right < 0)] = -2
        slot = self._first_slot(key)
        seen = self.slot_key[slot]
        out = np.where(seen == key, self.slot_id[slot], np.int32(-1))
        todo = np.flatnonzero((seen != key) & (seen >= 0))
        for step in range(1, self.probes):
            if not len(todo):
                break
            at = slot[todo] + step
            seen = self.slot_key[at]
            hit = seen == key[todo]
            out[todo[hit]] = self.slot_id[at[hit]]
            todo = todo[~hit & (seen >= 0)]
        return out

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all words, and where each word's begin (one more than words)."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sym = self.code_id[codes]
        word = np.repeat(np.arange(len(words), dtype=np.int64), lens)
        done_sym, done_word, done_code = [], [], []
        starts = np.concatenate([[0], np.cumsum(lens)])
        if (lens > LONG).any():
            long = lens > LONG
            for w in np.flatnonzero(long):
                part, code = self._by_heap(sym[starts[w] : starts[w + 1]], codes[starts[w] : starts[w + 1]])
                done_sym.append(part), done_code.append(code), done_word.append(np.full(len(part), w))
            keep = ~long[word]
            sym, word, codes = sym[keep], word[keep], codes[keep]
        out = np.full(len(sym), -1, np.int32)
        same = np.flatnonzero(word[1:] == word[:-1])
        out[same] = self.merged(sym[same], sym[same + 1])
        while len(sym):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            rank = np.where(out >= 0, self.rank[out], NONE)
            best = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(sym))))
            over = best == NONE
            if over.any():
                done_sym.append(sym[over]), done_word.append(word[over]), done_code.append(codes[over])
            at = np.flatnonzero((rank == best) & ~over)
            if not len(at):
                break
            # leftmost of each run of overlapping pairs, then every second one
            head = np.concatenate([[True], at[1:] != at[:-1] + 1])
            run = at[head][np.cumsum(head) - 1]
            take = (at - run) % 2 == 0
            lead = np.concatenate([[True], word[at[1:]] != word[at[:-1]]])
            take &= lead | ~self.careful[out[at]]
            at = at[take]
            sym[at] = out[at]
            keep = ~over
            keep[at + 1] = False
            at = (np.cumsum(keep) - 1)[at]
            sym, word, codes, out = sym[keep], word[keep], codes[keep], out[keep]
            # only pairs beside a merged symbol are new
            new = np.concatenate([at, at[at > 0] - 1])
            out[new] = -1
            new = new[new < len(sym) - 1]
            new = new[word[new] == word[new + 1]]
            out[new] = self.merged(sym[new], sym[new + 1])
        if not done_sym:
            return np.zeros(0, np.int32), np.zeros(len(words) + 1, np.int64)
        sym, word, codes = np.concatenate(done_sym), np.concatenate(done_word), np.concatenate(done_code)
        order = np.argsort(word, kind="stable")
        sym, word, codes = sym[order], word[order], codes[order]
        # symbols without a piece become the bytes of their character
        n = np.where(sym >= 0, 1, np.where(codes < 0x80, 1, np.where(codes < 0x800, 2, np.where(codes < 0x10000, 3, 4))))
        at = np.repeat(np.arange(len(sym)), n)
        ids = sym[at]
        if (ids < 0).any():
            begin = np.cumsum(n) - n
            bad = np.flatnonzero(ids < 0)
            c, k, m = codes[at[bad]], bad - begin[at[bad]], n[at[bad]]
            lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])
            byte = np.where(m == 1, c, np.where(k == 0, lead[m] | (c >> (6 * (m - 1))), 0x80 | ((c >> (6 * (m - 1 - k))) & 0x3F)))
            ids[bad] = self.byte_id[byte]
        return ids, np.concatenate([[0], np.cumsum(np.bincount(word, n, len(words)).astype(np.int64))])

    def _by_heap(self, sym: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same merges for one long word: best rank first, then leftmost."""
        s, n = sym.tolist(), len(sym)
        after, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []

        def push(i: int, j: int) -> None:
            if j < n and s[i] >= 0 and s[j] >= 0 and (m := self.pairs.get(s[i] * self.size + s[j])) is not None:
                heapq.heappush(heap, (int(self.rank[m]), i, j, s[i], s[j], m))

        for i in range(n - 1):
            push(i, i + 1)
        gone = bytearray(n + 1)
        while heap:
            _, i, j, a, b, m = heapq.heappop(heap)
            if gone[i] or gone[j] or s[i] != a or s[j] != b or after[i] != j:
                continue
            s[i], gone[j] = m, 1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                push(i, after[i])
            if before[i] >= 0:
                push(before[i], i)
        left = np.flatnonzero(np.frombuffer(bytes(gone[:n]), np.uint8) == 0)
        return np.array([s[i] for i in left.tolist()], np.int32), codes[left]

    # ---- decoding -------------------------------------------------------------------------------

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """Texts of consecutive runs of ids that end at `ends`."""
        n = self.raw_len[ids]
        total = np.concatenate([[0], np.cumsum(n)])
        data = self.raw[np.repeat(self.raw_off[ids] - total[:-1], n) + np.arange(total[-1])].tobytes()
        out, a = [], 0
        for b in ends.tolist():
            if a == b:
                out.append("")
                continue
            raw = data[total[a] : total[b]]
            try:
                text = raw.decode("utf-8")
            except UnicodeDecodeError:
                text = self._decode_broken(ids[a:b])
            out.append(text[1:] if self.starts_space[ids[a]] else text)
            a = b
        return out

    def decode(self, ids: list[int]) -> str:
        x = np.asarray(ids, np.int64)
        return self.decode_all(x, np.array([len(x)]))[0]

    def _decode_broken(self, ids: np.ndarray) -> str:
        """Bytes that make no character become one replacement character each."""
        out, run = [], b""

        def flush() -> None:
            i = 0
            while i < len(run):
                for k in (1, 2, 3, 4):
                    try:
                        out.append(run[i : i + k].decode("utf-8"))
                        i += k
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    i += 1

        for i in ids.tolist():
            piece = self.raw[self.raw_off[i] : self.raw_off[i] + self.raw_len[i]].tobytes()
            if self.is_byte[i]:
                run += piece
            else:
                flush()
                run = b""
                out.append(piece.decode("utf-8"))
        flush()
        return "".join(out)


class _Known(dict):
    """Word to its number; a word met for the first time is listed as fresh."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = k = len(self)
        self.fresh.append(word)
        return k


class PieceEncoder:
    """Texts to ids; remembers the ids of words seen before, up to a limit of words."""

    WORD = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")

    def __init__(self, path: str, limit: int = 300_000):
        self.model, self.limit = PieceModel(path), limit
        self._forget()

    def _forget(self) -> None:
        self.known = _Known()
        self.flat, self.off = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, and where each text's end."""
        if len(self.known) > self.limit:
            self._forget()
        known, numbers, counts = self.known, [], []
        for t in texts:
            words = self.WORD.findall(SPACE + t.replace(" ", SPACE)) if t else []
            numbers.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
            counts.append(len(words))
        if known.fresh:
            ids, off = self.model.encode_words(known.fresh)
            self.off = np.concatenate([self.off, self.off[-1] + off[1:]])
            self.flat = np.concatenate([self.flat, ids])
            known.fresh = []
        k = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
        n = self.off[k + 1] - self.off[k]
        total = np.concatenate([[0], np.cumsum(n)])
        ids = self.flat[np.repeat(self.off[k] - total[:-1], n) + np.arange(total[-1])]
        return ids, total[np.cumsum(counts, dtype=np.int64)]

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        return self.model.decode_all(ids, ends)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_decode(docs: DataFrame, text_col: str = "text", model_path: str | None = None, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """Adds the ids of each whole text (array of int) and the text that these ids decode to."""
    prepare(docs.sparkSession)
    path = model_path or default_model()

    @F.pandas_udf("ids array<int>, decoded string")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder = PieceEncoder(path)
        for batch in batches:
            ids, back = [], []
            for _, part in chunks(batch.tolist()):
                flat, ends = coder.encode_all(part)
                ids += np.split(flat, ends[:-1])
                back += coder.decode_all(flat, ends)
            yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "decoded": pd.Series(back, dtype=object)})

    out = docs.withColumn("__pieces", both(text_or_empty(docs[text_col])))
    return out.withColumns({ids_col: F.col("__pieces.ids"), decoded_col: F.col("__pieces.decoded")}).drop("__pieces")


def decode_ids(df: DataFrame, ids_col: str = "ids", out_col: str = "decoded", model_path: str | None = None) -> DataFrame:
    """Adds the text of a column of ids; null ids give null."""
    prepare(df.sparkSession)
    path = model_path or default_model()

    @F.pandas_udf("string")
    def back(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = PieceModel(path)
        for batch in batches:
            yield pd.Series([None if x is None else model.decode(x) for x in batch], dtype=object)

    return df.withColumn(out_col, back(F.col(ids_col)))
