"""Benchmark decontamination by template canonicalisation.

Texts become sequences of template words: a run of numbers, of units or of names within a sentence is replaced by one typed
placeholder (so that "25" and "twenty-five", "Tom" and "Mary Ann" are alike), other words are lower-cased, ideographs and kana
are words of one character. Windows of `WINDOW` template words (a shorter item is one window of its own length, from `LEAST`
words on) are hashed and looked up among those of the benchmark. Windows in which fewer than half of the words are literal don't
count. Hits of one item at alignments that lie at most `SLACK` words apart belong together; their slots must be consistent:
a value of the item stands for one value of the text, and the other way round; windows with another one don't count. What is
left is cut down to the longest row of windows that go on in both, item and text. Items whose numbers or names were changed, or
with a word put in or left out, are thus found, chance mixtures are not.

Items that this leaves out in part or as a whole (fewer than `LEAST` template words, or windows that are mostly placeholders)
are looked for word by word as well: windows of `WINDOW` plain words, without placeholders, joined up in the same way. An item of
fewer than `LEAST` plain words is found where it is a whole sentence or line.

A document is contaminated by an item if consistent windows cover at least `COVERAGE` of the item's windows, or a stretch of at
least `STRETCH` words, or of `SHORT_STRETCH` if that is half of the item; between two windows of a stretch at most `GAP`
words of the item may fail. So one changed, added or missing literal word can't hide an item of 18 or more template words.

The benchmark's windows are looked up in blocks of at most `BLOCK` windows (24 bytes each, so the block sent
to executors is of bounded size); a larger benchmark takes more passes over the documents.

Defined results: null texts count as empty and are clean; items with null text or id, or without a word, match
nothing; repeated items count once; repeated rows repeat their result; columns called as the output are replaced, others stay.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import chunks, mix, prepare, text_or_empty, word_hash

WINDOW = 8
LEAST = 5
COVERAGE = 0.5
STRETCH = 13
SHORT_STRETCH = 10
SLACK = 3
GAP = 2
BLOCK = 1_000_000

# Number words, units and given names that take a placeholder.
NUMBERS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen".split()
UNITS = "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces pound pounds ton tons ml cl l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years cent cents dollar dollars euro euros meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters degree degrees percent mph kmh kw kwh watt watts volt volts".split()
NAMES = "alice anna bob carlos charlie daniel david emily emma fatima george hannah ivan jack jane jessica john julia karen laura lisa lucas maria mark mary michael natalia nina olivia omar paul peter priya rachel robert sam sara sarah sofia susan thomas tom weng wei yuki".split()

#: Ideographs, kana and Thai are words of one character, as their words aren't set apart.
SINGLE = "\u0e00-\u0e7f\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
TOKEN = re.compile(rf"[^\W\d_{SINGLE}]+|\d+(?:[.,]\d+)*|[{SINGLE}]|[.!?\n\u3002\uff01\uff1f]")
ENDS = frozenset(".!?\n\u3002\uff01\uff1f")
NUM, UNIT, NAME = 1, 2, 3
#: Groups of characters; those of the last two are tokens by themselves.
LETTERS, DIGITS, CHARACTER, END = 1, 2, 3, 4


class Words(NamedTuple):
    """Words of some texts, one after another. begins: does a template word begin here? opens: does a sentence?"""

    plain: np.ndarray  # hash of each word
    opens: np.ndarray
    begins: np.ndarray
    lens: np.ndarray  # words of each text
    code: np.ndarray  # of each template word
    kind: np.ndarray
    template_lens: np.ndarray


@cache
def characters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every code point: hash of the lower-cased one, whether it is upper case, and its group (0: between words)."""
    chars = [chr(c) for c in range(0x110000)]
    group = np.fromiter(map(str.isalnum, chars), bool, len(chars)).astype(np.uint8) * LETTERS
    group[[ord(x) for x in re.findall(f"[{SINGLE}]", "".join(chars))]] = CHARACTER
    group[np.fromiter(map(str.isdecimal, chars), bool, len(chars))] = DIGITS
    group[[ord(x) for x in ENDS]] = END
    lower = np.fromiter((ord(x.lower()[0]) for x in chars), np.uint64, len(chars))
    return mix(lower), np.fromiter(map(str.isupper, chars), bool, len(chars)), group


class Canonicaliser:
    """Words and template words of many texts at a time, over arrays of code points; what it takes for a word is what TOKEN
    matches. The code of a placeholder says its type, that of a literal word is its hash."""

    def __init__(self):
        self.lower, self.upper, self.group = characters()
        self.codes = np.array([word_hash(b"\0%d" % k) for k in range(4)], np.uint64)
        typed = dict.fromkeys(NUMBERS, NUM) | dict.fromkeys(UNITS, UNIT) | dict.fromkeys(NAMES, NAME)
        self.typed = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        hashes = self.words_of([" ".join(typed)]).plain
        order = np.argsort(hashes)
        self.typed = hashes[order], np.fromiter(typed.values(), np.int64, len(typed))[order]

    def _tokens(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where tokens begin, their groups, and their hashes."""
        group = self.group[codes]
        point = np.flatnonzero((codes == ord(".")) | (codes == ord(",")))
        point = point[(point > 0) & (point < len(codes) - 1)]
        group[point[(group[point - 1] == DIGITS) & (group[point + 1] == DIGITS)]] = DIGITS
        begins = group > 0
        inside = begins.copy()
        begins[1:] &= (group[1:] != group[:-1]) | (group[1:] >= CHARACTER)
        at, starts = np.flatnonzero(begins), np.flatnonzero(begins[inside])
        size = np.diff(np.append(starts, np.count_nonzero(inside)))
        powers = np.full(size.max(initial=1), np.uint64(0x9E3779B97F4A7C15))
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        place = np.arange(size.sum()) - np.repeat(starts, size)
        hashes = np.add.reduceat(self.lower[codes[inside]] * powers[place], starts) if len(starts) else np.zeros(0, np.uint64)
        return at, group[at], mix(hashes ^ size.astype(np.uint64))

    def words_of(self, texts: list[str]) -> Words:
        codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        at, group, value = self._tokens(codes)
        text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), at, "right")
        known, types = self.typed
        kind = np.where(group == DIGITS, NUM, 0)
        if len(known):
            near = np.minimum(np.searchsorted(known, value), len(known) - 1)
            kind += np.where(known[near] == value, types[near], 0)
        word = group != END
        start = np.ones(len(at), bool)
        start[1:] = ~word[:-1] | (text[1:] != text[:-1])
        kind[(kind == 0) & ~start & self.upper[codes[at]] & (group == LETTERS)] = NAME
        more = np.zeros(len(at), bool)  # goes on with the placeholder of the word before
        more[1:] = (kind[1:] > 0) & (kind[1:] == kind[:-1]) & ~start[1:]
        kind, plain, text, start, begins = kind[word], value[word], text[word], start[word], ~more[word]
        code = np.where(kind == 0, plain, self.codes[kind])[begins]
        count = lambda t: np.bincount(t, minlength=len(texts))
        return Words(plain, start, begins, count(text), code, kind[begins], count(text[begins]))


def plain_words(text: str) -> list[str]:
    return [w.lower() for w in TOKEN.findall(text) if w not in ENDS]


def slots(words: list[str], begins: np.ndarray) -> list[str]:
    """What stands at each template word: a literal word, or the words that its placeholder replaces."""
    at = [*np.flatnonzero(begins).tolist(), len(words)]
    return [" ".join(words[i:j]) for i, j in zip(at, at[1:])]


def window_hashes(code: np.ndarray, kind: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the window that begins at each template word, and whether at least half of its words are literal."""
    n = len(code) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    h = np.zeros(n, np.uint64)
    for j in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + code[j : j + n]
    literal = np.concatenate([[0], np.cumsum(kind == 0)])
    return mix(h ^ np.uint64(size)), 2 * (literal[size:] - literal[:-size]) >= size


class Item(NamedTuple):
    id: int
    size: int  # of its windows
    windows: int  # that count
    kind: np.ndarray
    words: list[str]
    whole: bool  # must be a whole sentence


class WindowIndex:
    """Windows of items, sorted by hash, for each size of a window."""

    def __init__(self):
        self.items: list[Item] = []
        self.rows = defaultdict(list)

    def add(self, item: Item, hashes: np.ndarray, ok: np.ndarray) -> None:
        for p in np.flatnonzero(ok).tolist():
            self.rows[item.size].append((int(hashes[p]), len(self.items), p))
        self.items.append(item)

    def done(self) -> WindowIndex:
        self.by_size = {}
        for size, r in self.rows.items():
            r.sort()
            hashes = np.array([x[0] for x in r], np.uint64)
            bits = np.zeros(1 << 22, bool)
            bits[(hashes >> np.uint64(42)).astype(np.int64)] = True
            self.by_size[size] = (hashes, bits, [x[1:] for x in r])
        del self.rows
        return self

    def hits(self, code: np.ndarray, kind: np.ndarray, lens: np.ndarray, opens: np.ndarray) -> dict[int, dict[int, list[tuple[int, int]]]]:
        """By text and item: where windows of the item are (place in the item, place in the text)."""
        begin = np.concatenate([[0], np.cumsum(lens)])
        out: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for size, (hashes, bits, places) in self.by_size.items():
            h, ok = window_hashes(code, kind, size)
            maybe = np.flatnonzero(bits[(h >> np.uint64(42)).astype(np.int64)] & ok)
            lo, hi = np.searchsorted(hashes, h[maybe], "left"), np.searchsorted(hashes, h[maybe], "right")
            there = lo < hi
            maybe, lo, hi = maybe[there], lo[there], hi[there]
            owner = np.searchsorted(begin, maybe, "right") - 1
            for g, a, b, d in zip(maybe.tolist(), lo.tolist(), hi.tolist(), owner.tolist()):
                if g + size <= begin[d + 1]:
                    alone = opens[g] and (g + size == begin[d + 1] or opens[g + size])
                    for i, p in places[a:b]:
                        if alone or not self.items[i].whole:
                            out[d][i].append((p, g - int(begin[d])))
        return out


class TemplateIndex:
    """Template windows of a block of items, and plain windows of those items that templates leave out in part."""

    def __init__(self, items: list[tuple[int, str]]):
        x = Canonicaliser().words_of([t for _, t in items])
        self.templates, self.plain = WindowIndex(), WindowIndex()
        at = template_at = 0
        for (item, text), n, m in zip(items, x.lens.tolist(), x.template_lens.tolist()):
            words, left_out = plain_words(text), m < LEAST
            if m >= LEAST:
                size, kind = min(WINDOW, m), x.kind[template_at : template_at + m]
                h, ok = window_hashes(x.code[template_at : template_at + m], kind, size)
                self.templates.add(Item(item, size, int(ok.sum()), kind, slots(words, x.begins[at : at + n]), False), h, ok)
                left_out = not ok.all()
            if left_out and n:
                size, kind = min(WINDOW, n), np.zeros(n, np.int64)
                h, ok = window_hashes(x.plain[at : at + n], kind, size)
                self.plain.add(Item(item, size, len(h), kind, words, n < LEAST), h, ok)
            at, template_at = at + n, template_at + m
        self.templates.done(), self.plain.done()


def consistent(item: Item, spots: list[tuple[int, int]], theirs: list[str]) -> tuple[list[tuple[int, int]], set[int]]:
    """The spots without a slot that is against the votes, and the item's places of such slots. Each place of a slot votes for what its value stands for, both
    ways (of equal votes the first place's holds)."""
    pairs = sorted({(p + j, g + j) for p, g in spots for j in range(item.size) if item.kind[p + j]})
    votes: tuple[dict, dict] = ({}, {})
    for i, t in pairs:
        for table, x, y in ((votes[0], item.words[i], theirs[t]), (votes[1], theirs[t], item.words[i])):
            count = table.setdefault((int(item.kind[i]), x), {})
            count[y] = count.get(y, 0) + 1
    there, back = ({x: max(c, key=c.get) for x, c in v.items()} for v in votes)
    bad = {(i, t) for i, t in pairs if there[int(item.kind[i]), item.words[i]] != theirs[t] or back[int(item.kind[i]), theirs[t]] != item.words[i]}
    return [(p, g) for p, g in spots if not any((p + j, g + j) in bad for j in range(item.size))], {i for i, _ in bad}


def rising(spots: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest row of spots that goes on in both places."""
    spots = sorted(spots, key=lambda s: (s[0], -s[1]))
    ends: list[int] = []  # smallest last place in the text of a row of each length
    last: list[int] = []
    before = [-1] * len(spots)
    for i, (_, g) in enumerate(spots):
        k = bisect_left(ends, g)
        before[i] = last[k - 1] if k else -1
        ends[k : k + 1], last[k : k + 1] = [g], [i]
    row, i = [], last[-1] if last else -1
    while i >= 0:
        row.append(spots[i])
        i = before[i]
    return row[::-1]


def stretch_of(row: list[tuple[int, int]], size: int, bad: set[int]) -> int:
    """Most words of the item that windows cover one after another, with gaps of at most GAP of its words, none a slot in
    `bad`, and SLACK of the text's."""
    best = now = 0
    end = text_end = None
    for p, g in row:
        if end is not None and p - end <= GAP and g - text_end <= SLACK and not any(i in bad for i in range(end, p)):
            now += p + size - max(end, p)
        else:
            now = size
        best, end, text_end = max(best, now), p + size, g + size
    return best


def alignments(spots: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
    """Spots whose alignments lie at most SLACK words apart, one to the next."""
    spots = sorted(spots, key=lambda s: (s[1] - s[0], s))
    start = 0
    for i in range(1, len(spots) + 1):
        if i == len(spots) or (spots[i][1] - spots[i][0]) - (spots[i - 1][1] - spots[i - 1][0]) > SLACK:
            yield spots[start:i]
            start = i


class Matcher:
    def __init__(self, index: TemplateIndex):
        self.index, self.canon = index, Canonicaliser()

    def match_all(self, texts: list[str]) -> list[list[tuple[int, float]]]:
        """For each text the items that contaminate it, with their coverage."""
        x = self.canon.words_of(texts)
        begin = np.concatenate([[0], np.cumsum(x.lens)])
        best: list[dict[int, float]] = [{} for _ in texts]
        hits = self.index.templates.hits(x.code, x.kind, x.template_lens, x.opens[x.begins])
        for d, by_item in hits.items():
            theirs = slots(plain_words(texts[d]), x.begins[begin[d] : begin[d + 1]])
            for i, spots in by_item.items():
                self._judge(self.index.templates.items[i], spots, theirs, best[d])
        if self.index.plain.items:
            for d, by_item in self.index.plain.hits(x.plain, np.zeros(len(x.plain), np.int64), x.lens, x.opens).items():
                for i, spots in by_item.items():
                    self._judge(self.index.plain.items[i], spots, [], best[d])
        return [sorted(b.items()) for b in best]

    @staticmethod
    def _judge(item: Item, spots: list[tuple[int, int]], theirs: list[str], best: dict[int, float]) -> None:
        for group in alignments(spots):
            good, bad = consistent(item, group, theirs)
            row = rising(good)
            share, stretch = len(row) / item.windows if item.windows else 0.0, stretch_of(row, item.size, bad)
            if share >= COVERAGE and row or stretch >= STRETCH or stretch >= max(SHORT_STRETCH, len(item.kind) / 2):
                best[item.id] = max(best.get(item.id, 0.0), share)


def benchmark_blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", block: int = BLOCK) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks that together have at most about `block` windows each (of each kind an item has fewer than words)."""
    items = benchmark.select(benchmark[item_col].cast("long").alias("item"), benchmark[text_col].alias("text")).dropna().distinct()
    words = items.agg(F.sum(F.length("text") + 1).alias("n")).first().n or 0
    n = int(words // block) + 1
    part = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    for b in range(n):
        rows = sorted((r.item, r.text) for r in items.filter(part == b).collect())
        if rows or n == 1:
            yield rows


def _matching(index: TemplateIndex):
    @F.pandas_udf("items array<long>, coverage double")
    def match(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(index)
        for batch in batches:
            found = [f for _, part in chunks(batch.tolist()) for f in matcher.match_all(part)]
            yield pd.DataFrame({"items": pd.Series([[i for i, _ in f] for f in found], dtype=object), "coverage": pd.Series([max([0.0, *(c for _, c in f)]) for f in found], dtype="float64")})

    return match


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", out_col: str = "contamination") -> DataFrame:
    """Adds a struct: items (ids, ascending) and coverage (the largest)."""
    prepare(docs.sparkSession)
    parts = []
    for number, items in enumerate(benchmark_blocks(benchmark)):
        parts.append(f"__block_{number}")
        docs = docs.withColumn(parts[-1], _matching(TemplateIndex(items))(text_or_empty(docs[text_col])))
    items = F.array_sort(F.array_distinct(F.flatten(F.array(*(F.col(p)["items"] for p in parts)))))
    coverage = F.greatest(F.lit(0.0), F.lit(0.0), *(F.col(p)["coverage"] for p in parts))
    return docs.withColumn(out_col, F.struct(items.alias("items"), coverage.alias("coverage"))).drop(*parts)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, contaminated, item_ids, coverage) for each document."""
    x = contamination(docs.select("doc_id", "text"), benchmark)
    return x.select("doc_id", (F.size("contamination.items") > 0).alias("contaminated"), F.col("contamination.items").alias("item_ids"), F.col("contamination.coverage").alias("coverage"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that no item contaminates, with their columns."""
    return contamination(docs, benchmark, out_col="__contamination").filter(F.size("__contamination.items") == 0).drop("__contamination")
