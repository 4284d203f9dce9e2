"""License scan by template-markup matching.

A template is the wording of a notice in which `[[...]]` marks an optional region and `{{label}}` or
`{{label|n}}` a replaceable one of one to n words (12 if not said). It compiles to a token automaton: states are
places between words, arrows carry one word, any word, or nothing. A text is accepted at a place if its
words follow a path from the first to the last state; mandatory wording must match exactly, word by
word. Acceptance is anchored at the template's first mandatory word and its rarest mandatory run
(which must occur in the text as a whole) spares most texts the automaton. A replaceable region doesn't take the
word that a template begins with, so that of two notices in a row neither swallows the other.

Words are runs of anything but ASCII non-alphanumerics, with A-Z lower-cased. Defined results: null and
empty texts have no words and no hits; `first`/`last` of no hits are null; repeated rows repeat their result;
other columns stay but for those called as the output.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import prepare, text_or_empty

# Phrases of the base scan with their labels.
BASE_PHRASES = [
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
]

# Wording that several public licences share.
MIT_DISCLAIMER = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the {{holders|12}} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
BSD_CONDITIONS = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
BSD_DISCLAIMER = "this software is provided by {{holders|12}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {{holders|12}} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"

# Wording of public licence notices, as templates. (label, template) notice: says which licence holds;
# clause: is one passage of a licence, whose rest isn't looked at; text: is a licence's whole wording.
TEMPLATES = [
    ("notice:apache-2.0", "licensed under the apache license[[ ,]] version 2.0"),
    ("notice:cc-by", "licensed under [[a]] [[the]] [[creative commons]] cc by {{version|2}}"),
    ("notice:cc-by-nc", "licensed under [[a]] [[the]] cc by nc {{version|2}}"),
    ("notice:cc-by-sa", "licensed under [[a]] [[the]] cc by sa {{version|2}}"),
    ("notice:cc-attribution", "licensed under [[a]] [[the]] creative commons attribution {{variant|4}} license"),
    ("notice:gpl", "licensed under the gnu [[lesser]] [[affero]] general public license version {{number|1}}"),
    ("notice:gpl-or-later", "you can redistribute it and or modify it under the terms of the gnu [[lesser]] [[affero]] general public license as published by the free software foundation either version {{number|1}} of the license or [[(at your option)]] any later version"),
    ("notice:mit", "[[this work is]] {{work|3}} [[released]] [[licensed]] [[available]] under the mit license"),
    ("notice:bsd", "[[this work is]] licensed under the {{clauses|3}} bsd license"),
    ("notice:mpl-2.0", "subject to the terms of the mozilla public license v 2.0"),
    ("notice:reserved", "copyright [[(c)]] {{years and holder|12}} all rights reserved"),
    ("notice:apache-2.0-disclaimer", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("notice:cc0", "to the extent possible under law {{holder|12}} has waived all copyright and related or neighboring rights to"),
    ("clause:mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("clause:isc-grant", "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("clause:bsd-grant", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("clause:bsd-endorsement", "neither the name of {{holder|12}} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("clause:zlib-disclaimer", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("text:mit", f"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software {MIT_DISCLAIMER}"),
    ("text:mit-0", f"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so {MIT_DISCLAIMER}"),
    ("text:unlicense", f"this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law {MIT_DISCLAIMER}"),
    ("text:isc", "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and {{holder|12}} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall {{holder|12}} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("text:bsd-2", f"{BSD_CONDITIONS} {BSD_DISCLAIMER}"),
    ("text:bsd-3", f"{BSD_CONDITIONS} [[3]] neither the name of {{{{holder|12}}}} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission {BSD_DISCLAIMER}"),
    ("text:zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions [[1]] the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required [[2]] altered source versions must be plainly marked as such and must not be misrepresented as being the original software [[3]] this notice may not be removed or altered from any source distribution"),
]

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Every byte that ends a word becomes a space; A-Z become a-z.
FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b < 0x30 or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split()


@dataclass
class Automaton:
    """arrows: for each state, a map of word to next states, next states by any word, and next states by none."""

    label: str
    arrows: list[dict[bytes, list[int]]]
    wild: list[list[int]]
    free: list[list[int]]
    final: int
    anchor: bytes
    bounded: int

    def __post_init__(self):
        first = self._closed({0})
        #: Words that can begin a match; None if any word can.
        self.starts = None if any(self.wild[s] for s in first) else {w for s in first for w in self.arrows[s]}

    def _closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for n in self.free[todo.pop()]:
                if n not in states:
                    states.add(n)
                    todo.append(n)
        return states

    def longest(self, words: list[bytes], at: int) -> int:
        """End of the longest accepted run that starts at word `at`; -1 if none."""
        states, end = self._closed({0}), -1
        for i in range(at, min(len(words), at + self.bounded)):
            w, step = words[i], set()
            for s in states:
                step.update(self.arrows[s].get(w, ()))
                if self.starts is None or w not in self.starts:
                    step.update(self.wild[s])
            if not step:
                break
            states = self._closed(step)
            if self.final in states:
                end = i + 1
        return end


def compile_template(label: str, markup: str) -> Automaton:
    """Optional regions may hold words only; regions don't nest."""
    arrows, wild, free, runs = [{}], [[]], [[]], [[]]

    def state() -> int:
        arrows.append({}), wild.append([]), free.append([])
        return len(arrows) - 1

    def wording(text: str, at: int) -> int:
        for w in words_of(text):
            n = state()
            arrows[at].setdefault(w, []).append(n)
            at = n
        return at

    at = bounded = 0
    for part in re.split(r"(\[\[.*?\]\]|\{\{.*?\}\})", markup):
        if part.startswith("[["):
            start = at
            at = wording(part[2:-2], at)
            if at != start:
                free[start].append(at)
                runs.append([])
            bounded += at - start
        elif part.startswith("{{"):
            most = int(part[2:-2].partition("|")[2] or 12)
            end, start = None, at
            steps = []
            for _ in range(most):
                n = state()
                wild[at].append(n)
                steps.append(n)
                at = n
            end = state()
            for n in steps:
                free[n].append(end)
            at = end
            bounded += most
            runs.append([])
        else:
            runs[-1] += words_of(part)
            at = wording(part, at)
            bounded += len(words_of(part))
    anchor = b" " + b" ".join(max(runs, key=lambda r: sum(map(len, r)))) + b" "
    return Automaton(label, arrows, wild, free, at, anchor, bounded)


def places(flat: bytes, run: bytes) -> Iterator[int]:
    """Numbers of the words at which a run of words begins; one pass over the text."""
    at = last = 0
    i = flat.find(run)
    while i >= 0:
        at += flat.count(b" ", last, i)
        last = i
        yield at
        i = flat.find(run, i + 1)


class LicenseScanner:
    def __init__(self, phrases=BASE_PHRASES, templates=TEMPLATES):
        self.phrases = [(b" " + b" ".join(words_of(p)) + b" ", len(words_of(p)), label) for p, label in phrases]
        self.automata = [compile_template(*t) for t in templates]

    def scan(self, text: str) -> tuple[int, list[tuple[str, int, int, bool]]]:
        """Words of the text, and hits (label, first word, end word, base?)."""
        words = words_of(text)
        flat = b" " + b" ".join(words) + b" "
        hits = []
        for phrase, n, label in self.phrases:
            hits += [(label, at, at + n, True) for at in places(flat, phrase)]
        for a in self.automata:
            tried = done = -1
            for at in places(flat, a.anchor):
                for k in range(max(tried + 1, at - a.bounded, 0), at + 1):
                    tried = k
                    if k >= done and (a.starts is None or words[k] in a.starts) and (end := a.longest(words, k)) > 0:
                        hits.append((a.label, k, end, False))
                        done = end
        return len(words), hits


HITS = "n_words long, hits array<struct<label string, start long, stop long, base boolean>>"


def license_scan(docs: DataFrame, text_col: str = "text", phrases=BASE_PHRASES, templates=TEMPLATES, out_col: str = "license_scan") -> DataFrame:
    """Adds a struct of n_words and hits: places of base phrases and the template matches."""
    prepare(docs.sparkSession)

    @F.pandas_udf(HITS)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = LicenseScanner(phrases, templates)
        for batch in batches:
            found = [scanner.scan(t) for t in batch]
            yield pd.DataFrame({
                "n_words": pd.Series([n for n, _ in found], dtype="int64"),
                "hits": pd.Series([[{"label": a, "start": b, "stop": c, "base": d} for a, b, c, d in h] for _, h in found], dtype=object),
            })

    return docs.withColumn(out_col, scan(text_or_empty(docs[text_col])))


def license_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The contract's columns. score is the share of the text's words that hits cover (overlaps count once at most 1)."""
    x = license_scan(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")))
    hits = F.col("license_scan.hits")
    base = F.filter(hits, lambda h: h["base"])
    covered = F.size(F.array_distinct(F.flatten(F.transform(hits, lambda h: F.sequence(h["start"], h["stop"] - 1)))))
    name = lambda hs: F.array_join(F.array_sort(F.array_distinct(F.transform(hs, lambda h: h["label"]))), ",")
    return x.select(
        "doc_id",
        F.col("license_scan.n_words").alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda h: h["start"])).alias("first_word"),
        F.array_max(F.transform(base, lambda h: h["start"])).alias("last_word"),
        name(base).alias("base_labels"),
        name(hits).alias("labels"),
        F.when(F.size(hits) == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), covered / F.col("license_scan.n_words"))).alias("score"),
    )
