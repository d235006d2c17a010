"""License scans with a generalised suffix automaton of licence tokens.

The templates' words make one suffix automaton (a separator token ends each template): usual
notices, and whole licences (the texts in `licences`, as published). A document's words stream
through it; the matching statistic of a word is the length of the longest run ending there that
some template holds. A run that can't grow is a match if it has MIN_RUN words; matches that
follow each other in the document and in one template, at most GAP words apart in both, are
chained into a span of that template, the chain that covers most words of all. A template whose
best span covers COVER of its words gives its label; score is the best cover of any label.

A match of MIN_RUN words or more consists of runs of MIN_RUN words that some template holds, so
only stretches of these are streamed.

Base: places where a phrase's words stand consecutively. Words are runs of ASCII letters
and digits and of all characters above ASCII, with A-Z lower-cased.

Defined cases. Null counts as empty: no words, no labels (empty strings), score 0. A base
phrase gives score 1. Repeated rows are scanned each; other columns are no input. Empty
tables give an empty result.
"""

from __future__ import annotations

import re
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidlake.llm.common import find_words, hash_words, shingle_hashes, text_slices

MIN_RUN, GAP, COVER = 3, 12, 0.7
#: Base phrases and labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Usual notices of public licences, by label; a label may have several.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www.apache.org licenses license-2.0"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required 2 altered source versions must be plainly marked as such and must not be misrepresented as being the original software 3 this notice may not be removed or altered from any source distribution"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("gpl-2.0", "licensed under the gnu general public license version 2"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl-3.0", "licensed under the gnu affero general public license version 3"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v. 2.0"),
    ("cc-by-4.0", "licensed under cc by 4.0"),
    ("cc-by-sa-4.0", "licensed under cc by-sa 4.0"),
    ("cc-by-nc-4.0", "licensed under cc by-nc 4.0"),
    ("cc-by-nd-4.0", "licensed under cc by-nd 4.0"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4.0 international license"),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution-sharealike 4.0 international license"),
    ("cc-by-nc-4.0", "this work is licensed under a creative commons attribution-noncommercial 4.0 international license"),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced distributed or transmitted in any form or by any means"),
]
#: Labels of the whole licences in the folder `licences`, by file.
WHOLE = {"Apache-2.0": "apache-2.0", "Artistic": "artistic", "BSD": "bsd", "CC0-1.0": "cc0-1.0", "GPL-2": "gpl-2.0", "GPL-3": "gpl-3.0", "LGPL-2.1": "lgpl", "LGPL-3": "lgpl", "MPL-2.0": "mpl-2.0"}
SCANNED = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long,cover:double>>"
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_GAPS = np.ones(256, bool)
_GAPS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_built: dict = {}


def templates() -> list[tuple[str, str]]:
    """Notices and whole licences: (label, text)."""
    folder = Path(__file__).with_name("licences")
    return [*TEMPLATES, *((label, (folder / f"{name}.txt").read_text()) for name, label in WHOLE.items())]


def tokens(text: str) -> list[str]:
    return _WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))


def _hashes(words: list[str]) -> np.ndarray:
    if not words:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends, _ = find_words(data, np.array([0, len(data)]), _GAPS)
    return hash_words(data, starts, ends, fold=True)


class Automaton:
    """Suffix automaton of all templates; each state knows the first place where its runs end."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.labels = [label for label, _ in templates]
        self.words = [tokens(t) for _, t in templates]
        vocab = sorted({w for t in self.words for w in t})
        hashes = _hashes(vocab)
        order = np.argsort(hashes)
        self.known, self.number = hashes[order], order.astype(np.int64)
        at = {w: i for i, w in enumerate(vocab)}
        self.next, self.link, self.length, self.ends = [{}], [-1], [0], [set()]
        last = 0
        for t, words in enumerate(self.words):
            for k, w in enumerate(words):
                last = self._add(last, at[w], (t, k))
            last = self._add(last, -1 - t, None)  # a separator of its own
        # a state's runs also end wherever those of the states below it do; runs under MIN_RUN are never asked for
        for s in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if self.length[self.link[s]] >= MIN_RUN:
                self.ends[self.link[s]] |= self.ends[s]
        self.ends = [sorted(x) for x in self.ends]
        self.runs = np.unique(np.concatenate([shingle_hashes(_hashes(words), MIN_RUN) for words in self.words]))

    def stretches(self, words: np.ndarray) -> list[tuple[int, int]]:
        """Where every MIN_RUN words are in some template: first word and word after the last."""
        grams = shingle_hashes(words, MIN_RUN)
        if not len(grams):
            return []
        at = np.minimum(np.searchsorted(self.runs, grams), len(self.runs) - 1)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (self.runs[at] == grams).view(np.int8), [0]])))
        return [(int(s), int(e) + MIN_RUN - 1) for s, e in zip(edge[::2], edge[1::2], strict=True)]

    def _add(self, last: int, c: int, place) -> int:
        cur = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        self.ends.append({place} if place else set())
        p = last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p != -1:
            q = self.next[p][c]
            if self.length[q] == self.length[p] + 1:
                self.link[cur] = q
            else:
                clone = len(self.next)
                self.next.append(dict(self.next[q]))
                self.length.append(self.length[p] + 1)
                self.link.append(self.link[q])
                self.ends.append(set())
                while p != -1 and self.next[p].get(c) == q:
                    self.next[p][c] = clone
                    p = self.link[p]
                self.link[q] = self.link[cur] = clone
        return cur

    def known_words(self, hashes: np.ndarray) -> np.ndarray:
        """The words' numbers, -1 for words that no template has."""
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, self.number[at], -1)

    def matches(self, words: list[int], first: int) -> list[tuple[int, int, int]]:
        """Runs that can't grow: (first word, length, state)."""
        out, state, n = [], 0, 0
        for k, w in enumerate(words):
            grown = w in self.next[state]
            if not grown and n >= MIN_RUN:
                out.append((first + k - n, n, state))
            while state and w not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if w in self.next[state]:
                state, n = self.next[state][w], n + 1
        if n >= MIN_RUN:
            out.append((first + len(words) - n, n, state))
        return out

    def spans(self, matches: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """Covered spans: label, first word, word after the last, cover."""
        by: dict[int, list] = {}
        for start, n, state in matches:
            for t, end in self.ends[state]:
                by.setdefault(t, []).append((start, end - n + 1, n))
        out = []
        for t, found in by.items():
            chains, first = [], 0  # in order: first word, end in the document, end in the template, words covered, whether a longer chain has it
            for start, at, n in sorted(found):
                while first < len(chains) and chains[first][5] < start - GAP:
                    first += 1
                best, most = None, n
                for c in chains[first:]:
                    over = max(0, c[1] - start)  # words that both hold count once
                    if c[0] <= start and over < n and start + over <= c[1] + GAP and c[2] <= at + over <= c[2] + GAP and n - over + c[3] > most:
                        best, most = c, n - over + c[3]
                if best is not None:
                    best[4] = True
                end = start + n
                chains.append([best[0] if best else start, end, at + n, most, False, max(end, chains[-1][5] if chains else end)])
            for c in chains:
                if not c[4] and c[3] >= COVER * len(self.words[t]):
                    out.append((self.labels[t], c[0], c[1], c[3] / len(self.words[t])))
        return sorted(set(out))


def automaton(texts: list[tuple[str, str]] | None = None) -> Automaton:
    """The automaton of the given templates, or of the notices and whole licences; the last one is kept."""
    texts = templates() if texts is None else texts
    if _built.get("of") != texts:
        _built["of"], _built["a"] = texts, Automaton(texts)
        _built["base"] = [(_hashes(p.split()), label) for p, label in BASE.items()]
    return _built["a"]


def scan(words: np.ndarray, a: Automaton) -> tuple:
    """The result for one document's word hashes."""
    places, base = [], set()
    for phrase, label in _built["base"]:
        m = len(words) - len(phrase) + 1
        if m > 0:
            hit = np.ones(m, bool)
            for k, h in enumerate(phrase):
                hit &= words[k : k + m] == h
            if hit.any():
                places.append(np.flatnonzero(hit))
                base.add(label)
    found = []
    for s, e in a.stretches(words):
        found += a.matches(a.known_words(words[s:e]).tolist(), s)
    spans = a.spans(found)
    every = np.concatenate(places) if places else np.zeros(0, np.int64)
    labels = base | {s[0] for s in spans}
    score = 1.0 if base else max((s[3] for s in spans), default=0.0)
    return len(words), len(every), int(every.min()) if len(every) else None, int(every.max()) if len(every) else None, ",".join(sorted(base)), ",".join(sorted(labels)), min(1.0, score), [{"label": x[0], "start": x[1], "end": x[2], "cover": x[3]} for x in spans]


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """Base counts, labels, score and covered spans for each row of docs; texts: other templates, as (label, text)."""
    texts = templates() if texts is None else texts

    def run(batches):
        import pyarrow as pa

        a = automaton(texts)
        span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cover", pa.float64())]))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), span]
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        for batch in batches:
            rows = []
            for _, bounds, data in text_slices(batch.column(1)):
                starts, ends, first = find_words(data, bounds, _GAPS)
                words = hash_words(data, starts, ends, fold=True)
                rows += [scan(words[first[i] : first[i + 1]], a) for i in range(len(bounds) - 1)]
            cols = list(zip(*rows, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(cols, types, strict=True))], ["id", *names])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, {SCANNED}").withColumnRenamed("id", id_col)
