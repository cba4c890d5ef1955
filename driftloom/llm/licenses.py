"""License scans with a positional rare-token index.

Licence notices are templates; their words are indexed with positions. One pass over all
documents counts in how many each licence word occurs, which gives its IDF. A second
pass takes, for each template, the document's words of highest IDF, intersects their
postings by relative position (an alignment is a template at an offset of the document,
and two of these words must agree on it), scores an alignment by the IDF of the template
words found in place, and keeps it if the template's mandatory key phrase stands there.

So many of the highest words are taken that an alignment of MIN_SCORE has at least two of
them in place: what is left of the template, and one word more, weigh less than that. No
alignment is lost, as the tests show by trying every offset.

Results for special cases: null and empty texts have no words, no labels and score 0;
equal rows have equal results; a null doc_id is passed on; further columns are ignored;
long texts are read whole; labels are a sorted set, and of alignments alike the best score
counts. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import over_texts, texts_of

# The phrases of the base, and notices as their licences word them.
PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
TEMPLATES = (
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so", "free of charge to any person obtaining a copy of this software and associated documentation"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache license version 2"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "distributed under the license is distributed on an as is basis"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license version 2 1 or later", "lesser general public license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license version 3", "affero general public license"),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", "affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "reproduce the above copyright notice this list of conditions"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "endorse or promote products derived from this software"),
    ("bsd", "use of this source code is governed by a bsd style license", "bsd style license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", "eclipse public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "distribute this software for any purpose with or without fee"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable"),
    ("bsl", "distributed under the boost software license version 1 0", "boost software license"),
    ("cc", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons"),
    ("cc", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived all copyright and related or neighboring rights"),
    ("ofl", "this font software is licensed under the sil open font license version 1 1", "sil open font license"),
    ("artistic", "you can redistribute it and or modify it under the terms of the artistic license 2 0", "artistic license"),
    ("wtfpl", "you just do what the fuck you want to", "do what the fuck you want to"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
)
#: Names in a line that says which licence holds, and their labels.
NAMES_OF = {"mit": "mit", "apache 2 0": "apache", "gpl 2 0": "gpl", "gpl 3 0": "gpl", "lgpl 2 1": "lgpl", "lgpl 3 0": "lgpl", "agpl 3 0": "agpl", "bsd 2 clause": "bsd", "bsd 3 clause": "bsd", "mpl 2 0": "mpl", "epl 2 0": "epl", "isc": "isc", "zlib": "zlib", "bsl 1 0": "bsl", "cc0 1 0": "cc", "cc by 4 0": "cc", "ofl 1 1": "ofl", "artistic 2 0": "artistic", "wtfpl": "wtfpl", "unlicense": "unlicense"}
TEMPLATES += tuple((label, f"spdx license identifier {name}", f"identifier {name}") for name, label in NAMES_OF.items())
#: An alignment needs this share of its template's IDF in place.
MIN_SCORE, EXACT = 0.5, 1e-9
#: ASCII letters in lower case; other ASCII but digits cuts words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
SPLIT = [(label, tuple(w.encode() for w in words.split()), tuple(w.encode() for w in key.split())) for label, words, key in TEMPLATES]
VOCABULARY = frozenset(w for _, words, _ in SPLIT for w in words)
BASE = [(tuple(w.encode() for w in words), label) for words, label in PHRASES.items()]


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8").translate(FOLD).split()


def document_frequency(docs: DataFrame) -> tuple[int, dict[bytes, int]]:
    """Number of documents, and in how many each licence word occurs. What comes to the
    driver is one number for each word of the templates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for batch in batches:
            for text in texts_of(batch):
                n.update(VOCABULARY.intersection(words_of(text)))
            n[b""] += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in n], pa.string()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])

    rows = docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r["word"].encode(): r["n"] for r in rows}
    return found.pop(b"", 0), found


class Index:
    """Places of the templates' words, and the IDF of all their words."""

    def __init__(self, total: int, frequency: dict[bytes, int]):
        self.idf = {w: max(math.log((total + 1) / (frequency.get(w, 0) + 0.5)), 1e-6) for w in VOCABULARY}
        #: (template, IDF of its words, their sum, offsets by falling IDF)
        self.templates = []
        for t, (_, words, _) in enumerate(SPLIT):
            worth = [self.idf[w] for w in words]
            self.templates.append((t, worth, sum(worth), sorted(range(len(words)), key=lambda k: (-worth[k], k))))

    def starts(self, t: int, places: dict[bytes, list[int]]) -> list[int]:
        """Offsets of the document at which a template may reach MIN_SCORE."""
        _, worth, whole, order = self.templates[t]
        words = SPLIT[t][1]
        there = [k for k in order if words[k] in places]
        left = sum(worth[k] for k in there)
        if left < MIN_SCORE * whole - EXACT:
            return []
        votes: Counter = Counter()
        for n, k in enumerate(there):
            # words from here on, and the highest one before, don't suffice any more
            if n and left + worth[there[0]] < MIN_SCORE * whole - EXACT:
                break
            votes.update([at - k for at in places[words[k]]])
            left -= worth[k]
        least = 2 if worth[order[0]] < MIN_SCORE * whole - EXACT else 1  # one word may do
        return [start for start, n in votes.items() if n >= least]

    def aligned(self, t: int, start: int, words: list[bytes]) -> float:
        """Share of a template's IDF in place at an offset; 0 without its key phrase."""
        _, template, key = SPLIT[t]
        _, worth, whole, _ = self.templates[t]
        low = max(0, start)
        place = words[low : max(0, start + len(template))]
        if not any(tuple(place[k : k + len(key)]) == key for k in range(len(place) - len(key) + 1)):
            return 0.0
        return sum(x for x, a, b in zip(worth[low - start :], template[low - start :], place, strict=False) if a == b) / whole

    def labels(self, words: list[bytes]) -> tuple[set[str], float]:
        """Labels of verified alignments, and the best share of IDF in place."""
        found, best = set(), 0.0
        some = VOCABULARY.intersection(words)
        if not some:
            return found, best
        places: dict[bytes, list[int]] = {}
        for t, (label, template, key) in enumerate(SPLIT):
            if not some.issuperset(key):
                continue  # without its key phrase no alignment is kept
            if not places:
                places = defaultdict(list)
                for at, w in enumerate(words):
                    if w in some:
                        places[w].append(at)
                places = dict(places)
            for start in self.starts(t, places):
                score = self.aligned(t, start, words)
                if score >= MIN_SCORE - EXACT:
                    found.add(label)
                    best = max(best, score)
        return found, round(min(best, 1.0), 6)


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(first word, label) of every place where a phrase stands."""
    out, at = [], -1
    while True:
        try:
            at = words.index(b"license", at + 1)
        except ValueError:
            return sorted(out)
        for phrase, label in BASE:
            first = at - len(phrase) + 1
            if first >= 0 and tuple(words[first : at + 1]) == phrase:
                out.append((first, label))


def scan(docs: DataFrame) -> DataFrame:
    total, frequency = document_frequency(docs)

    def make():
        index = Index(total, frequency)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            cols: list[list] = [[] for _ in range(7)]
            for text in texts_of(batch):
                words = words_of(text)
                base = base_places(words)
                own, score = index.labels(words)
                labels = {x for _, x in base}
                for c, x in zip(cols, (len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(labels)), ",".join(sorted(labels | own)), score), strict=True):
                    c.append(x)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=NAMES)

        return work

    return over_texts(docs.select("doc_id", "text"), make, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


NAMES = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
