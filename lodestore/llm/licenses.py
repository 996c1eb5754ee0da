"""License scans: a positional rare-token index.

Each notice is a template of words with phrases that it must have. The index has postings of every template word: in
which templates it stands, and at which places. A first pass counts, over all documents, in how many each word occurs,
which orders the words by rarity. A second one takes each file's rarest licence words, looks their postings up, and
intersects, for each template that has all words of its phrases in the file, where the template would have to begin:
the words of its first phrase agree on one beginning, or it isn't there. Where the postings of enough of the other words
agree with that beginning, the phrases are verified word for word. Rarity decides what is looked up first, never what is
found.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.llm import common
from lodestore.llm.near_dedup import word_hashes

#: Share of a template's words that have to be where they belong, and places by which each may be off.
MIN_SHARE, SLACK = 0.7, 2

_GNU = "this program is free software you can redistribute it and or modify it under the terms of the gnu {0}general public license as published by the free software foundation either version {1} of the license or at your option any later version"
_WARRANTY = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"

#: What follows CC in a licence's name, and in words.
_CC = {"BY": "attribution", "BY-SA": "attribution sharealike", "BY-NC": "attribution noncommercial", "BY-ND": "attribution noderivatives", "BY-NC-SA": "attribution noncommercial sharealike", "BY-NC-ND": "attribution noncommercial noderivatives"}
#: Licences found by their SPDX identifiers.
_SPDX = ["Apache-2.0", "MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", *(f"CC-{code}-4.0" for code in _CC), "CC0-1.0", "Unlicense"]

#: (licence, words, phrases that a match must have); words are runs of letters and digits in lower case.
TEMPLATES: list[tuple[str, str, tuple[str, ...]]] = [
    ("Apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("Apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", ("apache license version 2 0", "except in compliance with the license")),
    ("MIT", "released under the mit license", ("mit license",)),
    ("MIT", "licensed under the mit license", ("mit license",)),
    ("MIT", f"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software {_WARRANTY}", ("permission is hereby granted free of charge", "to deal in the software without restriction")),
    ("BSD-3-Clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("redistribution and use in source and binary forms", "to endorse or promote products")),
    ("BSD-2-Clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ("redistribution and use in source and binary forms", "redistributions in binary form must reproduce")),
    ("ISC", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("with or without fee is hereby granted",)),
    *(
        (f"{name}-{v.replace(' ', '.') if ' ' in v else v + '.0'}", text, phrases)
        for name, long, spoken, versions in (("GPL", "", "gnu general public license", "2 3"), ("LGPL", "lesser ", "gnu lesser general public license", "2 2.1 3"), ("AGPL", "affero ", "gnu affero general public license", "2 3"))
        for v in (x.replace(".", " ") for x in versions.split())
        for text, phrases in (
            (f"this work is licensed under the {spoken} version {v}", (f"{spoken} version {v}",)),
            (f"released under the {spoken} version {v}", (f"{spoken} version {v}",)),
            (_GNU.format(long, v), (f"{spoken} as published by", f"either version {v} of the license")),
        )
    ),
    ("MPL-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    *((f"CC-{code}-4.0", f"this work is licensed under a creative commons {words} 4 0 international license", (f"creative commons {words} 4 0 international",)) for code, words in _CC.items()),
    *((f"CC-{code}-4.0", f"licensed under {short}", (short,)) for code in _CC for short in [f"cc {code.lower().replace('-', ' ')} 4 0"]),
    ("CC0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related or neighboring rights",)),
    ("Unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
    *((name, f"{verb} under the {short} license", (f"{short} license",)) for name, short in (("BSD", "bsd"), ("BSD-2-Clause", "bsd 2 clause"), ("BSD-3-Clause", "bsd 3 clause")) for verb in ("licensed", "released")),
    ("BSD", "use of this source code is governed by a bsd style license", ("bsd style license",)),
    *((name, text, (text,)) for name in _SPDX for text in [f"spdx license identifier {re.sub('[^a-z0-9]', ' ', name.lower())}"]),
]

FOUND = "doc_id long, license string, start long, words long, share double"


class Index:
    """Postings (template, place) of the words of all templates; ``rank`` orders words by rarity."""

    def __init__(self, templates: list[tuple[str, str, tuple[str, ...]]] = TEMPLATES):
        words = sorted({w for _, text, phrases in templates for w in " ".join([text, *phrases]).split()})
        if not all(re.fullmatch("[a-z0-9]+", w) for w in words):
            raise ValueError("template words are runs of letters and digits in lower case")
        raw = np.frombuffer(" ".join(words).encode(), np.uint8)
        hashes, _ = word_hashes(raw, np.zeros(1, np.int64), np.array([len(raw)]))
        self.words = words
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        at = {w: i for i, w in enumerate(words)}
        self.templates = [(name, np.array([at[w] for w in text.split()]), [np.array([at[w] for w in p.split()]) for p in phrases]) for name, text, phrases in templates]
        self.postings: dict[int, list[tuple[int, int]]] = {}
        #: Where each template's first phrase stands in it, and the words of all its phrases.
        self.head: list[int] = []
        self.needed: list[np.ndarray] = []
        for t, (name, text, phrases) in enumerate(self.templates):
            if not phrases or any(not len(_occurrences(text, p)) for p in phrases):
                raise ValueError(f"the template of {name} lacks its phrases")
            for place, w in enumerate(text.tolist()):
                self.postings.setdefault(w, []).append((t, place))
            self.head.append(int(_occurrences(text, phrases[0])[0]))
            self.needed.append(np.unique(np.concatenate(phrases)))
        self.rank(np.zeros(len(words), np.int64))

    def rank(self, documents: np.ndarray) -> Index:
        """Orders words by the documents that have them, rare ones first; equally common ones by the alphabet."""
        self.rarity = np.empty(len(self.words), np.int64)
        self.rarity[np.lexsort((np.arange(len(self.words)), documents[: len(self.words)]))] = np.arange(len(self.words))
        # a template is looked up by the rarest word of its first phrase
        self.asked: dict[int, list[int]] = {}
        for t, (_, _, phrases) in enumerate(self.templates):
            self.asked.setdefault(int(min(phrases[0], key=self.rarity.__getitem__)), []).append(t)
        self.lookups = np.zeros(len(self.words) + 1, bool)
        self.lookups[list(self.asked)] = True
        return self

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word that is in a template, -1 for others."""
        i = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[i] == hashes, self.order[i], -1)

    def scan(self, doc: np.ndarray) -> list[tuple[str, int, int, float]]:
        """(licence, first word, words, share) of what ``doc``, an array of ``known``, has of licences."""
        at = np.flatnonzero(doc >= 0)
        order = at[np.argsort(doc[at], kind="stable")]
        own, first = np.unique(doc[order], return_index=True)
        places = dict(zip(own.tolist(), np.split(order, first[1:]), strict=True))
        found = []
        for word in sorted((w for w in places if self.lookups[w]), key=self.rarity.__getitem__):
            for t in self.asked[word]:
                if all(w in places for w in self.needed[t].tolist()):
                    found += self._matches(doc, t, places)
        return self._settle(found)

    def _starts(self, t: int, places: dict[int, np.ndarray]) -> np.ndarray:
        """Where template ``t`` would begin by the postings of its first phrase, the rarest word first."""
        phrase, starts = self.templates[t][2][0], None
        for k in sorted(range(len(phrase)), key=lambda k: self.rarity[phrase[k]]):
            own = places[int(phrase[k])] - (self.head[t] + k)
            starts = own if starts is None else starts[np.isin(starts, own, assume_unique=True)]
            if not len(starts):
                break
        return starts

    def _matches(self, doc: np.ndarray, t: int, places: dict[int, np.ndarray]) -> list[tuple[int, int, int, int]]:
        """(minus the words that agree, first word, end, template) of every place where ``t`` stands."""
        _, text, phrases = self.templates[t]
        starts = self._starts(t, places)
        if not len(starts):
            return []
        # the place nearest to its own at which each word stands, 0 to 2 * SLACK by closeness, else none
        offs = sorted(range(-SLACK, SLACK + 1), key=lambda x: (abs(x), x))
        begin, end, agree = np.full(len(starts), -1), np.full(len(starts), -1), np.zeros(len(starts), np.int64)
        for place, word in enumerate(text.tolist()):
            own = places.get(word)
            if own is None:
                continue
            want, hit = starts + place, np.full(len(starts), -1)
            for off in offs:
                i = np.minimum(np.searchsorted(own, want + off), len(own) - 1)
                hit = np.where((hit < 0) & (own[i] == want + off), want + off, hit)
            agree += hit >= 0
            begin = np.where((begin < 0) & (hit >= 0), hit, begin)
            end = np.maximum(end, hit)
        good = agree >= MIN_SHARE * len(text)
        for p in phrases[1:]:
            if good.any():
                own = _occurrences(doc, p)
                i = np.searchsorted(own, starts - SLACK)
                good &= np.append(own, len(doc) + len(text) + SLACK)[i] + len(p) <= starts + len(text) + SLACK
        return [(-int(agree[i]), int(begin[i]), int(end[i]) + 1, t) for i in np.flatnonzero(good)]

    def _settle(self, found: list[tuple[int, int, int, int]]) -> list[tuple[str, int, int, float]]:
        """Of overlapping matches the one with more words stays, then the earlier one, then the first template."""
        starts: list[int] = []
        kept: dict[int, tuple[int, int, int]] = {}
        for n, a, z, t in sorted(set(found), key=lambda x: (x[0], x[1], x[3])):
            i = bisect(starts, a)
            if (i == 0 or kept[starts[i - 1]][0] <= a) and (i == len(starts) or z <= starts[i]):
                starts.insert(i, a)
                kept[a] = z, t, -n
        return [(self.templates[t][0], a, z - a, n / len(self.templates[t][1])) for a in starts for z, t, n in [kept[a]]]


def _occurrences(doc: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """The places at which ``phrase`` stands word for word in ``doc``."""
    n = len(doc) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.all([doc[i : i + n] == w for i, w in enumerate(phrase)], axis=0))


def _numbers(index: Index, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The words of a batch's texts as numbers of the index, and the number of words of each text."""
    hashes, n = word_hashes(*common.utf8_buffer(batch.column(1)))
    return index.known(hashes), n


def document_counts(rows: DataFrame, index: Index) -> np.ndarray:
    """In how many of all documents each template word occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(index.words), np.int64)
        for b in batches:
            known, n = _numbers(index, b)
            doc = np.repeat(np.arange(len(n)), n)[known >= 0]
            pairs = np.unique(doc * len(index.words) + known[known >= 0])
            total += np.bincount(pairs % len(index.words), minlength=len(index.words))
        yield pa.record_batch([pa.array(np.arange(len(total))), pa.array(total)], names=["word", "n"])

    # a row for each template word
    counts = rows.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(index.words), np.int64)
    for r in counts:
        out[r.word] = r.n
    return out


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str, tuple[str, ...]]] = TEMPLATES) -> DataFrame:
    """doc_id, license, start and words (in words of the text) and share, a row for every licence found.

    A template stands where its first phrase does, word for word, if its other phrases do so up to SLACK words beyond
    its ends and MIN_SHARE of its words stand within SLACK of their places. ``start`` and ``words`` reach from the first
    of those words to the last one, and ``share`` is how many of the template's words they are. Case and punctuation
    don't count. Of overlapping matches the one with more words is reported, then the earlier, then the first template.
    Null, empty and other texts without a licence give no row; identifiers are whole numbers of 64 bits, null ones are
    reported as null; repeated rows are reported as often as they come. Other columns are ignored. No rows give no rows.
    """
    common.bound_batches(df.sparkSession)
    rows = common.pick(df, doc_id=id_col, text=text_col).filter("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"))
    index = Index(templates)
    index.rank(document_counts(rows, index))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known, n = _numbers(index, b)
            end = np.cumsum(n)
            asked = np.flatnonzero(index.lookups[known])
            out = []
            for d in np.unique(np.searchsorted(end, asked, side="right")):
                doc = b.column(0)[int(d)].as_py()
                out += [(doc, *x) for x in index.scan(known[end[d] - n[d] : end[d]])]
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["doc_id", "license", "start", "words", "share"])

    return rows.mapInArrow(run, FOUND)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences in every document of ``documents``."""
    return scan_licenses(common.table(spark, sf_dir, "documents"))
