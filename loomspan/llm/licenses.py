"""Licence scans: matching statistics against a generalised suffix automaton of licence texts, chained into spans.

Words of the lower-cased (A-Z) text are runs of letters, digits and non-ASCII characters. The automaton holds the
word sequences of all templates, notices (NOTICES) and whole licences (the files of licence_texts); streaming a document through
it gives, at each word, the longest suffix that occurs in some template, and its suffix links the longest one in every
other template. Each template's right-maximal matches of at least `least` words are chained in order, allowing gaps of at
most `gap` words (three times as many in whole licences), into covered spans; a template whose span covers at least `share` of it is found. Of whole licences that
are found in one place, which share long parts, those that cover most of it give their labels. A notice gives its
label if the span has the words that tell the label from its relatives (TELLING). The automaton is a fixed size and each
worker builds it once; documents are streamed whole.

Base labels come from exact phrases and always stay. score is the largest share of a template covered, 1.0 with a
base label. Defined cases: null text is empty; repeated rows are rows of their own; input columns named like an output
column are replaced.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from importlib.resources import files

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.llm.common import chunks, free_name, ship, text_bytes

LEAST, GAP, SHARE = 4, 8, 0.6

# The phrases of the base labels and the notices of the method's labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("mit", "released under the mit license"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation"),
    ("gpl-2", "this work is licensed under the gnu general public license version 2"),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl-3", "under the terms of the gnu affero general public license as published by the free software foundation version 3"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "licensed under the bsd 3 clause license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "no part of this publication may be reproduced without permission all rights reserved"),
)
#: The whole licences, by file and label.
TEXTS = {
    "MIT": "mit", "Apache-2.0": "apache-2", "GPL-2": "gpl-2", "GPL-3": "gpl-3", "LGPL-2.1": "lgpl", "LGPL-3": "lgpl", "BSD": "bsd", "ISC": "isc",
    "MPL-2.0": "mpl-2", "CC0-1.0": "cc0", "Unlicense": "unlicense", "Zlib": "zlib", "Artistic": "artistic", "GFDL-1.3": "gfdl",
}
#: Of each label: phrases of which a span must have one, and those that must not be in it or the two words after it.
TELLING = {
    "apache-2": (("version 2",), ()),
    "gpl-3": (("version 3",), ("lesser", "affero")),
    "gpl-2": (("version 2",), ("lesser", "affero")),
    "lgpl": (("lesser",), ()),
    "agpl-3": (("affero",), ()),
    "mpl-2": (("2 0",), ()),
    "cc-by": ((), ("sharealike", "share alike", "noncommercial", "non commercial", "noderivatives", "noderivs", "sa", "nc", "nd")),
    "cc-by-sa": (("sharealike", "share alike", "by sa"), ("noncommercial", "non commercial", "nc")),
    "cc-by-nc": (("noncommercial", "non commercial", "by nc"), ()),
}

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def whole_licences() -> tuple[tuple[str, str], ...]:
    """(label, words) of each whole licence."""
    folder = files("loomspan.llm") / "licence_texts"
    return tuple((label, b" ".join(words_of((folder / f"{name}.txt").read_bytes())).decode()) for name, label in TEXTS.items())


#: Notices first, then whole licences.
TEMPLATES = NOTICES + whole_licences()


class Automaton:
    """Generalised suffix automaton over word sequences; every state knows where its matches end in each template."""

    def __init__(self, templates: tuple[tuple[str, str], ...]):
        self.templates = [(label, text.encode().split()) for label, text in templates]
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for t, (_, words) in enumerate(self.templates):
            last = 0
            for at, w in enumerate(words):
                last = self._extend(last, w)
                self.ends[last].add((t, at))
        for s in sorted(range(1, len(self.length)), key=lambda s: -self.length[s]):
            self.ends[self.link[s]] |= self.ends[s]
        self.stops: list[dict[int, list[int]]] = [{} for _ in self.ends]
        for s, ends in enumerate(self.ends):
            for t, at in sorted(ends):
                self.stops[s].setdefault(t, []).append(at)
        self.words = frozenset(w for _, words in self.templates for w in words)

    def _state(self, length: int, link: int, after: dict[bytes, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(after)
        self.ends.append(set())
        return len(self.length) - 1

    def _split(self, p: int, q: int, w: bytes) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: bytes) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, w)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        return new

    def matches(self, words: list[bytes], start: int, end: int, least: int) -> Iterator[tuple[int, int, int]]:
        """(last word, length, state) of the right-maximal matches of at least `least` words in words[start:end]."""
        state = length = 0
        for i in range(start, end):
            w, before = words[i], (i - 1, length, state)
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if w in self.next[state]:
                state, length = self.next[state][w], length + 1
            if before[1] >= least and length <= before[1]:
                yield before
        if length >= least:
            yield end - 1, length, state

    def own_matches(self, words: list[bytes], start: int, end: int, least: int) -> Iterator[tuple[int, int, int, int]]:
        """(last word, length, state, template) of each template's own right-maximal matches in words[start:end]."""
        state = length = 0
        before: dict[int, tuple[int, int]] = {}
        for i in range(start, end + 1):
            now: dict[int, tuple[int, int]] = {}
            if i < end:
                w = words[i]
                while state and w not in self.next[state]:
                    state = self.link[state]
                    length = self.length[state]
                if w in self.next[state]:
                    state, length = self.next[state][w], length + 1
                s, n = state, length
                while n >= least:
                    for t in self.stops[s]:
                        now.setdefault(t, (n, s))
                    s = self.link[s]
                    n = self.length[s]
            for t, (n, s) in before.items():
                if t not in now or now[t][0] <= n:
                    yield i - 1, n, s, t
            before = now

    def spans(self, words: list[bytes], least: int = LEAST, gap: int = GAP) -> list[tuple[int, int, int, float]]:
        """(template, first word, end word, share of the template covered) of chained matches, best chain per place."""
        inside = [w in self.words for w in words]
        open_chains: dict[int, tuple[int, int, int, int]] = {}  # template: first word, end word, end in template, covered
        done: list[tuple[int, int, int, int]] = []
        at = 0
        while at < len(words):
            if not inside[at]:
                at += 1
                continue
            end = at
            while end < len(words) and inside[end]:
                end += 1
            if end - at >= least:
                for last, length, state, t in self.own_matches(words, at, end, least):
                    stops, first, old = self.stops[state][t], last - length + 1, open_chains.get(t)
                    near = gap if t < len(NOTICES) else 3 * gap
                    if old and first - old[1] <= near and stops[-1] > old[2]:
                        stop = stops[bisect_right(stops, old[2])]  # the nearest place behind the chain
                        if stop - old[2] > last + 1 - old[1] + 3 * near and length < near:
                            continue  # a phrase of a later part
                        fresh = min(last + 1 - max(first, old[1]), stop - old[2])
                        open_chains[t] = (old[0], last + 1, stop, old[3] + max(0, fresh))
                    elif not old or length > old[3] or first - old[1] > near:
                        if old:
                            done.append((t, old[0], old[1], old[3]))
                        open_chains[t] = (first, last + 1, stops[0], length)
            at = end
        done += [(t, c[0], c[1], c[3]) for t, c in open_chains.items()]
        return [(t, a, b, min(1.0, n / len(self.templates[t][1]))) for t, a, b, n in done]


_AUTOMATA: dict[tuple, Automaton] = {}


def automaton(templates: tuple[tuple[str, str], ...] = TEMPLATES) -> Automaton:
    """The worker's automaton, kept from task to task."""
    if templates not in _AUTOMATA:
        _AUTOMATA[templates] = Automaton(templates)
    return _AUTOMATA[templates]


def _tells(label: str, words: list[bytes], first: int, end: int) -> bool:
    """Whether a span fits the label and none of its relatives, whose words may come right after it."""
    needed, barred = TELLING.get(label, ((), ()))
    own, more = (b" %s " % b" ".join(words[first:e]) for e in (end, end + 2))
    return (not needed or any(b" %s " % x.encode() in own for x in needed)) and not any(b" %s " % x.encode() in more for x in barred)


def scan_text(text: bytes, templates: tuple = TEMPLATES, phrases: dict[str, str] = PHRASES, share: float = SHARE) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, spans of one text."""
    words = words_of(text)
    places, base, there = [], set(), set(words)
    for phrase, label in phrases.items():
        seq = phrase.encode().split()
        rare = max(seq, key=len)
        if rare not in there:
            continue
        off, n = seq.index(rare), len(seq)
        hits = [i - off for i, w in enumerate(words) if w == rare and i >= off and words[i - off : i - off + n] == seq]
        places += hits
        base |= {label} if hits else set()
    found = [s for s in automaton(templates).spans(words) if s[3] >= share]
    notices = [s for s in found if s[0] < len(NOTICES) and _tells(templates[s[0]][0], words, s[1], s[2])]
    whole = _leading([s for s in found if s[0] >= len(NOTICES)], templates)
    # a paragraph that licences share is not a notice of another one inside a whole licence
    found = whole + [n for n in notices if not any(w[1] <= n[1] and n[2] <= w[2] and templates[w[0]][0] != templates[n[0]][0] for w in whole)]
    labels = base | {templates[s[0]][0] for s in found}
    score = 1.0 if base else max((s[3] for s in found), default=0.0)
    spans = [{"label": templates[t][0], "first": a, "end": b, "share": c} for t, a, b, c in sorted(found, key=lambda s: s[1:3])]
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), float(score), spans


def _leading(found: list[tuple], templates: tuple) -> list[tuple]:
    """Whole licences without those of which another one covers more words, in a span that overlaps half of theirs."""
    covered = {s: s[3] * len(templates[s[0]][1].split()) for s in found}
    ranked, out = sorted(found, key=lambda s: (-covered[s], s)), []
    for s in ranked:
        if not any(2 * (min(s[2], o[2]) - max(s[1], o[1])) > s[2] - s[1] and templates[o[0]][0] != templates[s[0]][0] for o in out):
            out.append(s)
    return out


NEW = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,end:long,share:double>>"


def scan(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, templates: tuple = TEMPLATES, phrases: dict[str, str] = PHRASES, share: float = SHARE) -> DataFrame:
    """`keep` columns (default: all but the text) with the scan's columns; input columns of these names are replaced.

    The first len(NOTICES) templates are notices, the others whole licences.
    """
    ship(__name__)
    new = T.StructType.fromDDL(NEW)
    keep = [c for c in (keep if keep is not None else docs.columns) if c in docs.columns and c != text_col and c.lower() not in new.names]
    inner = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias(free_name(docs, "_text")))
    schema = T.StructType([*inner.schema.fields[:-1], *new.fields])
    span = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("share", pa.float64())]))
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), span]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, len(keep)):
                got = list(zip(*(scan_text(t, templates, phrases, share) for t in text_bytes(part.column(len(keep))))))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array(c, k) for c, k in zip(got, kinds))], names=schema.names)

    return inner.mapInArrow(run, schema)
