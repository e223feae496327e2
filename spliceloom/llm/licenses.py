"""License scans: template-markup matching.

A template is license wording with two kinds of markup: ``<<beginOptional>> ... <<endOptional>>``
may be left out, and ``<<var;max=N>>`` stands for 0 to N arbitrary words. A template is compiled
into a token automaton whose states are positions between words; it accepts a stretch of words
whose mandatory wording is exactly the template's. The automaton runs as a bit-parallel NFA, one
integer of states per word, and only from places where the template's first words stand.

Words: A-Z lower-cased, then ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` over the whole text (in UTF-8: runs
of 0-9, a-z and bytes over 0x7F, so scanning bytes gives the same words).

Defined results: null and empty texts have no words, no labels and score 0. Overlapping phrases
all count. Other columns are ignored. Every input row gives one row, repeated ids included.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame

from spliceloom.llm.textio import documents, per_document

#: Phrases whose places count, and their labels.
PHRASES: tuple[tuple[str, str], ...] = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)

#: (label, template). Wording follows the public license texts and their usual notices.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
     documentation files <<beginOptional>>(the "Software")<<endOptional>>, to deal in the Software without restriction, including
     without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
     and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright
     notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies
     or substantial portions of the Software."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
     following conditions are met: <<var;max=3>> Redistributions of source code must retain the above copyright notice, this list of
     conditions and the following disclaimer. <<var;max=3>> Redistributions in binary form must reproduce the above copyright notice,
     this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
     <<beginOptional>><<var;max=3>> Neither the name of <<var;max=12>> may be used to endorse or promote products derived from this
     software without specific prior written permission.<<endOptional>>"""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
     provided that the above copyright notice and this permission notice appear in all copies."""),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 <<beginOptional>>(the "License"); you may not use this file except
     in compliance with the License.<<endOptional>>"""),
    ("mit", "<<beginOptional>>This <<var;max=3>> is<<endOptional>> Released under the <<beginOptional>>terms of the<<endOptional>> MIT License."),
    ("mit", "Licensed under the <<beginOptional>>terms of the<<endOptional>> MIT License."),
    ("gpl-notice", """This <<var;max=3>> is <<beginOptional>>free software: you can redistribute it and/or modify it under the terms of
     the<<endOptional>> <<beginOptional>>licensed under the<<endOptional>> GNU <<beginOptional>>Lesser<<endOptional>>
     <<beginOptional>>Affero<<endOptional>> General Public License <<beginOptional>>as published by the Free Software
     Foundation<<endOptional>>, <<beginOptional>>either<<endOptional>> version <<var;max=1>>"""),
    ("cc-notice", """Licensed under <<beginOptional>>a<<endOptional>> CC BY <<beginOptional>>NC<<endOptional>>
     <<beginOptional>>ND<<endOptional>> <<beginOptional>>SA<<endOptional>> <<var;max=2>>"""),
    ("cc-notice", """licensed under a Creative Commons Attribution <<var;max=3>> <<beginOptional>>International<<endOptional>> License"""),
    ("spdx-tag", "SPDX License Identifier: <<var;max=4>>"),
)

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_TABLE = bytes(b if chr(b).isdigit() and b < 128 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_MARK = re.compile(r"<<\s*(beginOptional|endOptional|var)[^>]*?(?:max\s*=\s*(\d+))?\s*>>")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class TokenAutomaton:
    """A template's NFA. State i: the next word to read is item i; the last state accepts.

    Items are mandatory or optional words and wildcards of one word each; ``skip[i]`` holds the
    states reached from i without reading. Wildcards read any word.
    """

    def __init__(self, template: str, var_max: int = 8):
        items: list[bytes | None] = []
        spans: list[tuple[int, int]] = []  # stretches of items that may be left out
        opened: list[int] = []
        at = 0
        for m in [*_MARK.finditer(template), None]:
            items += words_of(template[at : m.start() if m else len(template)])
            if not m:
                break
            at = m.end()
            if m[1] == "beginOptional":
                opened.append(len(items))
            elif m[1] == "endOptional":
                if not opened:
                    raise ValueError("endOptional without beginOptional")
                spans.append((opened.pop(), len(items)))
            else:
                for _ in range(int(m[2] or var_max)):
                    spans.append((len(items), len(items) + 1))
                    items.append(None)
        if opened:
            raise ValueError("beginOptional without endOptional")
        self.n = len(items)
        closure = [{i} for i in range(self.n + 1)]
        for i in range(self.n, -1, -1):
            for a, b in spans:
                if a == i:
                    closure[i] |= closure[b]
        self.skip = [sum(1 << j for j in c) for c in closure]
        self.wild = sum(1 << i for i, w in enumerate(items) if w is None)
        self.reads: dict[bytes, int] = {}
        for i, w in enumerate(items):
            if w is not None:
                self.reads[w] = self.reads.get(w, 0) | 1 << i
        self.accept = 1 << self.n
        # closing a set of states: all sets are closed, so a step only adds what its targets skip to
        self.plain = sum(1 << i for i in range(self.n + 1) if self.skip[i] == 1 << i)
        if self.skip[0] & self.accept:
            raise ValueError("a template needs mandatory wording")
        starts = [i for i in range(self.n) if self.skip[0] >> i & 1]
        #: words that can begin a match; None where a wildcard can
        self.first = None if any(items[i] is None for i in starts) else {items[i] for i in starts}
        must = [w for i, w in enumerate(items) if w is not None and not any(a <= i < b for a, b in spans)]
        #: the longest mandatory word: without it in a text there is no match
        self.anchor = max(must, key=len) if must else None

    def match(self, words: Sequence[bytes], start: int) -> int:
        """End of the longest match that begins at ``start``; -1 if none."""
        states, end = self.skip[0], -1
        for i in range(start, len(words)):
            moved = (states & (self.reads.get(words[i], 0) | self.wild)) << 1
            if not moved:
                break
            states = moved
            rest = moved & ~self.plain
            while rest:
                low = rest & -rest
                states |= self.skip[low.bit_length() - 1]
                rest ^= low
            if states & self.accept:
                end = i + 1
        return end

    def find(self, words: Sequence[bytes]) -> list[tuple[int, int]]:
        """Leftmost-longest matches that do not overlap."""
        out, at, n = [], 0, len(words)
        while at < n:
            if (self.first is None or words[at] in self.first) and (end := self.match(words, at)) > at:
                out.append((at, end))
                at = end
            else:
                at += 1
        return out


class LicenseScanner:
    """Phrases and templates, compiled once per process."""

    def __init__(self, phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES):
        self.phrases = [(words_of(p), label) for p, label in phrases]
        self.rare = [max(p, key=len) for p, _ in self.phrases]
        self.automata = [(TokenAutomaton(t), label) for label, t in templates]

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int, str]], list[tuple[int, int, str]]]:
        """(number of words, places of phrases, places of templates); places are (start, end, label) in words."""
        data = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE)
        words = data.split()
        base: list[tuple[int, int, str]] = []
        for (p, label), rare in zip(self.phrases, self.rare, strict=True):
            if rare in data:
                first, k, i = p[0], len(p), -1
                with_first = words.count(first)
                for _ in range(with_first):
                    i = words.index(first, i + 1)
                    if words[i : i + k] == p:
                        base.append((i, i + k, label))
        found = [(*span, label) for a, label in self.automata if a.anchor is None or a.anchor in data for span in a.find(words)]
        return len(words), sorted(base), sorted(found)


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def license_scan(docs: DataFrame, *, phrases=PHRASES, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document, see SCHEMA.

    ``score``: 1 where a template matched, else 1/2 where a phrase stands, else 0.
    """
    held: list[LicenseScanner] = []

    def row(doc_id, text):
        if not held:
            held.append(LicenseScanner(phrases, templates))
        n, base, found = held[0].scan(text)
        b = {x[2] for x in base}
        return (
            doc_id, n, len(base), base[0][0] if base else None, max(x[0] for x in base) if base else None,
            ",".join(sorted(b)), ",".join(sorted(b | {x[2] for x in found})), 1.0 if found else 0.5 if base else 0.0,
        )

    return per_document(docs, SCHEMA, row, id_col, text_col)


def op2_license_scans(spark, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))
