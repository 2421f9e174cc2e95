"""Licence scans by template markup, compiled into automata over words.

A template is a licence's wording with marked regions: ``<<beginOptional>>...<<endOptional>>`` may be missing, and
``<<var;max=N>>`` stands for up to N words of any wording. Everything else is mandatory and has to match word for
word. Words are runs of a-z (A-Z in lower case), digits and characters beyond ASCII, so punctuation, case and line
breaks don't matter. Plain phrases are looked up beside the templates.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm import bagminhash as bag
from quayside.llm._common import text_blocks, text_of

# fixed values: phrases and their labels
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE <<var;max=6>> BE LIABLE FOR ANY CLAIM, DAMAGES OR
OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY <<var;max=12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;max=12>> BE LIABLE FOR ANY DIRECT,
INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_TWO = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
<<var;max=1>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
<<var;max=1>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution."""
_VERB = "<<beginOptional>>is<<endOptional>>"

# fixed values: the wordings of public licences and of usual notices
TEMPLATES = {
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to
deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software. """
    + _WARRANTY,
    "isc-text": """Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND <<var;max=6>> DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;max=6>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "bsd-2-clause-text": _BSD_TWO + _BSD_END,
    "bsd-3-clause-text": _BSD_TWO
    + """<<var;max=1>> Neither the name of <<var;max=10>> nor the names of its contributors may be used to endorse or promote products derived from this software
without specific prior written permission. """
    + _BSD_END,
    "zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will the author<<beginOptional>> s<<endOptional>> be held liable for any
damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions: <<var;max=1>> The origin of this software must not be misrepresented; you must not claim that you wrote
the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. <<var;max=1>> Altered
source versions must be plainly marked as such, and must not be misrepresented as being the original software. <<var;max=1>> This notice may not be removed or altered from
any source distribution.""",
    "unlicense-text": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in
source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or
authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to
the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software
under copyright law. """
    + _WARRANTY,
    "apache-2.0-notice": _VERB
    + """ Licensed under the Apache License, Version 2.0 <<beginOptional>>(the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at <<var;max=12>><<endOptional>>""",
    "gpl-3.0-notice": "licensed under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License <<beginOptional>>as published by the Free Software Foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version 3",
    "gpl-2.0-notice": "licensed under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License <<beginOptional>>as published by the Free Software Foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version 2",
    "gpl-or-later-notice": """you can redistribute it and/or modify it under the terms of the GNU <<beginOptional>>Lesser<<endOptional>> <<beginOptional>>Affero<<endOptional>> General Public License
as published by the Free Software Foundation, either version <<var;max=2>> of the License, or <<beginOptional>>(at your option)<<endOptional>> any later version""",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "mit-notice": "under the <<beginOptional>>terms of the<<endOptional>> MIT License",
    "cc-by-4.0-notice": "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> CC BY 4.0",
    "cc-by-sa-4.0-notice": "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> CC BY-SA 4.0",
    "cc-by-nc-4.0-notice": "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> CC BY-NC 4.0",
    "cc-by-nd-4.0-notice": "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> CC BY-ND 4.0",
    "cc-by-4.0-long-notice": "licensed under a Creative Commons Attribution <<beginOptional>><<var;max=2>><<endOptional>> 4.0 <<beginOptional>>International<<endOptional>> License",
}

_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
_MARK = re.compile(r"<<(beginOptional|endOptional|var;max=(\d+))>>")


def words_of(text: str) -> list[bytes]:
    return _WORD.findall(text.encode().lower())


class Automaton:
    """Steps over words: ("word", w), ("any", n) up to n words, ("skip", to) that may jump to ``to``."""

    def __init__(self, template: str):
        self.steps: list[tuple] = []
        open_: list[int] = []
        at = 0
        for m in [*_MARK.finditer(template), None]:
            self.steps += [("word", w) for w in words_of(template[at : m.start() if m else len(template)])]
            if m is None:
                break
            at = m.end()
            if m[1] == "beginOptional":
                open_.append(len(self.steps))
                self.steps.append(("skip", -1))
            elif m[1] == "endOptional":
                self.steps[open_.pop()] = ("skip", len(self.steps))
            else:
                self.steps.append(("any", int(m[2])))
        if open_:
            raise ValueError("an optional region isn't closed")
        #: the words that every match holds at its start or after leading optional and replaceable ones
        self.mandatory = self._mandatory()

    def _mandatory(self) -> list[tuple[int, bytes]]:
        out, k = [], 0
        while k < len(self.steps):
            if self.steps[k][0] == "skip":
                k = self.steps[k][1]
                continue
            if self.steps[k][0] == "word":
                out.append((k, self.steps[k][1]))
            k += 1
        return out

    def anchor(self) -> tuple[int, list[bytes]]:
        """The first run of mandatory words that follow each other: where in the steps, and the words (up to four)."""
        at, word = self.mandatory[0]
        run = [word]
        for k, w in self.mandatory[1:4]:
            if k != at + len(run):
                break
            run.append(w)
        return at, run

    def _closure(self, states: dict[tuple[int, int], None]) -> dict[tuple[int, int], None]:
        todo = list(states)
        while todo:
            k, used = todo.pop()
            more = []
            if k < len(self.steps):
                step = self.steps[k]
                if step[0] == "skip":
                    more = [(k + 1, 0), (step[1], 0)]
                elif step[0] == "any":
                    more = [(k + 1, 0)]
            for s in more:
                if s not in states:
                    states[s] = None
                    todo.append(s)
        return states

    def match(self, words: list[bytes], start: int, step: int = 0) -> tuple[int, float]:
        """Words of the longest match from ``start`` on (0 if none), and the share of mandatory words reached."""
        states = self._closure({(step, 0): None})
        longest, furthest, end = 0, 0, len(self.steps)
        if (end, 0) in states:
            longest = 0
        for n in range(1, len(words) - start + 1):
            w = words[start + n - 1]
            after: dict[tuple[int, int], None] = {}
            for k, used in states:
                if k < end:
                    kind, what = self.steps[k]
                    if kind == "word" and what == w:
                        after[(k + 1, 0)] = None
                        furthest = max(furthest, k + 1)
                    elif kind == "any" and used < what:
                        after[(k, used + 1)] = None
            if not after:
                break
            states = self._closure(after)
            if (end, 0) in states:
                longest = n
        total = len(self.mandatory)
        return longest, (total if longest else sum(k < furthest for k, _ in self.mandatory)) / total


class Scanner:
    """Phrases and templates over blocks of texts. Hashes of words only pick the texts to look at."""

    def __init__(self, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES):
        self.phrases = [(words_of(p), label) for p, label in phrases.items()]
        self.templates = [(name, a := Automaton(t), *a.anchor()) for name, t in templates.items()]

    @functools.cached_property
    def keys(self) -> list[np.ndarray]:
        runs = [p for p, _ in self.phrases] + [run for *_, run in self.templates]
        flat = list(dict.fromkeys(w for r in runs for w in r))
        h, _ = bag.words(pa.array([w.decode() for w in flat]))
        known = dict(zip(flat, h, strict=True))
        return [np.array([known[w] for w in r], dtype=np.uint64) for r in runs]

    def scan(self, texts: pa.Array) -> dict[str, list]:
        h, at = bag.words(texts)
        n = np.diff(at)
        padded = np.concatenate([h, np.zeros(8, dtype=np.uint64)])
        look: set[int] = set()
        for key in dict.fromkeys(tuple(k.tolist()) for k in self.keys):
            hits = np.flatnonzero(h == np.uint64(key[0]))
            for j, w in enumerate(key[1:], 1):
                hits = hits[padded[hits + j] == np.uint64(w)]
            look.update((np.searchsorted(at, hits, side="right") - 1).tolist())
        out = {"n_words": n.tolist(), "n_base": [0] * len(n), "first_word": [None] * len(n), "last_word": [None] * len(n), "base_labels": [""] * len(n), "labels": [""] * len(n), "score": [0.0] * len(n)}
        for k in look:
            for name, value in self.one(words_of(texts[k].as_py())).items():
                out[name][k] = value
        return out

    def one(self, words: list[bytes]) -> dict[str, object]:
        where: dict[bytes, list[int]] = {}
        firsts = {p[0] for p, _ in self.phrases} | {run[0] for *_, run in self.templates}
        for i, w in enumerate(words):
            if w in firsts:
                where.setdefault(w, []).append(i)
        places, base, more, score = [], set(), set(), 0.0
        for phrase, label in self.phrases:
            hits = [i for i in where.get(phrase[0], ()) if words[i : i + len(phrase)] == phrase]
            if hits:
                places += hits
                base.add(label)
                score = max(score, 0.5)
        for name, automaton, step, run in self.templates:
            for i in where.get(run[0], ()):
                if words[i : i + len(run)] == run:
                    length, share = automaton.match(words, i, step)
                    if length:
                        more.add(name)
                    score = max(score, share if length else share * 0.9)
        return {"n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None), "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | more)), "score": score}


def scan_licenses(docs: DataFrame, scanner: Scanner | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts all places of phrases; first_word and last_word are the smallest and largest of their starts,
    null without one. labels also holds the templates whose mandatory wording all stands there. score is 1 with such a match,
    else the largest of 0.5 for a phrase and 0.9 times the share of a template's mandatory words reached. Null text
    counts as empty: no words, no labels (''), score 0. Ids are kept as they are; an empty input gives no rows.
    """
    scanner = scanner or Scanner()
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text"))
    schema = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "text", 2 << 20):
            got = scanner.scan(block.column("text"))
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), *(pa.array(got[name], kind) for name, kind in schema)], names=["doc_id", *(name for name, _ in schema)])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
