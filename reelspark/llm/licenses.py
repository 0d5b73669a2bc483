"""License scans: base phrases and template markup compiled into token automata.

A template is words with markup: ``[[ ... ]]`` may be missing, ``{{n}}`` stands for up to n words of any kind. A
template is compiled into a small automaton over word hashes with epsilon moves for missing parts; a text is accepted
where all mandatory words stand in order, exactly. Words are found for a whole batch with numpy, and automata only run
where a template's first mandatory word stands.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, hash_word, map_texts

#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE '
    "AND NONINFRINGEMENT. IN NO EVENT SHALL THE {{12}} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
    "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY {{12}} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR '
    "PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL {{12}} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT "
    "OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
    "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"
)
_BSD_TWO = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: [[1]] Redistributions of source code must retain "
    "the above copyright notice, this list of conditions and the following disclaimer. [[2]] Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
    "the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_NAMES = "[[3]] Neither the name of {{10}} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_GPL_NOTICE = (
    "This program is free software[[: you can]] [[you can]] redistribute it and/or modify it under the terms of the GNU [[Lesser]] [[Affero]] General Public License as published by the Free Software "
    "Foundation{{0}}, either version {number} of the License, or [[(at your option)]] any later version"
)

# Templates by label, whole licence texts among them; case and punctuation don't count.
TEMPLATES = {
    "mit": (
        "released under the [[terms of the]] MIT License", "licensed under the [[terms of the]] MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files [[(the Software)]] to deal in the Software without restriction",
    ),
    "mit-text": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
        "to do so, subject to the following conditions: The above copyright notice and this permission notice [[(including the next paragraph)]] shall be included in all copies or substantial portions "
        "of the Software. " + _AS_IS,
    ),
    "isc-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear "
        'in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND {{8}} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL '
        "{{8}} BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR "
        "OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE",
    ),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",),
    "bsd-2-text": (_BSD_TWO + " " + _BSD_END,),
    "bsd-3-text": (_BSD_TWO + " " + _BSD_NAMES + " " + _BSD_END,),
    "zlib-text": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted "
        "to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    ),
    "unlicense-text": ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",),
    "apache-2.0": ("Licensed under the Apache License, Version 2.0 [[(the License)]]", "Apache License, Version 2.0 [[, January 2004]]"),
    "apache-2.0-text": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at {{10}} Unless required by '
        'applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the '
        "License for the specific language governing permissions and limitations under the License",
    ),
    "gpl-3.0": ("licensed under the GNU General Public License version 3", "GNU General Public License [[as published by the Free Software Foundation either]] version 3 [[of the License]] [[or (at your option) any later version]]"),
    "gpl-3.0-text": (_GPL_NOTICE.replace("{number}", "3"),),
    "gpl-2.0": ("GNU General Public License [[as published by the Free Software Foundation either]] version 2 [[of the License]] [[or (at your option) any later version]]",),
    "gpl-2.0-text": (_GPL_NOTICE.replace("{number}", "2"),),
    "cc-by-nc": ("[[licensed under]] CC BY-NC [[{{1}} 0]]", "Creative Commons Attribution-NonCommercial [[{{2}}]] License", "Creative Commons Attribution Non Commercial [[{{2}}]] License"),
    "cc-by-sa": ("[[licensed under]] CC BY-SA [[{{1}} 0]]", "Creative Commons Attribution-ShareAlike [[{{2}}]] License", "Creative Commons Attribution Share Alike [[{{2}}]] License"),
    "cc-by-text": ("This work is licensed under [[the]] [[a]] Creative Commons Attribution {{2}} [[International]] [[Unported]] License",),
    "copyright": ("Copyright [[(c)]] [[{{3}}]] all rights reserved",),
}
#: What a label adds to the score; the score is one less the product of what remains.
STRENGTH = {"base": 0.6, "template": 0.8}

#: Markup, or a word as the scan reads words.
_PARTS = re.compile(r"\[\[|\]\]|\{\{\d+\}\}|[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass
class Automaton:
    """States 0..n; ``step[s]`` is the word that leads from s to s + 1 (None: any word); ``skip[s]``: states reachable for nothing."""

    step: list[int | None] = field(default_factory=list)
    skip: dict[int, list[int]] = field(default_factory=dict)

    @property
    def final(self) -> int:
        return len(self.step)

    def closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for t in self.skip.get(todo.pop(), ()):
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return states

    def first_words(self) -> set[int]:
        return {self.step[s] for s in self.closure({0}) if s < self.final and self.step[s] is not None}

    def run(self, words: list[int], at: int) -> int:
        """The end of the longest match that begins at word ``at``, or -1."""
        states, end = self.closure({0}), -1
        while True:
            if self.final in states:
                end = at
            if at >= len(words):
                return end
            states = self.closure({s + 1 for s in states if s < self.final and self.step[s] in (None, words[at])})
            if not states:
                return end
            at += 1


def compile_template(text: str) -> Automaton:
    """Template markup to an automaton; ``[[`` and ``]]`` may nest. Case and what isn't a word don't count."""
    made, open_at = Automaton(), []
    for part in _PARTS.findall(text.translate(_FOLD)):
        here = made.final
        if part == "[[":
            open_at.append(here)
        elif part == "]]":
            made.skip.setdefault(open_at.pop(), []).append(here)
        elif part.startswith("{{"):
            n = int(part[2:-2])
            made.step += [None] * n
            for s in range(here, here + n):
                made.skip.setdefault(s, []).append(here + n)
        else:
            made.step.append(hash_word(part))
    return made


def places(words: np.ndarray, phrase: list[int]) -> np.ndarray:
    """Where the phrase's words stand one after another."""
    n = len(words) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(words[:n] == np.uint64(phrase[0]))
    for k, w in enumerate(phrase[1:], 1):
        at = at[words[at + k] == np.uint64(w)]
    return at


class Scanner:
    def __init__(self, templates: dict[str, tuple[str, ...]] | None = None):
        self.base = [([hash_word(w) for w in p.split()], label) for p, label in BASE.items()]
        self.automata = [(compile_template(t), label) for label, ts in (templates or TEMPLATES).items() for t in ts]
        self.starts: dict[int, list[tuple[Automaton, str]]] = {}
        for a, label in self.automata:
            for w in a.first_words():
                self.starts.setdefault(w, []).append((a, label))
        self.start_words = np.array(sorted(self.starts), np.uint64)

    def scan(self, texts: list[bytes]) -> list[tuple]:
        """(n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of each text."""
        words = Words(texts)
        base: dict[int, list[tuple[int, str]]] = {}
        for phrase, label in self.base:
            for p in places(words.hash, phrase):
                i = int(np.searchsorted(words.first, p, side="right")) - 1
                while words.first[i + 1] <= p:
                    i += 1
                if p + len(phrase) <= words.first[i + 1]:  # not across two texts
                    base.setdefault(i, []).append((int(p - words.first[i]), label))
        found: dict[int, list[tuple[int, int, str]]] = {}
        hits = np.flatnonzero(np.isin(words.hash, self.start_words)) if len(self.start_words) else np.zeros(0, int)
        owners = np.searchsorted(words.first, hits, side="right") - 1
        lists: dict[int, list[int]] = {}
        for p, i in zip(hits.tolist(), owners.tolist(), strict=True):
            if i not in lists:
                lists = {i: words.of(i).tolist()}
            own = lists[i]
            at = p - int(words.first[i])
            for a, label in self.starts[own[at]]:
                end = a.run(own, at)
                if end > at:
                    found.setdefault(i, []).append((at, end, label))
        out = []
        for i, n in enumerate(words.counts.tolist()):
            b, f = base.get(i, []), found.get(i, [])
            base_labels = {label for _, label in b}
            labels = base_labels | {label for _, _, label in f}
            rest = (1 - STRENGTH["base"]) ** len(base_labels) * (1 - STRENGTH["template"]) ** len({label for _, _, label in f})
            spans = ",".join(f"{label}:{s}:{e}" for s, e, label in sorted(set(f)))
            out.append((n, len(b), min((s for s, _ in b), default=None), max((s for s, _ in b), default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), 1 - rest, spans))
        return out


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Rows (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans), one per row of ``docs``.

    ``spans`` lists template matches as label:first word:end. Null and empty texts have no words, no labels, score 0
    and null for first_word and last_word.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    made: list[Scanner] = []

    def work(part: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        if not made:
            made.append(Scanner(templates))
        columns = list(zip(*made[0].scan(texts), strict=True))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        return pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    return map_texts(source, work, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string")
