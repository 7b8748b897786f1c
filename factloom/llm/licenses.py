"""License scans (operator 8): license templates with optional and replaceable regions, compiled to token automata.

A template is markup over words: plain words are mandatory, `[...]` is optional, `{m,n}` stands for m to n words of any kind.
Its automaton accepts a run of a text's words whose mandatory wording matches exactly. Base phrases are counted apart.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import WORD_BYTES, append_columns, blobs

#: Phrases whose words stand consecutively, and their labels: fixed values.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Templates by label, in the markup described above; public license wordings in lower case, without punctuation.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license [version] 2 0 [the license] [you may not use this file except in compliance with the license [you may obtain a copy of the license at {1,12}]]",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [1] [redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer] [2] [redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution] [3] [neither the name of {1,12} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission]",
    "cc-by-4.0": "licensed under [a] [the] [terms of the] [creative commons] cc by 4 0 [international] [license]",
    "cc-by-nc": "licensed under [a] [the] [terms of the] [creative commons] cc by nc {2,2} [international] [license]",
    "cc-by-sa": "licensed under [a] [the] [terms of the] [creative commons] cc by sa {2,2} [international] [license]",
    "creative-commons": "licensed under [a] [the] [terms of the] creative commons attribution [noncommercial] [sharealike] [noderivatives] {2,2} [international] [license]",
    "gpl-line": "licensed under [the] [terms of the] gnu [lesser] [affero] general public license [version {1,1}]",
    "gpl-notice": "[this program is free software you can] redistribute it and or modify it under the terms of the gnu [lesser] [affero] general public license as published by the free software foundation [either] version {1,2} [of the license] [or at your option any later version]",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted [provided that the above copyright notice and this permission notice appear in all copies]",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so [subject to the following conditions] [the above copyright notice and this permission notice [including the next paragraph] shall be included in all copies or substantial portions of the software]",
    "mit-line": "[released] [distributed] [licensed] under the [terms of the] mit license",
    "spdx": "spdx license identifier {1,4}",
    "zlib": "this software is provided as is without any express or implied warranty in no event will the {1,6} be held liable for any damages arising from the use of this software",
}
_MARK = re.compile(r"\{(\d+),(\d+)\}|\[|\]|[^\s\[\]{}]+")


class Automaton:
    """A template as a nondeterministic automaton over words: states with a word (or any) to the next, and jumps over optional regions."""

    def __init__(self, template: str) -> None:
        self.steps: list[bytes | None] = []  # state -> word that leads to the next state; None: any word
        self.jumps: dict[int, set[int]] = {}
        opened: list[int] = []
        for mark in _MARK.finditer(template):
            if mark[0] == "[":
                opened.append(len(self.steps))
            elif mark[0] == "]":
                self.jumps.setdefault(opened.pop(), set()).add(len(self.steps))
            elif mark[1]:
                least, most = int(mark[1]), int(mark[2])
                self.steps += [None] * least
                for k in range(least, most):
                    self.jumps.setdefault(len(self.steps), set()).add(len(self.steps) + most - k)
                    self.steps.append(None)
            else:
                self.steps.append(mark[0].encode())
        if opened:
            raise ValueError(f"unclosed region in {template!r}")
        self.end = len(self.steps)
        #: Words with which a match can begin.
        self.first = {self.steps[s] for s in self._spread({0}) if s < self.end}
        if None in self.first or self.end in self._spread({0}):
            raise ValueError(f"a template must begin with a mandatory word: {template!r}")

    def _spread(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for s in self.jumps.get(todo.pop(), ()):
                if s not in out:
                    out.add(s)
                    todo.append(s)
        return out

    def match(self, words: list[bytes], at: int) -> int:
        """The end of the longest run from `at` that the automaton accepts; -1 if none."""
        states, best = self._spread({0}), -1
        for k in range(at, len(words) + 1):
            if self.end in states:
                best = k
            if k == len(words):
                break
            word = words[k]
            states = self._spread({s + 1 for s in states if s < self.end and (self.steps[s] is None or self.steps[s] == word)})
            if not states:
                break
        return best


class Scanner:
    """All templates and base phrases, tried where their first words stand."""

    def __init__(self, templates: dict[str, str] = TEMPLATES, base: dict[str, str] = BASE) -> None:
        self.automata = {label: Automaton(t) for label, t in templates.items()}
        self.base = [(phrase.encode(), label) for phrase, label in base.items()]
        # a mandatory pair of neighbouring words tells quickly that a template can't match
        self.anchors = {label: self._anchor(a) for label, a in self.automata.items()}

    @staticmethod
    def _anchor(a: Automaton) -> bytes:
        """The longest run of mandatory words."""
        optional = set()
        for s, ends in a.jumps.items():
            for end in ends:
                optional.update(range(s, end))
        runs, run = [], []
        for s, word in enumerate([*a.steps, None]):
            if word is None or s in optional or any(s in ends for ends in a.jumps.values()):
                runs.append(run)
                run = []
            if word is not None and s not in optional:
                run.append(word)
        return b" " + b" ".join(max(runs, key=len)) + b" "

    def scan(self, text: bytes) -> dict:
        words = text.translate(WORD_BYTES).split()
        line = b" " + b" ".join(words) + b" "
        starts, base_labels, spans = [], set(), []
        for phrase, label in self.base:
            n, word, counted = phrase.count(b" ") + 1, 0, 0
            for at in self._places(line, b" " + phrase + b" "):
                word += line.count(b" ", counted, at)  # places come in order, so the text is counted through once
                counted = at
                starts.append(word)
                base_labels.add(label)
                spans.append((word, word + n, label))
        labels = set(base_labels)
        places: dict[bytes, list[int]] = {}
        for label, automaton in self.automata.items():
            if self.anchors[label] not in line:
                continue
            for first in automaton.first:
                if first not in places:
                    places[first] = [k for k, w in enumerate(words) if w == first]
            end = 0
            for at in sorted({k for first in automaton.first for k in places[first]}):
                if at >= end and (to := automaton.match(words, at)) > 0:
                    labels.add(label)
                    spans.append((at, to, label))
                    end = to
        covered = np.zeros(len(words), bool)
        for a, b, _ in spans:
            covered[a:b] = True
        return {
            "n_words": len(words), "n_base": len(starts), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
            "base_labels": ",".join(sorted(base_labels)), "labels": ",".join(sorted(labels)), "score": float(covered.mean()) if words else 0.0,
            "spans": [{"first": a, "end": b, "label": label} for a, b, label in sorted(spans)],
        }

    @staticmethod
    def _places(line: bytes, phrase: bytes) -> Iterator[int]:
        at = line.find(phrase)
        while at >= 0:
            yield at
            at = line.find(phrase, at + 1)


FIELDS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<first: long, end: long, label: string>>"


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all, if None) with FIELDS: what base phrases and templates find in each whole text.

    spans are the matched runs of words, [first, end). score is the share of words in a span. A null text is an empty one:
    no words, no labels (empty strings), score 0, first_word and last_word null. Columns with these names are replaced.
    """
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("label", pa.string())]))]

    def make():
        scanner = Scanner(templates)

        def step(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            rows = [scanner.scan(t or b"") for t in blobs(batch.column(text_col).cast(pa.large_string()))]
            return {name: pa.array([r[name] for r in rows], kind) for name, kind in zip(names, kinds, strict=True)}

        return step

    return append_columns(docs, make, FIELDS, keep)
