"""License scans: an exact set-similarity join of text blocks with license templates."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impactlens.llm.shared import whole

#: The word pattern and the phrases of the base labels.
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: (label, text): short statements by which texts name their license, and license notices. The list bounds what is broadcast.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."),
    ("mpl", "This file is subject to the terms of the Mozilla Public License."),
    # The notices that the licenses prescribe.
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
    (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
    distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
    following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
    are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
    Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
    documentation and/or other materials provided with the distribution."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
    the above copyright notice and this permission notice appear in all copies."""),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
    You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"""),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published
    by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
    file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
    arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications,
    and to alter it and redistribute it freely."""),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)
CONTAINMENT = 0.8


def words_of(text: str) -> list[str]:
    return WORD.findall(text.translate(LOWER))


def blocks(text: str) -> list[str]:
    """The lines of a text; runs of them are compared."""
    return text.split("\n")


class Templates:
    """Template token sets in the global order (rarest first), with their prefixes.

    A block that holds at least ``need`` of a template's n tokens holds one of its first n - need + 1; the k-th common
    token found at position p of the template leaves at most n - p - 1 more to find.
    """

    def __init__(self, templates, frequency: Mapping[str, int], threshold: float):
        self.sets: list[tuple[str, list[str], int]] = []
        self.lengths = [len(words_of(text)) for _, text in templates]
        self.index: dict[str, list[int]] = {}
        for number, (label, text) in enumerate(templates):
            tokens = sorted(set(words_of(text)), key=lambda w: (frequency.get(w, 0), w))
            need = next((n for n in range(1, len(tokens)) if n / len(tokens) >= threshold), len(tokens))
            self.sets.append((label, tokens, need))
            if not tokens:
                continue
            for token in tokens[: len(tokens) - need + 1]:
                self.index.setdefault(token, []).append(number)

    def contained(self, block: set[str]) -> Iterator[tuple[int, float]]:
        """(number, containment) of every template that the block of tokens contains far enough."""
        for number in sorted({n for token in self.index.keys() & block for n in self.index[token]}):
            _, tokens, need = self.sets[number]
            if len(block) < need:
                continue
            common = 0
            for place, token in enumerate(tokens):
                common += token in block
                if common + len(tokens) - place - 1 < need:
                    break
            else:
                yield number, common / len(tokens)

    def matches(self, block: set[str]) -> list[tuple[str, float]]:
        """(label, containment) of every template that the block of tokens contains far enough."""
        return [(self.sets[number][0], share) for number, share in self.contained(block)]

    def matched_runs(self, lines: list[list[str]]) -> Iterator[tuple[str, float, set[tuple[int, int]]]]:
        """(label, best containment, tightest runs of lines) of every template that a run of lines contains far enough.

        A run is a line and as many after it as a template that begins in it can need: until they hold all its words but one.
        What the whole text lacks is in no run, so the filters rule templates out by the text. The tightest runs, as (first, last)
        line, match no longer when a line is taken off either end.
        """
        for number, _ in self.contained({w for line in lines for w in line}):
            label, tokens, need = self.sets[number]
            known = set(tokens)
            before, upto = 0, [0]
            for line in lines:
                before += len(line)
                upto.append(before)
            hits = [(i, found) for i, line in enumerate(lines) if (found := known.intersection(line))]
            tight, best, inside, end, left = set(), 0, {}, 0, 0
            for i, found in hits:
                while end < len(hits) and (hits[end][0] <= i or upto[hits[end][0]] - upto[i + 1] < self.lengths[number] - 1):
                    for token in hits[end][1]:
                        inside[token] = inside.get(token, 0) + 1
                    end += 1
                best = max(best, len(inside))
                _take(inside, found)
            inside.clear()
            for j, found in hits:
                for token in found:
                    inside[token] = inside.get(token, 0) + 1
                last = None
                while len(inside) >= need:
                    last = hits[left][0]
                    _take(inside, hits[left][1])
                    left += 1
                if last is not None and (last == j or upto[j] - upto[last + 1] < self.lengths[number] - 1):
                    tight.add((last, j))
            if tight:
                yield label, best / len(tokens), tight


def _take(inside: dict[str, int], found: set[str]) -> None:
    for token in found:
        inside[token] -= 1
        if not inside[token]:
            del inside[token]


def stretches(runs: set[tuple[int, int]]) -> int:
    """The number of stretches of lines when runs that share a line are one."""
    count, end = 0, -1
    for first, last in sorted(runs):
        count += first > end
        end = max(end, last)
    return count


def token_counts(docs: DataFrame, text_col: str, templates=TEMPLATES) -> dict[str, int]:
    """In how many blocks of all documents each template token occurs; no more rows than the templates have tokens."""
    wanted = {w for _, text in templates for w in words_of(text)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, int] = {}
        for batch in batches:
            for text in batch["text"]:
                for block in blocks(text):
                    for token in wanted.intersection(words_of(block)):
                        total[token] = total.get(token, 0) + 1
        if total:
            yield pd.DataFrame({"token": list(total), "n": list(total.values())})

    parts = docs.select(whole(text_col).alias("text")).mapInPandas(count, "token STRING, n LONG")
    return {r.token: r.n for r in parts.groupBy("token").agg(F.sum("n").alias("n")).collect()}


def _places(words: list[str], phrase: list[str]) -> list[int]:
    out, at = [], -1
    while True:
        try:
            at = words.index(phrase[0], at + 1)
        except ValueError:
            return out
        if words[at : at + len(phrase)] == phrase:
            out.append(at)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, threshold: float = CONTAINMENT) -> DataFrame:
    """License labels of every whole text, by phrases and by all templates that a run of its lines contains to ``threshold`` or more.

    (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matched_blocks); ``score`` is 1 with a phrase, else the
    best containment; ``matched_blocks`` counts the tightest runs, those that share lines as one. Null and empty texts have no words and no labels; every row is scanned by itself, so repeated rows agree.
    """
    rows = docs.select(F.struct(F.col(id_col).alias("doc_id")).alias("_id"), whole(text_col).alias("text"))
    known = Templates(templates, token_counts(docs, text_col, templates), threshold)
    phrases = [(p.split(" "), label) for p, label in PHRASES.items()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                lines = [words_of(block) for block in blocks(text)]
                found: list[int] = []
                base, more, score, matched = set(), set(), 0.0, set()
                words = [w for line in lines for w in line]
                for phrase, label in phrases:
                    if places := _places(words, phrase):
                        found += places
                        base.add(label)
                for label, share, runs in known.matched_runs(lines):
                    matched |= runs
                    more.add(label)
                    score = max(score, share)
                out.append((
                    len(words), len(found), min(found, default=None), max(found, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), 1.0 if base else score, stretches(matched),
                ))
            columns = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matched_blocks"]
            frame = pd.DataFrame(out, columns=columns).astype({"first_word": "Int64", "last_word": "Int64"})
            yield pd.concat([batch[["_id"]].reset_index(drop=True), frame], axis=1)

    id_type = dict(docs.dtypes)[id_col]
    done = rows.mapInPandas(run, (
        f"_id STRUCT<doc_id: {id_type}>, n_words LONG, n_base LONG, first_word LONG, last_word LONG, base_labels STRING, labels STRING, score DOUBLE, matched_blocks LONG"
    ))
    return done.select("_id.doc_id", *done.columns[1:])
