"""License scans by an exact set-similarity join (containment) with prefix, length and positional filters.

A block is a paragraph: the text between blank lines. A template is the set of words of one licence notice.
A block matches when it holds at least `threshold` of a template's distinct words. Template words are ordered
by how many documents of the whole corpus hold them, rarest first, and so are the block's. A block that meets the
threshold must share a word with the first `len - need + 1` of the template's (prefix), have `need` template words
itself (length), and have `need` words left, on both sides, from the first shared word on (positional): what
stands before it in the block's order is lost to the template.

Edge cases: null text counts as empty; empty text has no words, no labels and score 0; repeated rows each get
their own row; an empty table gives an empty result; only the columns named are read, so extra columns cannot
clash.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import alnum_words, per_row, utf8

#: Phrases whose words stand consecutively, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices that licence stewards publish, by label.
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc", "this work is licensed under a creative commons attribution international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]

THRESHOLD = 0.8
_BLANK = re.compile(rb"\n[\x20\t\r]*\n")


def template_sets(templates=TEMPLATES) -> list[tuple[str, frozenset[bytes]]]:
    return [(label, frozenset(alnum_words(text.encode()))) for label, text in templates]


def document_frequencies(df: DataFrame, vocabulary: frozenset[bytes], text: str = "text") -> dict[bytes, int]:
    """How many rows hold each template word. The result has at most a row per template word."""
    names = sorted(vocabulary)

    def run(batches):
        found = dict.fromkeys(names, 0)
        for batch in batches:
            for raw in utf8(batch, text):
                for w in vocabulary.intersection(alnum_words(raw or b"")):
                    found[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([found[w] for w in names], pa.int64())], names=["word", "n"])

    rows = df.select(text).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return dict.fromkeys(names, 0) | {bytes(r["word"]): r["n"] for r in rows}


class ContainmentIndex:
    """Templates and blocks as words in the corpus's order, rarest first, with an index over the templates' prefixes."""

    def __init__(self, templates: list[tuple[str, frozenset[bytes]]], freq: dict[bytes, int], threshold: float):
        vocabulary = frozenset().union(*(words for _, words in templates))
        self.rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (freq.get(w, 0), w)))}
        self.items: list[tuple[str, list[int], int]] = []
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        for k, (label, words) in enumerate(templates):
            order = sorted(self.rank[w] for w in words)
            need = max(1, math.ceil(threshold * len(order) - 1e-9))
            self.items.append((label, order, need))
            for position, r in enumerate(order[: len(order) - need + 1]):
                self.prefix.setdefault(r, []).append((k, position))
        self.keys = frozenset(w for w, r in self.rank.items() if r in self.prefix)
        self.least = min((need for _, _, need in self.items), default=0)

    def ordered(self, block: frozenset[bytes] | set[bytes]) -> list[int]:
        """The block's template words by their ranks, ascending; no other word can be shared."""
        return sorted(self.rank[w] for w in self.rank.keys() & block)

    def candidates(self, mine: list[int]) -> dict[int, tuple[int, int]]:
        """Template -> positions (in the template, in the block) of the first word that both share, for every template
        that passes the filters: prefix (that word is in the template's prefix), length (the block has `need` words)
        and positional (`need` words are left from it on, in the block as in the template)."""
        first: dict[int, tuple[int, int]] = {}
        size = len(mine)
        for at, r in enumerate(mine):
            if size - at < self.least:  # no template can be reached from here: the block's own prefix ends
                break
            for k, position in self.prefix.get(r, ()):
                first.setdefault(k, (position, at))
        return {k: (i, at) for k, (i, at) in first.items() if self.items[k][2] <= min(size - at, len(self.items[k][1]) - i)}

    def matches(self, block: frozenset[bytes] | set[bytes]) -> list[tuple[str, float]]:
        """(label, containment) of every template that the block meets."""
        mine, out = self.ordered(block), []
        for k, (i, at) in self.candidates(mine).items():
            label, order, need = self.items[k]
            got = len(set(order[i:]).intersection(mine[at:]))  # nothing is shared before the first shared word
            if got >= need:
                out.append((label, got / len(order)))
        return out


def phrase_places(words: list[bytes], phrases: list[tuple[list[bytes], str]]) -> list[tuple[int, str]]:
    """(start, label) wherever a phrase's words stand consecutively; found from the phrase's last word."""
    out = []
    for parts, label in phrases:
        i, last = -1, parts[-1]
        try:
            while True:
                i = words.index(last, i + 1)
                start = i - len(parts) + 1
                if start >= 0 and words[start : i + 1] == parts:
                    out.append((start, label))
        except ValueError:
            pass
    return out


def license_scan(df: DataFrame, keep: list[str], text: str = "text", templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: `keep` columns, n_words, n_base, first_word, last_word, base_labels, labels, score,
    n_blocks (paragraphs that meet a template). score is 1 with a base phrase, else the best containment found, else 0."""
    sets = template_sets(templates)
    index = ContainmentIndex(sets, document_frequencies(df, frozenset().union(*(w for _, w in sets)), text), threshold)
    split = [(p.encode().split(), label) for p, label in phrases.items()]

    def row(raw: bytes) -> tuple:
        words = alnum_words(raw)
        places = phrase_places(words, split)
        base = sorted({x[1] for x in places})
        labels, score, blocks = set(base), float(bool(places)), 0
        if not index.keys.isdisjoint(words):
            for block in _BLANK.split(raw):
                if found := index.matches(frozenset(alnum_words(block))):
                    blocks += 1
                    labels.update(x[0] for x in found)
                    score = max(score, *(x[1] for x in found))
        starts = [x[0] for x in places]
        return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(sorted(labels)), score, blocks

    return per_row(df, keep, text, "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_blocks long", row)
