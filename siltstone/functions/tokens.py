"""Subword tokenization by a vocabulary file, in Arrow batches."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=4)
def load(path: str):
    """One tokenizer for each file and worker process; special strings in a text get their special ids."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Words:
    """Encodes texts. Where the vocabulary file cuts a text at its single spaces anyway (byte-level BPE, no normalizer), words
    are encoded once and kept; texts with an added token, and other files, are encoded whole."""

    CUT, KEPT = re.compile(r"(?<=\S)(?= \S)"), 200_000

    def __init__(self, path: str):
        self.model, self.known = load(path), {}
        form = json.loads(self.model.to_str())
        before = form["pre_tokenizer"] or {}
        plain = not form["normalizer"] and not form["truncation"] and not form["padding"] and form["model"]["type"] == "BPE" and not form["model"].get("dropout")
        self.cut = plain and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before["add_prefix_space"]
        added = [x["content"] for x in form["added_tokens"]]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.cut:
            return self._whole(texts)
        if len(self.known) > self.KEPT:
            self.known = {}
        parts = [[x] if self.added and self.added.search(x) else self.CUT.split(x) for x in texts]
        known = self.known
        new = list({w for some in parts for w in some if w not in known})
        known.update(zip(new, [x.tobytes() for x in self._whole(new)], strict=True))
        return [np.frombuffer(b"".join([known[w] for w in some]), dtype=np.int32) for some in parts]

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.int32) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]


#: Characters that are encoded at once: what the tokenizer keeps for a token takes some hundred times its text.
SLICE_CHARS = 1 << 18


def bpe_encode(c: Column, path: str, end_id: int = 0) -> Column:
    """Ids of each text and the end id; null for null.

    Texts are encoded and handed on in slices of SLICE_CHARS (a longer text alone). A filter on the ids would make Spark
    encode twice, hence the mark."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = Words(path)
        end = np.array([end_id], dtype=np.int32)
        for s in batches:
            for texts in text_slices(s.tolist(), SLICE_CHARS):
                found = words.encode([x or "" for x in texts])
                yield pd.Series([None if x is None else np.append(ids, end) for x, ids in zip(texts, found, strict=True)], dtype=object)

    return run.asNondeterministic()(c)


def text_slices(texts: list[str | None], most: int) -> Iterator[list[str | None]]:
    """The texts in turn, some `most` characters at a time; a longer one stands alone."""
    some, held = [], 0
    for x in texts:
        if some and held + len(x or "") > most:
            yield some
            some, held = [], 0
        some.append(x)
        held += len(x or "")
    if some:
        yield some
