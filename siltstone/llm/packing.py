"""Packing by concatenate and cut.

Pass one tokenizes each partition once and stores, for every document, its ids and where it starts within the
partition. The partition totals (one number each) give every partition's global offset. Pass two is row-wise:
a document's global start and length decide which fixed windows it crosses; each crossing is a piece with its
boundary record (sequence, offset, length). Only the last sequence is not full.

Edge cases: null or empty text is a document of the end id alone; null or repeated ids stay separate documents;
a special string of the tokenizer inside a text gets its special id; very long texts become many pieces; an empty
table gives an empty result; only the columns named are read, so extra columns cannot clash.
"""

from __future__ import annotations

import re
import struct
import zlib
from codecs import charmap_decode
from collections.abc import Iterator
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import stored, tidy, utf8

WINDOW, END_ID, CACHE_WORDS, PIECE_CHARS = 4096, 2, 100_000, 8
_tokenizers: dict[str, tuple] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordCache(dict):
    """Ids of words; one that is missing comes from the elder cache or is made."""

    def __init__(self, make, elder: dict[bytes, bytes]):
        self.make, self.elder = make, dict(elder)

    def __missing__(self, w: bytes) -> bytes:
        ids = self.elder.get(w)
        self[w] = ids = self.make(w) if ids is None else ids
        return ids


class WordTokenizer:
    """Ids of a text as little-endian uint16, word by word.

    White space ends every pre-token of this tokenizer and is dropped, so the ids of a text are those of its
    words in turn. Words are looked up in a cache of two generations: when the younger is full it becomes the
    elder, so frequent words stay. A longer run of letters in a word is a word of the cache itself, so that a word costs
    the model once, whatever punctuation stands at it; short runs of punctuation are kept likewise. Words of Latin-1
    letters, digits and ASCII punctuation (no apostrophe) are cut
    into the pre-tokenizer's pieces here and go to the BPE model directly; all others go through the whole tokenizer.
    The tokenizer's special strings are cut out of the raw text first, since it finds them before it normalises; a
    word that only looks like one in lower case is ordinary text.
    """

    PLAIN = re.compile(r"(?:[A-Za-zÀ-ÖØ-öø-ÿ]|[0-9]|[!-&(-/:-@\[-`{-~])+")
    PIECES = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[!-&(-/:-@\[-`{-~]+")

    TAILED = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")

    STOPS = frozenset((b".", b",", b"?", b":", b";"))

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True  # of words; encode() has cut the special strings out
        self.special = {t.content.encode(): struct.pack("<H", i) for i, t in self.model.get_added_tokens_decoder().items()}
        self.cut = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + b")") if self.special else None
        self.bpe = self.model.model
        level, letters = ByteLevel(add_prefix_space=False, use_regex=False), list(map(chr, range(256)))
        for c in map(chr, range(0xC0, 0x100)):
            for byte, letter in zip(c.encode(), level.pre_tokenize_str(c)[0][0], strict=True):
                letters[byte] = letter
        self.bytes_as_letters = "".join(letters)  # of the bytes of ASCII and Latin-1 letters
        self.cache = WordCache(self.word, {})
        self.pieces: dict[str, bytes] = {}
        self.number, self.packs = attrgetter("id"), [struct.Struct(f"<{n}H").pack for n in range(64)]

    def _ids(self, text: str) -> list[int]:
        return self.model.encode(text, add_special_tokens=False).ids

    def _pack(self, letters: str) -> bytes:
        ids = list(map(self.number, self.bpe.tokenize(letters)))
        n = len(ids)
        return self.packs[n](*ids) if n < len(self.packs) else struct.pack(f"<{n}H", *ids)

    def _letters(self, raw: bytes) -> str:
        """The model's letters for bytes, one each."""
        return charmap_decode(raw, "strict", self.bytes_as_letters)[0]

    def _piece(self, piece: str) -> bytes:
        if len(piece) > 3 and piece[0].isalpha():
            word = piece.encode()
            ids = self.cache.get(word) or self.cache.elder.get(word)
            if ids is None:
                self.cache[word] = ids = self._pack(piece if piece.isascii() else self._letters(word))
            return ids
        ids = self._pack(piece if piece.isascii() else self._letters(piece.encode()))
        if len(piece) <= PIECE_CHARS:
            if len(self.pieces) > CACHE_WORDS:
                self.pieces.clear()
            self.pieces[piece] = ids
        return ids

    def word(self, w: bytes) -> bytes:
        if w.isalpha() and w.islower():  # of ASCII letters
            return self._pack(w.decode())
        stem = w[:-1]
        if w[-1:] in self.STOPS and stem.isalpha() and stem.islower():
            ids = self.cache.get(stem) or self.cache.elder.get(stem)
            if ids is None:
                self.cache[stem] = ids = self._pack(stem.decode())
            stop = w[-1:].decode()
            return ids + (self.pieces.get(stop) or self._piece(stop))
        text = w.decode()
        if tailed := self.TAILED.fullmatch(text):
            stem, stop = tailed.groups()
            low = stem.lower()
            if not stop and low == stem:
                return self._pack(self._letters(w))
            ids = (len(low) <= 3 and self.pieces.get(low)) or self._piece(low)
            return ids + (self.pieces.get(stop) or self._piece(stop)) if stop else ids
        if self.PLAIN.fullmatch(text):
            known = self.pieces.get
            return b"".join([known(x) or self._piece(x) for x in self.PIECES.findall(text.lower())])
        ids = self._ids(text)
        return struct.pack(f"<{len(ids)}H", *ids)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if len(self.cache) > CACHE_WORDS:
            self.cache = WordCache(self.word, self.cache)
        get, special = self.cache.__getitem__, self.special
        out = []
        for t in texts:
            if any(x in t for x in special):
                out.append(b"".join([special[x] if x in special else b"".join(map(get, x.lower().split())) for x in self.cut.split(t)]))
            else:
                out.append(b"".join(map(get, t.lower().split())))
        return out


def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for each worker process, kept between tasks."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def tokenized(df: DataFrame, doc_id: str, text: str, path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, part, start_in_part, n_tokens, ids (uint16, with the end id)."""
    id_type = df.select(doc_id).schema[0].dataType.simpleString()
    end = np.array([end_id], dtype="<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, part, start = tokenizer(path), TaskContext.get().partitionId(), 0
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                ids = [x + end for x in tok.encode([t or b"" for t in utf8(batch, text)])]
                n = np.array([len(x) // 2 for x in ids], dtype=np.int64)
                starts = start + np.cumsum(n) - n
                start += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(doc_id), pa.array(np.full(len(ids), part, dtype=np.int32)), pa.array(starts), pa.array(n), pa.array(ids, pa.binary())],
                    names=["doc_id", "part", "start_in_part", "n_tokens", "ids"],
                )

    return df.select(doc_id, text).mapInArrow(tidy(run), f"doc_id {id_type}, part int, start_in_part long, n_tokens long, ids binary")


def pack(df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (uint16, little-endian)."""
    rows = stored(tokenized(df, doc_id, text, path or default_tokenizer(), end_id), "tokens")
    spark = df.sparkSession
    totals = sorted((r["part"], r["n"]) for r in rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    bases, at = [], 0
    for part, n in totals:
        bases.append((part, at))
        at += n
    base = spark.createDataFrame(bases, "part int, base long")
    placed = rows.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("start_in_part")).alias("at"), "n_tokens", "ids")
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                batch = whole.slice(k, 512)
                took, cols = [], [[] for _ in range(7)]
                for i, (at, n, raw) in enumerate(zip(batch.column("at").to_pylist(), batch.column("n_tokens").to_pylist(), batch.column("ids").to_pylist(), strict=True)):
                    start = 0
                    while start < n:
                        sequence, offset = divmod(at + start, window)
                        length = min(window - offset, n - start)
                        piece = raw[2 * start : 2 * (start + length)]
                        crc = zlib.crc32(np.frombuffer(piece, "<u2").astype("<u4").tobytes())
                        took.append(i)
                        for c, v in zip(cols, (start, length, crc, n, sequence, offset, piece), strict=True):
                            c.append(v)
                        start += length
                kinds = [pa.int64()] * 6 + [pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(took, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
                )

    return placed.mapInArrow(tidy(run), f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
