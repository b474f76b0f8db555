"""Benchmark decontamination by latent semantic retrieval.

The benchmark is the stated query set; all its items share one index, and every document passes it once (items beyond
`WAVE_ITEMS`, which bounds the index in memory, take another pass). Document frequencies of the items' words come from
all documents. A distributed randomised SVD of the TF-IDF passages of all documents, joined by the items with the same
total weight, gives blocks of at most `BLOCK_ITEMS` items and `BLOCK_WORDS` distinct words a latent space of `RANK`
dimensions, or as many as the block has items if those are more. The passages are read once for every `FIT_BLOCKS`
blocks: tasks add up their Gram matrix (dense for a block's `HEAD_WORDS` most frequent words, pair by pair for the others),
which is stored, and the products of the SVD are taken with it. An item's latent vector is kept as the `LATENT_WORDS`
words that it weighs most, so that a cosine in the latent space is a sparse product with a passage.

An item is only sought where one of its rarest words stands (one more of them than a common subsequence of the wanted
length can lack, hence an exact filter), and where `MIN_LCS` of its words stand near. Passages are windows of the item's
length (the next power of two, `LEAST_WINDOW` at least), every half window; for shorter items also windows of `WINDOW`
words. Their weights are those of the item's words and of its latent words. A passage is a candidate where its cosine
with the item is `MIN_COSINE`, in the latent space or in that of the words. Candidates, with half a window on both
sides, are checked against the item's words: the longest common subsequence must reach `MIN_LCS` of the item, and
`MIN_ANSWER` of the answer's distinct words must stand in the passage. The answer is the column `answer` where there is
one, else the item's last sentence. TF is the square root of the count; words outside the items weigh as if seen in one
document.

Edge cases: null or empty texts and items hold no words and match nothing; very long texts are windowed whole;
items longer than `ITEM_WORDS` words are cut into parts, each of which is enough; repeated rows are decided one by
one, alike; an empty table or benchmark finds nothing; internal columns are not added to the documents.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.shipping import ship
from siltstone.llm.common import alnum_words, ranges, slices, stored, tidy, utf8

WAVE_ITEMS, BLOCK_ITEMS, FIT_BLOCKS, RANK, POWER_ROUNDS, OVERSAMPLE, LATENT_WORDS = 16_384, 256, 4, 256, 1, 8, 128
BLOCK_WORDS, HEAD_WORDS, BATCH_BYTES, PASSAGES = 4096, 256, 1 << 18, 1024
WINDOW, STEP, ITEM_WORDS, LEAST_WINDOW, CHUNK_ROWS, KEPT_ITEMS = 64, 32, 64, 8, 128, 4096
MIN_COSINE, MIN_LCS, MIN_ANSWER = 0.2, 0.6, 0.5


def item_parts(text: str | None, answer: str | None = None) -> list[tuple[list[bytes], frozenset[bytes]]]:
    """(words, answer words) of an item, cut into parts of at most ITEM_WORDS words."""
    words = alnum_words((text or "").encode())
    if not words:
        return []
    if answer is None:
        sentences = [s for s in re.split(r"[.!?]+\s*", text or "") if alnum_words(s.encode())]
        answer = sentences[-1]
    wanted = frozenset(alnum_words(answer.encode()))
    n = math.ceil(len(words) / ITEM_WORDS)
    cuts = [len(words) * k // n for k in range(n + 1)]
    parts = [words[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    return [(p, wanted if n == 1 or wanted <= set(p) else frozenset()) for p in parts]


def common_subsequence(masks: dict, size: int, words: list) -> int:
    """Length of the longest common subsequence, bit-parallel; masks holds each item word's places."""
    full = (1 << size) - 1
    v = full
    for w in words:
        m = masks.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def place_masks(words: list) -> dict:
    out: dict = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


class Item:
    """What a search needs of one item."""

    __slots__ = ("answer", "held", "latent", "masks", "need", "plain", "rare", "size", "support", "windows")

    def __init__(self, words: list[int], answer: frozenset[int], need: float, rare: set[int], plain: dict[int, float], latent: dict[int, float]):
        self.size, self.answer, self.need, self.rare = len(words), answer, need, rare
        self.held, self.masks, self.plain, self.latent = Counter(words), place_masks(words), plain, latent
        self.support = plain.keys() | latent.keys()
        own = min(WINDOW, max(LEAST_WINDOW, 1 << (len(words) - 1).bit_length()))
        self.windows = (own,) if own == WINDOW else (own, WINDOW)


class Index:
    """Items with their vocabulary, weights, rarest words and, after fit(), latent vectors. Held in flat arrays."""

    def __init__(self, items: list[tuple]):
        self.names = [x[0] for x in items]
        vocabulary = sorted({w for x in items for w in x[1]} | {w for x in items for w in x[2]})
        self.ids = {w: i + 1 for i, w in enumerate(vocabulary)}
        self.words = [np.array([self.ids[w] for w in x[1]], dtype=np.int32) for x in items]
        self.answers = [frozenset(self.ids[w] for w in x[2]) for x in items]
        self.need = [MIN_LCS * len(x[1]) - 1e-9 for x in items]
        self.rare: list[np.ndarray] = []
        self.where: dict[int, list[int]] = {}
        self.anchored = self.idf = None
        self.latent: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int32), np.zeros(0, np.float32))] * len(items)

    def weigh(self, frequencies: dict[int, int], rows: int) -> None:
        n = np.array([1] + [frequencies.get(i, 0) for i in range(1, len(self.ids) + 1)], dtype=np.float64)
        self.idf = np.log((1.0 + rows) / (1.0 + np.minimum(n, rows))).astype(np.float32) + np.float32(0.01)
        self.anchored = np.zeros(len(n), dtype=bool)
        self.rare, self.where = [], {}
        for k, words in enumerate(self.words):
            order = sorted(words.tolist(), key=lambda i: (n[i], i))
            rare = sorted(set(order[: len(order) - math.ceil(self.need[k]) + 1]))
            self.rare.append(np.array(rare, dtype=np.int32))
            self.anchored[rare] = True
            for w in rare:
                self.where.setdefault(w, []).append(k)

    def weights(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct words of the items and their weights (not normalised)."""
        got, n = np.unique(ids[ids > 0], return_counts=True)
        return got, np.sqrt(n).astype(np.float32) * self.idf[got]

    def unit(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        got, weight = self.weights(self.words[k])
        return got, weight / np.linalg.norm(weight)

    def item(self, k: int) -> Item:
        got, weight = self.unit(k)
        ids, latent = self.latent[k]
        return Item(self.words[k].tolist(), self.answers[k], self.need[k], set(self.rare[k].tolist()), dict(zip(got.tolist(), weight.tolist(), strict=True)), dict(zip(ids.tolist(), latent.tolist(), strict=True)))


class Searcher:
    """The index with the items asked for most recently, in a worker."""

    def __init__(self, index: Index):
        self.index, self.item = index, lru_cache(KEPT_ITEMS)(index.item)

    def search(self, words: list[bytes], first_only: bool = False) -> dict[int, tuple[float, float, float, int]]:
        """Item number -> (cosine, common subsequence share, answer share, first word of the passage), best of each."""
        index, out = self.index, {}
        ids = np.fromiter(map(index.ids.get, words, repeat(0)), dtype=np.int64, count=len(words))
        anchors = index.anchored[ids]
        if not anchors.any():
            return out
        line = ids.tolist()
        times = Counter(line)
        at_rare: dict[int, list[int]] = {}
        for p in np.flatnonzero(anchors).tolist():
            at_rare.setdefault(line[p], []).append(p)
        near = {k for w in at_rare for k in index.where[w]}
        passages: dict[tuple[int, int], dict[int, float]] = {}
        places: dict[int, list[int]] | None = None
        for k in sorted(near):
            item = self.item(k)
            if sum([min(n, times[w]) for w, n in item.held.items() if w in times]) < item.need:
                continue
            if places is None:
                places = {}
                for p, w in enumerate(line):
                    if w:
                        places.setdefault(w, []).append(p)
            at_words = sorted([p for w in item.held if w in places for p in places[w]])
            rare = sorted([p for w in item.rare if w in at_rare for p in at_rare[w]])
            if self._sought(k, item, line, at_words, rare, passages, out) and first_only:
                break
        return out

    def _sought(self, k: int, item: Item, line: list[int], at_words: list[int], rare: list[int], passages: dict, out: dict) -> bool:
        """Keeps the item's best passage in `out`; whether there is one."""
        size, idf = len(line), self.index.idf
        for window in item.windows:
            step, done = window // 2, -1
            last = max(0, -(-(size - window) // step))  # the last window's number
            for p in rare:  # windows that hold the rare word, with half a window on both sides
                for j in range(max(done + 1, (p - window - step) // step + 1), min(last, (p + step) // step) + 1):
                    done, at = j, j * step
                    low, high = max(at - step, 0), min(at + window + step, size)
                    a, b = bisect_left(at_words, low), bisect_left(at_words, high)
                    if b - a < item.need or not enough([line[x] for x in at_words[a:b]], item.held, item.need):
                        continue
                    if (at, window) not in passages:
                        passages[at, window] = {w: math.sqrt(n) * float(idf[w]) for w, n in Counter(line[at : at + window]).items() if w}
                    found = passages[at, window]
                    mine = [(w, found[w]) for w in item.support if w in found]
                    square = sum([x * x for _, x in mine])
                    if not square:
                        continue
                    plain = sum([x * item.plain[w] for w, x in mine if w in item.plain])
                    latent = sum([x * item.latent[w] for w, x in mine if w in item.latent])
                    cosine = max(plain, latent) / math.sqrt(square)
                    if cosine < MIN_COSINE:
                        continue
                    region = line[low:high]
                    share = common_subsequence(item.masks, item.size, region) / item.size
                    told = len(item.answer.intersection(region)) / len(item.answer) if item.answer else 1.0
                    if share >= MIN_LCS and told >= MIN_ANSWER and (k not in out or share > out[k][1]):
                        out[k] = (cosine, share, told, at)
        return k in out


def enough(words: list[int], held: dict[int, int], need: float) -> bool:
    """Whether the words, each at most as often as held, are `need` or more; no common subsequence is longer."""
    left: dict[int, int] = {}
    n = 0
    for w in words:
        more = left.get(w, held[w])
        if more:
            left[w] = more - 1
            n += 1
            if n >= need:
                return True
    return False


def times_gram(rows, basis: np.ndarray) -> np.ndarray:
    """A^T A G of sparse rows (ids, weights); G has a row per word id."""
    out = np.zeros_like(basis)
    for ids, weight in rows:
        y = weight @ basis[ids]
        out[ids] += weight[:, None] * y[None, :]
    return out


class Gram:
    """Sum of the outer products of sparse rows, its lower triangle: dense for the first words, the others pair by pair."""

    def __init__(self, words: int):
        self.words, self.head, self.rows = words, min(HEAD_WORDS, words), 0
        self.dense = np.zeros((self.head, self.head))
        self.base = self.head * (self.head + 1) // 2
        self.tail = np.zeros(words * (words + 1) // 2 - self.base, dtype=np.float32)

    def add(self, row: np.ndarray, word: np.ndarray, weight: np.ndarray) -> None:
        """Entries in the order of their rows (numbers from 0) and words; a word stands once in a row."""
        if not len(row):
            return
        self.rows += int(np.count_nonzero(np.diff(row))) + 1
        inside = word < self.head
        part = np.zeros((int(row[-1]) + 1, self.head), dtype=np.float32)
        part[row[inside], word[inside]] = weight[inside]
        self.dense += part.T @ part
        last = np.flatnonzero(~inside)  # with all words up to it in its row
        start = np.searchsorted(row, row[last])
        each = last - start + 1
        first = ranges(start, each)
        at = np.repeat(word[last] * (word[last] + 1) // 2 - self.base, each)
        at += word[first]
        np.add.at(self.tail, at, np.repeat(weight[last], each) * weight[first])

    def chunk(self, low: int) -> tuple[np.ndarray, np.ndarray]:
        """Of CHUNK_ROWS rows from `low`: places (row by row, as wide as there are words) and values, zeros left out."""
        out = np.zeros((min(CHUNK_ROWS, self.words - low), self.words), dtype=np.float32)
        for i in range(low, low + len(out)):
            start = i * (i + 1) // 2 - self.base
            out[i - low, : i + 1] = self.dense[i, : i + 1] if i < self.head else self.tail[start : start + i + 1]
        at = np.flatnonzero(out)
        return at.astype(np.int32), out.ravel()[at]


def entries(lines: list[np.ndarray], idf: np.ndarray, place: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of all passages of texts (word ids, 0 for other words): row, the word's place and its weight, `PASSAGES` at a time.
    Words without a place (-1) count in a passage's norm only."""
    sizes = np.array([len(x) for x in lines], dtype=np.int64)
    flat, first = np.concatenate(lines), np.cumsum(sizes) - sizes
    square = np.concatenate(([0.0], np.cumsum(idf[flat].astype(np.float64) ** 2)))
    per = np.where(sizes > 0, np.maximum(1, -(-(sizes - WINDOW + STEP) // STEP)), 0)
    text = np.repeat(np.arange(len(lines)), per)
    low = first[text] + (np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)) * STEP
    high = np.minimum(low + WINDOW, (first + sizes)[text])
    norm = np.sqrt(np.maximum(square[high] - square[low], 1e-12))
    local, own = place[flat], np.zeros(int(place.max()) + 1)
    own[place[place >= 0]] = idf[place >= 0]
    held = np.flatnonzero(local >= 0)
    a, b = np.searchsorted(held, low), np.searchsorted(held, high)
    for k in range(0, len(text), PASSAGES):
        each = b[k : k + PASSAGES] - a[k : k + PASSAGES]
        key = np.repeat(np.arange(len(each)) * len(place), each)
        key += local[held[ranges(a[k : k + PASSAGES], each)]]
        got, n = np.unique(key, return_counts=True)
        row, word = np.divmod(got, len(place))
        yield row, word, (np.sqrt(n) * own[word] / norm[k + row]).astype(np.float32)


def frequencies(df: DataFrame, index: Index, text: str) -> tuple[dict[int, int], int]:
    """Documents that hold each word of the items, and all documents. The result has at most a row per word."""
    ids = df.sparkSession.sparkContext.broadcast(index.ids)

    def run(batches):
        known, found, rows = ids.value, Counter(), 0
        for batch in batches:
            for raw in utf8(batch, text):
                rows += 1
                found.update(known.keys() & set(alnum_words(raw or b"")))
        keys = list(found)
        yield pa.RecordBatch.from_arrays([pa.array([0] + [known[w] for w in keys], pa.int32()), pa.array([rows] + [found[w] for w in keys], pa.int64())], names=["id", "n"])

    got = {r["id"]: r["n"] for r in df.select(text).mapInArrow(tidy(run), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()}
    return got, got.pop(0, 0)


def fit(index: Index, docs: DataFrame, members: list[list[int]], rank: int | None = None, seed: int = 11, text: str = "text") -> None:
    """Latent vectors of the items of some blocks (their numbers), by randomised SVD over the passages of all rows and the
    items. The Gram matrix is summed over partitions, block by block and chunk by chunk."""
    spark = docs.sparkSession
    words = [np.unique(np.concatenate([index.words[k] for k in block])) for block in members]
    words = [mine[np.argsort(index.idf[mine], kind="stable")] for mine in words]  # most frequent first
    places = np.full((len(members), len(index.ids) + 1), -1, dtype=np.int32)
    for place, mine in zip(places, words, strict=True):
        place[mine] = np.arange(len(mine))
    sizes = [len(mine) for mine in words]
    shared = spark.sparkContext.broadcast((index.ids, index.idf, places))
    names = ["block", "at", "n", "places", "parts"]

    def one(block: int, at: int, n: int, where: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
        arrays = [pa.array([block], pa.int32()), pa.array([at], pa.int32()), pa.array([n], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (where, part))]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def summed(batches):
        ids, idf, own = shared.value
        grams = [Gram(size) for size in sizes]
        for whole in batches:
            for batch in slices([whole.set_column(0, "text", whole.column(0).cast(pa.binary()))], "text", BATCH_BYTES):
                split = [alnum_words(raw or b"") for raw in batch.column(0).to_pylist()]
                lines = [np.fromiter(map(ids.get, x, repeat(0)), dtype=np.int64, count=len(x)) for x in split]
                for g, place in zip(grams, own, strict=True):
                    for got in entries(lines, idf, place):
                        g.add(*got)
        for b, g in enumerate(grams):
            for low in range(0, g.words, CHUNK_ROWS):
                where, part = g.chunk(low)
                if low == 0 or len(where):
                    yield one(b, low, 0 if low else g.rows, where, part)

    def added(batches):
        """Rows come in the order of block and chunk."""
        held = total = None
        n = 0

        def done():
            where = np.flatnonzero(total)
            return one(*held, n, where.astype(np.int32), total[where].astype(np.float32))

        for batch in batches:
            for r in zip(*(batch.column(x) for x in names), strict=True):
                block, at, more = (x.as_py() for x in r[:3])
                if (block, at) != held:
                    if held is not None:
                        yield done()
                    held, n, total = (block, at), 0, np.zeros(CHUNK_ROWS * sizes[block])
                n += more
                total[np.frombuffer(r[3].as_py(), dtype=np.int32)] += np.frombuffer(r[4].as_py(), dtype=np.float32)
        if held is not None:
            yield done()

    kind = "block int, at int, n long, places binary, parts binary"
    parts = docs.select(text).mapInArrow(tidy(summed), kind)
    rows = stored(parts.repartition("block", "at").sortWithinPartitions("block", "at").mapInArrow(tidy(added), kind), "gram")
    counts = {r["block"]: r["n"] for r in rows.where("at = 0").select("block", "n").collect()}
    units = [[(place[i], w) for i, w in map(index.unit, block)] for place, block in zip(places, members, strict=True)]

    def gram(bases: list[np.ndarray]) -> list[np.ndarray]:
        sent = spark.sparkContext.broadcast(bases)

        def run(batches):
            out: dict[int, np.ndarray] = {}
            for batch in batches:
                for b, at, where, part in zip(*(batch.column(x).to_pylist() for x in ("block", "at", "places", "parts")), strict=True):
                    basis = sent.value[b]
                    lower = np.zeros((min(CHUNK_ROWS, sizes[b] - at), sizes[b]), dtype=np.float32)
                    lower.ravel()[np.frombuffer(where, dtype=np.int32)] = np.frombuffer(part, dtype=np.float32)
                    if b not in out:
                        out[b] = np.zeros_like(basis)
                    out[b][at : at + len(lower)] += lower @ basis
                    lower[np.arange(len(lower)), at + np.arange(len(lower))] = 0
                    out[b] += lower.T @ basis[at : at + len(lower)]
            for b, part in out.items():
                for at in range(0, len(part), 8 * CHUNK_ROWS):
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([at], pa.int32()), pa.array([part[at : at + 8 * CHUNK_ROWS].tobytes()], pa.binary())], names=["block", "at", "part"])

        def add(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x, dtype=np.float32).astype(np.float64) for x in table.column("part").to_pylist())
            return pa.table({"block": table.column("block").slice(0, 1), "at": table.column("at").slice(0, 1), "part": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

        kept = "block int, at int, part binary"
        found = rows.mapInArrow(tidy(run), kept).groupBy("block", "at").applyInArrow(add, kept).collect()
        out = [max(1, counts.get(b, 0)) / len(u) * times_gram(u, g) for b, (u, g) in enumerate(zip(units, bases, strict=True))]
        for r in found:
            part = np.frombuffer(r["part"], dtype=np.float32).reshape(-1, bases[r["block"]].shape[1])
            out[r["block"]][r["at"] : r["at"] + len(part)] += part
        sent.destroy()
        return out

    widths = [min((rank or max(RANK, len(block))) + OVERSAMPLE, len(mine)) for mine, block in zip(words, members, strict=True)]
    rng = np.random.default_rng(seed)
    bases = [rng.standard_normal((len(mine), width)).astype(np.float32) for mine, width in zip(words, widths, strict=True)]
    for _ in range(POWER_ROUNDS + 1):
        bases = [np.linalg.qr(g.astype(np.float64))[0].astype(np.float32) for g in gram(bases)]
    for b, (basis, product, block) in enumerate(zip(bases, gram(bases), members, strict=True)):
        values, turn = np.linalg.eigh((basis.T @ product).astype(np.float64))
        space = basis @ turn[:, np.argsort(-values)[: rank or max(RANK, len(block))]].astype(np.float32)
        for k, (i, w) in zip(block, units[b], strict=True):
            latent = w @ space[i]
            smooth = space @ (latent / max(float(np.linalg.norm(latent)), 1e-9))
            top = np.sort(np.argsort(-np.abs(smooth), kind="stable")[:LATENT_WORDS])
            index.latent[k] = words[b][top].astype(np.int32), smooth[top].astype(np.float32)


def item_blocks(index: Index) -> list[list[int]]:
    """Items in their order, cut into blocks of at most BLOCK_ITEMS items and BLOCK_WORDS distinct words."""
    out, held = [[]], set()
    for k, words in enumerate(index.words):
        more = held.union(words.tolist())
        if out[-1] and (len(out[-1]) == BLOCK_ITEMS or len(more) > BLOCK_WORDS):
            out.append([])
            more = set(words.tolist())
        out[-1].append(k)
        held = more
    return out


def indexes(df: DataFrame, benchmark: DataFrame, text: str, item_id: str, item_text: str) -> Iterator[Index]:
    """Fitted indexes of at most WAVE_ITEMS items (about), one at a time."""
    ship(df.sparkSession)
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    items = benchmark.select(F.col(item_id).alias("i"), F.col(item_text).alias("t"), answer.alias("a"))
    waves = math.ceil(items.count() / WAVE_ITEMS)
    for wave in range(waves):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(waves)) == wave).collect()
        parts = [(r["i"], words, wanted) for r in sorted(rows, key=lambda r: (str(r["i"]), r["t"] or "")) for words, wanted in item_parts(r["t"], r["a"])]
        if not parts:
            continue
        index = Index(parts)
        found, n = frequencies(df, index, text)
        index.weigh(found, n)
        blocks = item_blocks(index)
        for a in range(0, len(blocks), FIT_BLOCKS):
            fit(index, df, blocks[a : a + FIT_BLOCKS], text=text)
        yield index


def contaminated(df: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, cosine, lcs, answer, first_word."""
    item_type = benchmark.schema[item_id].dataType
    schema = T.StructType([df.schema[doc_id], T.StructField("item_id", item_type), *(T.StructField(x, T.DoubleType()) for x in ("cosine", "lcs", "answer")), T.StructField("first_word", T.LongType())])
    out = df.sparkSession.createDataFrame([], schema)
    sc = df.sparkSession.sparkContext
    for index in indexes(df, benchmark, text, item_id, item_text):
        shared = sc.broadcast(index)

        def run(batches, shared=shared):
            searcher = Searcher(shared.value)
            for batch in batches:
                took, rows = [], []
                for i, raw in enumerate(utf8(batch, text)):
                    best: dict = {}
                    for k, x in searcher.search(alnum_words(raw or b"")).items():
                        name = shared.value.names[k]
                        if name not in best or x[1] > best[name][1]:
                            best[name] = x
                    took += [i] * len(best)
                    rows += [(name, *x) for name, x in best.items()]
                kinds = [_arrow(item_type)] + [pa.float64()] * 3 + [pa.int64()]
                cols = [pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(took, pa.int64())), *cols], names=schema.names)

        out = out.unionByName(df.select(doc_id, text).mapInArrow(tidy(run), schema))
    return out


def without_benchmark(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of df, all columns, whose text holds no item."""
    sc, out = df.sparkSession.sparkContext, df
    for index in indexes(df, benchmark, text, item_id, item_text):
        shared = sc.broadcast(index)

        def run(batches, shared=shared):
            searcher = Searcher(shared.value)
            for batch in batches:
                yield batch.filter(pa.array([not searcher.search(alnum_words(raw or b""), first_only=True) for raw in utf8(batch, text)], pa.bool_()))

        out = out.mapInArrow(tidy(run), df.schema)
    return out


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
