"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds a bounded sample of labelled text (`DOCS` distinct texts and `SAMPLE_BYTES`
bytes, lowest hash of the id first; fewer bytes where the automata of all languages would exceed `TABLE_BYTES`). A text
is parsed against each automaton into longest matches, from its first byte to its last; the language with the fewest
phrases wins, normalised as phrases * log2(sample length) / text length. Texts are lower-cased letters, words parted by
one space.

Blocks of `BLOCK_BYTES` are parsed side by side, each as if a phrase began with it. Where one does not, the block is
parsed again from the state that its forerunner ends in, until both parses are in one state (from there on they agree);
if they never are, the next block is corrected in turn. The phrases are those of a parse of the whole text.

The automaton is a dense table over the byte classes of the samples. A missing transition falls back to the root
and carries the number of phrases that end there: the one under way, and a byte that the sample lacks altogether.

Edge cases: null text and text without a letter are `und` with score 0; with no labelled rows everything is `und`;
equal entropies go to the first language in name order; repeated rows are predicted alike; an empty table gives an
empty result; only the columns named are read, so extra columns cannot clash.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.common import tidy

DOCS, SAMPLE_BYTES, TABLE_BYTES, BLOCK_BYTES, BATCH_BYTES = 64, 40_000, 1 << 27, 1024, 1 << 20
WORDS = re.compile(r"[^\W\d_]+")


def letters(text: str | None) -> bytes:
    """Lower-cased words of letters, parted by one space; empty if no character is a letter."""
    words = WORDS.findall((text or "").lower())
    if not any(c.isalpha() for w in words for c in w):
        return b""
    return " ".join(words).encode("utf-8", "replace")


def suffix_automaton(data: bytes) -> list[dict[int, int]]:
    """Transitions of each state by byte; state 0 is the root. Recognises the substrings of data."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in data:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return moves


class Parsers:
    """The automata of all languages in one table. An entry is 4 * (next row) + phrases that end."""

    def __init__(self, samples: dict[str, bytes]):
        self.names = sorted(samples)
        seen = sorted(set().union(*samples.values()))
        self.classes = np.zeros(256, dtype=np.int32)  # class 0: bytes that no sample has
        self.classes[seen] = np.arange(1, len(seen) + 1)
        width = len(seen) + 1
        tables, self.roots, at = [], [], 0
        for name in self.names:
            moves = suffix_automaton(samples[name])
            follow = np.full((len(moves), width), -1, dtype=np.int64)
            for s, out in enumerate(moves):
                if out:
                    follow[s, self.classes[list(out)]] = list(out.values())
            root, missing = follow[0].copy(), follow < 0
            ended = np.where(missing, 1 + (root < 0), 0)  # the phrase under way, and a lone unseen byte
            ended[0] = root < 0
            target = np.where(missing, np.where(root < 0, 0, root), follow)
            tables.append(((at + target * width) * 4 + ended).astype(np.int32).ravel())
            self.roots.append(at)
            at += len(moves) * width
        self.table = np.concatenate(tables)
        self.cost = np.array([math.log2(max(2, len(samples[n]))) for n in self.names])

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Phrases of each text by each language."""
        blocks = [(i, a) for i, t in enumerate(texts) for a in range(0, len(t), BLOCK_BYTES)]
        out = np.zeros((len(texts), len(self.names)), dtype=np.int64)
        if not blocks:
            return out
        sizes = np.array([min(BLOCK_BYTES, len(texts[i]) - a) for i, a in blocks])
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        codes = np.zeros((len(blocks), int(sizes[0])), dtype=np.int32)
        for row, k in enumerate(order.tolist()):
            i, a = blocks[k]
            codes[row, : sizes[row]] = self.classes[np.frombuffer(texts[i][a : a + BLOCK_BYTES], dtype=np.uint8)]
        codes = np.ascontiguousarray(codes.T)
        roots = np.array(self.roots, dtype=np.int32)[:, None]
        state = np.repeat(roots, len(blocks), axis=1)
        count = np.zeros(state.shape, dtype=np.int32)
        live = np.searchsorted(-sizes, -np.arange(len(codes)), side="left").tolist()  # blocks longer than t
        for t in range(len(codes)):
            n = live[t]
            got = self.table.take(state[:, :n] + codes[t, :n])
            count[:, :n] += got & 3
            state[:, :n] = got >> 2
        place = np.empty(len(blocks), dtype=np.int64)  # column of each block
        place[order] = np.arange(len(blocks))
        goes_on = [k for k in range(len(blocks) - 1) if blocks[k + 1][0] == blocks[k][0]]
        later = np.full(len(blocks), -1, dtype=np.int64)  # column of the block that follows in the text
        later[place[goes_on]] = place[[k + 1 for k in goes_on]]
        self._correct(codes, sizes, state, count, later)
        last = later < 0
        count[:, last] += state[:, last] != roots  # the phrase that the text's end cuts
        np.add.at(out, np.array([blocks[k][0] for k in order]), count.T)
        return out

    def _correct(self, codes: np.ndarray, sizes: np.ndarray, state: np.ndarray, count: np.ndarray, later: np.ndarray) -> None:
        """Counts and end states of blocks that were parsed from the root, as they are from their forerunner's end state."""
        roots = np.array(self.roots, dtype=np.int32)
        added, first_end = np.zeros_like(count), state.copy()
        lang, block = np.nonzero((state != roots[:, None]) & (later >= 0)[None, :])
        start, block = state[lang, block], later[block]
        while len(lang):
            true, guess = start.copy(), roots[lang].copy()
            extra, t = np.zeros(len(lang), dtype=np.int32), 0
            todo = np.arange(len(lang))
            open_end = np.zeros(len(lang), dtype=bool)  # never in one state
            while len(todo):
                over = sizes[block[todo]] <= t
                open_end[todo[over]] = True
                todo = todo[~over]
                code = codes[t, block[todo]] if len(todo) else codes[0, :0]
                a, b = self.table.take(true[todo] + code), self.table.take(guess[todo] + code)
                extra[todo] += (a & 3) - (b & 3)
                true[todo], guess[todo] = a >> 2, b >> 2
                todo = todo[a >> 2 != b >> 2]
                t += 1
            count[lang, block] += extra - added[lang, block]
            added[lang, block] = extra
            end = np.where(open_end, true, first_end[lang, block])
            again = state[lang, block] != end
            state[lang, block] = end
            again &= later[block] >= 0
            lang, block = lang[again], block[again]
            start, block = state[lang, block], later[block]

    def best(self, texts: list[bytes]) -> list[tuple[str, float]]:
        """(language, score) of each text; score is the runner-up's share of the two entropies."""
        rates = self.phrases(texts) * self.cost
        out = []
        for text, row in zip(texts, rates, strict=True):
            if not text:
                out.append(("und", 0.0))
                continue
            first = int(np.argmin(row))
            rest = np.delete(row, first)
            out.append((self.names[first], float(rest.min() / (rest.min() + row[first])) if len(rest) else 1.0))
        return out


def learn(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", use: Column | None = None) -> Parsers | None:
    """Parsers from the rows where `use` holds and lang and text are given."""
    rows = df.select(F.col(doc_id).cast("string").alias("i"), F.col(text).alias("t"), F.col(lang).alias("l"), (F.lit(True) if use is None else use).alias("u"))
    rows = rows.where(F.col("u") & F.col("l").isNotNull() & F.col("t").isNotNull()).withColumn("h", F.xxhash64("i"))
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    top = 2.0**63
    limits = df.sparkSession.createDataFrame([(k, float(min(1.0, 4.0 * DOCS / n) * 2 * top - top)) for k, n in counts.items()], "l string, most double")
    few = rows.join(F.broadcast(limits), "l").where(F.col("h") <= F.col("most")).select("l", "h", "i", F.substring("t", 1, SAMPLE_BYTES).alias("t"))
    once = few.groupBy("l", "t").agg(F.min(F.struct("h", "i")).alias("first")).select("l", "t", "first.*")
    ranked = once.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("h", "i", "t"))).where(F.col("r") <= DOCS)
    samples: dict[str, bytes] = {}
    for r in sorted(ranked.select("l", "r", "t").collect(), key=lambda r: (r["l"], r["r"])):
        have = samples.get(r["l"], b"")
        if len(have) < SAMPLE_BYTES:
            samples[r["l"]] = (have + letters(r["t"]) + b"\n")[:SAMPLE_BYTES]
    # An automaton has at most two states a byte, each with four bytes for every class of bytes.
    most = TABLE_BYTES // (8 * (1 + len(set().union(*samples.values()))) * max(1, len(samples)))
    samples = {k: v[: max(1, most)] for k, v in samples.items()}
    samples = {k: v for k, v in samples.items() if v.strip()}
    return Parsers(samples) if samples else None


def identify(df: DataFrame, parsers: Parsers | None, keep: list[str], text: str = "text") -> DataFrame:
    """`keep` columns, lang_pred and score, from the text alone."""
    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = df.sparkSession.sparkContext.broadcast(parsers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            got: list[tuple[str, float]] = []
            held, size = [], 0

            def flush(got=got):
                got.extend(model.best(held) if model else [("und", 0.0)] * len(held))
                held.clear()

            for x in batch.column(text).to_pylist():
                held.append(letters(x))
                size += len(held[-1])
                if size > BATCH_BYTES:
                    flush()
                    size = 0
            flush()
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], names=schema.names)

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(tidy(run), schema)
