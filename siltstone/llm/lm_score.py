"""LM scoring by online logistic context mixing, and a smoothed unigram base score.

A text is its words (A-Z lower-cased, parted by white space), each followed by a space, then one end symbol. Symbols
are coded in bits along a Huffman tree of the training bytes. Each bit has several predictors, one for each hashed
context, with the tree node: the byte before, the two before, the three before, the whole word so far, and, in the
first `JOINT` bytes of a word, the last two bytes of the word before with the word so far. A predictor's counts of zeros
and ones cover all training rows. The first four contexts end with the word, so their counts are summed over the table
of distinct words times their counts, which is exact; those of the fifth are summed over the table of distinct
transitions. Both tables grow with the corpus; the hash tables of the fourth and fifth predictor grow with the distinct
words, from 2^`LEAST_BITS` to 2^`MOST_BITS` counters (the broadcast holds one byte for each).

The predictors' logits are mixed by weights that a gate selects (the place in the word, and how deep in the tree),
fitted on the bits of all training rows by Newton steps: what the predictors say of the first `JOINT` bytes of a word
follows from its transition, of all others from the word, so sums over the two tables, with their counts, are those over the
rows. Bits that look alike to the mixer are counted together once, and the steps are taken with these counts. The gated
weights are refined adaptively: to them is added a correction that starts at zero with a text and runs through all of
it, moving along the coding gradient after every `BLOCK_BITS` bits (counted anew after `PIECE_WORDS` words, which bounds
what is in memory). The sum of log10 over bits is the score; the bits per coded byte follow from it. What the predictors say
of a text is laid out from the bits of its transitions and words, which a worker prepares once for each that it meets
(it starts anew after `HELD_BITS` bits); the corrections walk through `LANES` texts side by side, dealt from batches of
`WALK_BITS` bits together, since a long text holds up its lane only.

Base counts come from the same table of words. Its `HEAD` most frequent words (fewer where counts tie) are broadcast, as
numbers rather than Python's bytes; the rest are joined by word.

Edge cases: null text counts as empty and is one end token; without training rows every count is zero and the score
is that of the untrained mixer; repeated rows are scored alike; very long texts stand in a batch of their own and adapt
from first to last; a null id counts as empty text for the split; an empty table gives an empty result; columns may have
any name.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import compress, count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.scratch import fresh
from siltstone.llm.common import ranges, slices, stored, tidy

ORDERS, JOINT = 5, 3  # the last predictor crosses words
SMALL_BITS, LEAST_BITS, MOST_BITS = (14, 17, 19), 18, 22
END = b"\xff"
HEAD, FLUSH_WORDS, BATCH_BYTES, BLOCK_BITS, PREPARED, PIECE_WORDS = 500_000, 600_000, 1 << 19, 256, 20_000, 200_000
SCORE_BYTES, HELD_BITS, NEW_UNITS, LANES, WIDE, LOOKUP_BITS, JOINT_BITS = 1 << 20, 12_000_000, 4096, 64, 8, 19, 18
WALK_BITS, RUN, FINE = 1 << 23, 1 << 16, 24  # a line's last four bytes count 2^-FINE
ROUNDS, ALIKE, LOW_BITS = 6, 2_000_000, 19
RATE, CLIP, STEPS_OF_LOGIT, GATES, CHUNK = 0.006, 7.9375, 16, 16, 1 << 16
_P, _SPREAD = np.uint64(0x9E3779B97F4A7C15), 0x85EBCA6B
_PRIME = 1_000_003
_INVERSE = pow(_PRIME, -1, 1 << 64)
SHORT, SOLID = 15, np.array([not bytes([b]).isspace() for b in range(256)])
KEPT_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)  # the lowest k bytes


class Slots:
    """Where each predictor's counters lie in one table."""

    def __init__(self, distinct: int):
        grown = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(16 * max(1, distinct)))))
        self.bits = (*SMALL_BITS, grown, grown)
        self.starts = tuple(sum(1 << b for b in self.bits[:i]) for i in range(ORDERS))
        self.total = sum(1 << b for b in self.bits)

    def place(self, order: int, context: np.ndarray, source: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Slots of bits from 64-bit contexts of bytes, each bit's byte, and 32-bit nodes."""
        out = (context * _P >> np.uint64(32)).astype(np.uint32).take(source)
        out += node
        out >>= np.uint32(32 - self.bits[order])
        out += np.uint32(self.starts[order])
        return out


class Code:
    """Huffman code of all 256 bytes: for each byte its tree nodes and bits."""

    def __init__(self, counts: np.ndarray):
        heap = [(float(c) + 1e-3, b, b) for b, c in enumerate(counts)]
        heapq.heapify(heap)
        children, serial = {}, 256
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            children[serial] = (a[2], b[2])
            heapq.heappush(heap, (a[0] + b[0], serial, serial))
            serial += 1
        paths: list[list[tuple[int, int]]] = [[] for _ in range(256)]
        todo: list[tuple[int, list[tuple[int, int]]]] = [(serial - 1, [])]
        while todo:
            at, path = todo.pop()
            if at < 256:
                paths[at] = path
            else:
                for bit, child in enumerate(children[at]):
                    todo.append((child, [*path, (at - 256, bit)]))
        self.length = np.array([len(p) for p in paths], dtype=np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.node = np.array([n * _SPREAD % (1 << 32) for p in paths for n, _ in p], dtype=np.uint32)
        self.bit = np.array([b for p in paths for _, b in p], dtype=np.uint8)
        self.depth = np.array([min(i, 3) for p in paths for i in range(len(p))], dtype=np.int8)


def coded(units: list[bytes], code: Code, least: int = 0):
    """Bytes, their places in the unit, each unit's first byte and size; for each bit of the bytes from the place `least` on
    its byte, node, value, gate; these bits per unit."""
    data = np.frombuffer(b"".join(units), dtype=np.uint8)
    sizes = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(data), dtype=np.int64) - np.repeat(first, sizes)
    per_byte = code.length.take(data)
    if least:
        per_byte[place < least] = 0
    ends = np.concatenate((np.zeros(1, dtype=np.int64), np.cumsum(per_byte)))
    source = np.repeat(np.arange(len(data), dtype=np.int64), per_byte)
    at = (code.start.take(data) - ends[:-1]).take(source)
    at += np.arange(len(at), dtype=np.int64)
    gates = (np.minimum(place, 3) * 4).astype(np.int8).take(source)
    gates += code.depth.take(at)
    return data, place, first, sizes, source, code.node.take(at), code.bit.take(at), gates, ends[first + sizes] - ends[first]


def back(data: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """The byte k before, plus one; 0 beyond the unit's start."""
    out = np.zeros(len(data), dtype=np.uint64)
    out[k:] = data[: len(data) - k]
    out[k:] += np.uint64(1)
    out[place < k] = 0
    return out


def unit_bits(units: list[bytes], code: Code, table: Slots, before: np.ndarray | None = None, least: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of units (a word with its space, or the end symbol), from their byte `least` on: slots of the contexts inside the word
    (ORDERS - 1 x bits; where the ends of the words before are given, those across words follow), bits, gates, and bits per
    unit."""
    data, place, first, sizes, source, node, bit, gates, per_unit = coded(units, code, least)
    one = back(data, place, 1)
    two = one | back(data, place, 2) << np.uint64(9)
    three = two | back(data, place, 3) << np.uint64(18)
    power = np.full(len(data), _PRIME, dtype=np.uint64)
    inverse = np.full(len(data), _INVERSE, dtype=np.uint64)
    if len(data):
        power[0] = inverse[0] = 1
    power, inverse = np.multiply.accumulate(power), np.multiply.accumulate(inverse)
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power, dtype=np.uint64)))
    start = np.repeat(first, sizes)
    whole = (sums[:-1] - sums[start]) * inverse[start] if len(data) else one
    contexts = [one, two, three, whole]
    if before is not None:
        contexts.append(across(before, sizes, data, place))
    slots = np.empty((len(contexts), len(node)), dtype=np.uint32)
    for i, ctx in enumerate(contexts):
        slots[i] = table.place(i, ctx, source, node)
    return slots, bit, gates, per_unit


def across(before: np.ndarray, sizes: np.ndarray, data: np.ndarray, place: np.ndarray) -> np.ndarray:
    return np.repeat(before, sizes) << np.uint64(20) | back(data, place, 1) << np.uint64(9) | back(data, place, 2)


def ends_before(joints: list[bytes]) -> np.ndarray:
    """The last bytes of the word before, and how many, as one number."""
    return np.array([int.from_bytes(j[: j.index(b" ")], "little") * 3 + j.index(b" ") for j in joints], dtype=np.uint64)


def joint_unit(joint: bytes) -> bytes:
    """The bytes that a transition (last two bytes of a word, a space, first bytes of the next) predicts."""
    after = joint[joint.index(b" ") + 1 :]
    return END if not after else after if len(after) == JOINT else after + b" "


def joint_bits(joints: list[bytes], code: Code, table: Slots) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of transitions: slots, bits, gates, and bits of each."""
    data, place, _, sizes, source, node, bit, gates, per_unit = coded([joint_unit(j) for j in joints], code)
    ctx = across(ends_before(joints), sizes, data, place)
    return table.place(ORDERS - 1, ctx, source, node), bit, gates, per_unit


def logits(counts: np.ndarray) -> np.ndarray:
    """counts: slots x 2 -> the predictors' logits in steps of 1/STEPS_OF_LOGIT, one byte each."""
    x = np.clip(np.log((counts[:, 1] + 0.4) / (counts[:, 0] + 0.4)), -CLIP, CLIP)
    return np.round(x * STEPS_OF_LOGIT).astype(np.int8)


def signed(stretch: np.ndarray, slots: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Logits against the bit that follows."""
    x = stretch.take(slots).astype(np.float32)
    x *= np.array([1, -1], dtype=np.float32).take(bits) * np.float32(1 / STEPS_OF_LOGIT)
    return x


class Grown:
    """An array that grows at its end."""

    def __init__(self, kind: type, *wide: int, room: int = 1 << 12):
        self.held, self.n = np.zeros((room, *wide), dtype=kind), 0  # memory is taken when written to

    def add(self, part: np.ndarray) -> None:
        need = self.n + len(part)
        if need > len(self.held):
            more = np.zeros((max(need, 2 * len(self.held)), *self.held.shape[1:]), dtype=self.held.dtype)
            more[: self.n] = self.held[: self.n]
            self.held = more
        self.held[self.n : need] = part
        self.n = need


class Rows:
    """Bits of words (from the byte JOINT on) and of transitions (the bytes before), which together are those of a text: a
    line of eight bytes for each bit, its logits against it in steps of 1/STEPS_OF_LOGIT, then their gated sum in three bytes
    (read with the last logit as one number of four bytes, it is right to 2^(8 - FINE) / 2); where each word and transition
    begins and how many bits it has. The first BLOCK_BITS bits are zeros."""

    def __init__(self, mixer: Mixer, room: int = 1 << 12):
        self.mixer, self.x = mixer, Grown(np.int8, WIDE, room=room)
        self.words, self.joints = ((Grown(np.int64), Grown(np.int64)) for _ in range(2))
        self.x.add(np.zeros((BLOCK_BITS, WIDE), dtype=np.int8))

    def add_words(self, units: list[bytes]) -> None:
        """Of units (a word with its space, or the end symbol)."""
        for a in range(0, len(units), NEW_UNITS):
            some = units[a : a + NEW_UNITS]
            sizes = np.zeros(len(some), dtype=np.int64)
            long = np.fromiter(map(len, some), dtype=np.int64, count=len(some)) > JOINT
            if not long.any():
                self._place(self.words, sizes)
                continue
            slots, bits, gates, sizes[long] = unit_bits(list(compress(some, long.tolist())), self.mixer.code, self.mixer.table, least=JOINT)
            self._add(self.words, sizes, slots, bits, gates)

    def add_joints(self, units: list[bytes], before: np.ndarray) -> None:
        """Of transitions: what they predict, and the ends of the words before."""
        for a in range(0, len(units), NEW_UNITS):
            slots, bits, gates, sizes = unit_bits(units[a : a + NEW_UNITS], self.mixer.code, self.mixer.table, before[a : a + NEW_UNITS])
            self._add(self.joints, sizes, slots, bits, gates)

    def _add(self, kind: tuple[Grown, Grown], sizes: np.ndarray, slots: Iterable[np.ndarray], bits: np.ndarray, gates: np.ndarray) -> None:
        self._place(kind, sizes)
        gates = gates.astype(np.intp)
        sign, gated = np.array([1, -1], dtype=np.int8).take(bits), np.zeros(len(bits), dtype=np.float32)
        x = np.zeros((len(bits), WIDE), dtype=np.int8)
        for i, row in enumerate(slots):
            value = self.mixer.stretch.take(row)
            value *= sign
            x[:, i] = value
            part = (self.mixer.weights[:, i] * np.float32(1 / STEPS_OF_LOGIT)).take(gates)
            part *= value
            gated += part
        gated *= np.float32(1 << FINE)
        line = x.view(np.int32)[:, 1]
        gated -= line
        gated *= np.float32(1 / 256)
        line += np.rint(gated, out=gated).astype(np.int32) << 8
        self.x.add(x)

    def _place(self, kind: tuple[Grown, Grown], sizes: np.ndarray) -> None:
        kind[0].add(self.x.n + np.cumsum(sizes) - sizes)
        kind[1].add(sizes)


class Mixer:
    """Scores texts. weights: GATES x ORDERS, to which each text adds a correction of its own as it goes on."""

    def __init__(self, code: Code, table: Slots, stretch: np.ndarray):
        self.code, self.table, self.stretch = code, table, stretch
        self.weights = np.full((GATES, ORDERS), 0.3, dtype=np.float32)

    def prepared(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """ORDERS x bits: the inputs inside the word, and their gated sum; bits per unit."""
        slots, bits, gates, sizes = unit_bits(units, self.code, self.table)
        x = signed(self.stretch, slots, bits)
        return np.vstack([x, sum(row * self.weights[:, i].take(gates) for i, row in enumerate(x))]), sizes

    def fit(self, texts: list[bytes], rounds: int = ROUNDS) -> None:
        """Each gate's weights by Newton steps on the bits of the texts; the texts are coded anew in each round."""
        for _ in range(rounds):
            slope, bend = np.zeros((GATES, ORDERS)), np.zeros((GATES, ORDERS, ORDERS))
            for x, gates in (part for raw in texts for part in self.inputs(raw)):
                self.slopes(x, gates, np.ones(len(gates)), slope, bend)
            self.step(slope, bend)

    def slopes(self, x: np.ndarray, gates: np.ndarray, times: np.ndarray, slope: np.ndarray, bend: np.ndarray) -> None:
        """Adds to each gate's derivatives what bits (ORDERS x bits, each so many times) give."""
        order = np.argsort(gates.astype(np.int8), kind="stable")  # small kinds are sorted by counting
        x, times, cuts = x[:, order], times[order], np.searchsorted(gates[order], np.arange(GATES + 1))
        for g in range(GATES):
            xs, n = x[:, cuts[g] : cuts[g + 1]].astype(np.float64), times[cuts[g] : cuts[g + 1]]
            p = 1 / (1 + np.exp(self.weights[g] @ xs))
            slope[g] -= xs @ (n * (1 - p))
            bend[g] += (xs * (n * p * (1 - p))) @ xs.T

    def step(self, slope: np.ndarray, bend: np.ndarray, ridge: float = 1.0) -> None:
        slope = slope - ridge * (self.weights.astype(np.float64) - 0.3)
        bend = bend + ridge * np.eye(ORDERS)
        for g in range(GATES):
            self.weights[g] = np.clip(self.weights[g] + np.linalg.solve(bend[g], slope[g]), -1, 2)

    def alike(self, words: list[bytes], times: np.ndarray, joints: list[bytes], joint_times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of all bits of words from the byte JOINT on, and of transitions: keys (the gate and each predictor's logit against
        the bit, a byte each) and how often each occurs."""
        keys, counts = [], []
        long = [i for i, w in enumerate(words) if len(w) >= JOINT]
        for before, some, n in ((None, [words[i] + b" " for i in long], times[long]), (ends_before(joints), [joint_unit(j) for j in joints], joint_times)):
            if not some:
                continue
            slots, bits, gates, sizes = unit_bits(some, self.code, self.table, before, JOINT if before is None else 0)
            sign = np.array([1, -1], dtype=np.int8).take(bits)
            key = gates.astype(np.int64)
            for row in slots:
                key <<= 8
                key |= (self.stretch.take(row) * sign).view(np.uint8)
            keys.append(key << 8 if before is None else key)  # silent across words
            counts.append(np.repeat(n, sizes))
        return summed(np.concatenate(keys), np.concatenate(counts)) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def inputs(self, raw: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """ORDERS x bits of a text, and gates, PIECE_WORDS words at a time."""
        words, docs, joints, marks = split_units([raw])
        slots, bits, gates, sizes = unit_bits(unit_bytes(words), self.code, self.table)
        jslots, jbits, _, jsizes = joint_bits(joints, self.code, self.table)
        inner, joint = signed(self.stretch, slots, bits), signed(self.stretch, jslots, jbits)
        for a in range(0, len(docs[0]), PIECE_WORDS):
            source, places, theirs = laid_out(docs[0][a : a + PIECE_WORDS], marks[0][a : a + PIECE_WORDS], sizes, jsizes)
            x = np.zeros((ORDERS, len(source)), dtype=np.float32)
            x[: ORDERS - 1] = inner[:, source]
            x[ORDERS - 1, places] = joint[theirs]
            yield x, gates[source]

    def score(self, units: list[bytes], docs: list[np.ndarray], joints: list[bytes], marks: list[np.ndarray]) -> np.ndarray:
        """docs: indices into units; marks: indices into joints, one for each word. log10 probability of each doc."""
        rows = Rows(self)
        rows.add_words(units)
        rows.add_joints([joint_unit(j) for j in joints], ends_before(joints))
        return self.score_rows(rows, np.concatenate(docs), np.concatenate(marks), np.array([len(d) for d in docs]))

    def score_rows(self, rows: Rows, flat: np.ndarray, marks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """flat, marks: numbers of the words and transitions of all docs in turn; sizes: words of each. log10 probabilities."""
        out, begin = np.zeros(len(sizes)), np.cumsum(sizes) - sizes
        weights = np.zeros((len(sizes), WIDE, 1), dtype=np.float32)  # the corrections
        for start in range(0, int(sizes.max()), PIECE_WORDS):
            live = np.flatnonzero(sizes > start)
            n = np.minimum(sizes[live] - start, PIECE_WORDS)
            at = ranges(begin[live] + start, n)
            total, weights[live] = self._walk(rows, flat[at], marks[at], n, weights[live])
            out[live] += total
        return out / math.log(10)

    def _walk(self, rows: Rows, words: np.ndarray, joints: np.ndarray, sizes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each doc, and the corrections where they end, from those given."""
        at = 2 * np.arange(len(words)) + np.repeat(np.arange(len(sizes)), sizes)
        firsts, each = (np.zeros(2 * len(words) + len(sizes), dtype=np.int64) for _ in range(2))
        for to, kind, number in ((0, rows.joints, joints), (1, rows.words, words)):
            firsts[at + to], each[at + to] = kind[0].held[number], kind[1].held[number]
        # Each text's bits begin a block; the zeros after its last one move nothing and count one half each.
        ends = 2 * np.cumsum(sizes) + np.arange(len(sizes))
        bits = np.add.reduceat(each, ends - 2 * sizes)
        blocks = -(-bits // BLOCK_BITS)
        each[ends] = blocks * BLOCK_BITS - bits
        gained, weights = self._step(rows, short_ranges(firsts, each, rows.x.n).reshape(-1, BLOCK_BITS), blocks, weights)
        return gained + each[ends] * float(np.log(np.float32(2))), weights

    @staticmethod
    def _step(rows: Rows, index: np.ndarray, blocks: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Block by block through docs side by side; a lane whose doc ends takes up its next one. Arrays are used again from
        block to block."""
        lanes, first, half = dealt(blocks, LANES), np.cumsum(blocks) - blocks, BLOCK_BITS // 2
        loads = np.array([blocks[mine].sum() for mine in lanes])
        plan, turns = np.zeros((loads[0], len(lanes)), dtype=np.int64), defaultdict(list)  # blocks by turn and lane
        for i, mine in enumerate(lanes):
            plan[: loads[i], i] = ranges(first[mine], blocks[mine])
            for k, doc in zip(np.cumsum(blocks[mine]).tolist(), mine[1:], strict=False):
                turns[k].append((i, doc))
        n, lines = len(lanes), rows.x.held.view(np.int64)[:, 0]
        places, at, raw = (np.empty((n, BLOCK_BITS), dtype=kind) for kind in (index.dtype, np.int64, np.int64))
        x, slope = np.empty((n, BLOCK_BITS, WIDE), dtype=np.float32), np.empty((n, 1, WIDE), dtype=np.float32)
        z, inverse, pairs = (np.empty((n, k), dtype=np.float32) for k in (BLOCK_BITS, BLOCK_BITS, half))
        gained, weights, docs = np.zeros(plan.shape), weights * np.float32(1 / STEPS_OF_LOGIT), np.array([mine[0] for mine in lanes])
        own = weights[docs]
        for k, m in enumerate(np.searchsorted(-loads, -np.arange(loads[0]), side="left").tolist()):
            if m < n:  # shorter lanes are done
                n, places, at, raw, x, slope, z, inverse, pairs = m, places[:m], at[:m], raw[:m], x[:m], slope[:m], z[:m], inverse[:m], pairs[:m]
            if k in turns:
                i, new = np.array(turns[k]).T
                weights[docs[i]], docs[i], own[i] = own[i], new, weights[new]
            index.take(plan[k, :n], axis=0, out=places, mode="clip")
            at[...] = places
            lines.take(at, out=raw, mode="clip")
            x[...] = raw.view(np.int8).reshape(n, BLOCK_BITS, WIDE)
            np.matmul(x, own[:n], out=z[:, :, None])
            inverse[...] = raw.view(np.int32)[:, 1::2]
            inverse *= np.float32(1 / (1 << FINE))
            z += inverse
            np.minimum(z, np.float32(30), out=z)
            np.exp(z, out=z)
            np.add(z, np.float32(1), out=inverse)  # of the bit's probability
            z /= inverse
            np.multiply(inverse[:, :half], inverse[:, half:], out=pairs)
            np.log(pairs, out=pairs)
            np.add.reduce(pairs, axis=1, dtype=np.float64, out=gained[k, :n])
            np.matmul(z[:, None, :], x, out=slope)
            slope *= np.float32(RATE / STEPS_OF_LOGIT**2)
            slope[:, :, ORDERS:] = 0  # the gated sum's bytes are no logits
            own[:n] -= slope.transpose(0, 2, 1)
        weights[docs] = own
        by_block, used = np.empty(len(index)), np.arange(len(plan))[:, None] < loads
        by_block[plan[used]] = gained[used]
        return -np.add.reduceat(by_block, first), weights * np.float32(STEPS_OF_LOGIT)


def dealt(blocks: np.ndarray, lanes: int) -> list[list[int]]:
    """Docs of each lane, those of most blocks first, each to the lane with the fewest so far; lanes of most blocks first."""
    held = [(0, i) for i in range(min(lanes, len(blocks)))]
    out: list[list[int]] = [[] for _ in held]
    for doc in np.argsort(-blocks, kind="stable").tolist():
        load, i = held[0]
        out[i].append(doc)
        heapq.heapreplace(held, (load + int(blocks[doc]), i))
    return [out[i] for _, i in sorted(held, reverse=True)]


def short_ranges(starts: np.ndarray, lengths: np.ndarray, most: int) -> np.ndarray:
    """ranges() of numbers up to `most`, four bytes each where that is enough."""
    ends = np.cumsum(lengths)
    kind = np.int32 if max(most, int(ends[-1])) < 1 << 31 else np.int64
    out = np.repeat((starts - ends + lengths).astype(kind), lengths)
    steps = np.arange(min(RUN, len(out)), dtype=kind)
    for a in range(0, len(out), RUN):
        part = out[a : a + RUN]
        part += steps[: len(part)]
        part += kind(a)
    return out


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys (of at most 63 - LOW_BITS bits) and the sums of their counts: keys are sorted with the low bits of their
    counts behind them, which is faster than an order; what is above these bits is added to the key's sum."""
    low = (1 << LOW_BITS) - 1
    packed = np.sort(keys << LOW_BITS | counts & low)
    high = np.flatnonzero(counts > low)
    merged, packed = packed >> LOW_BITS, packed & low
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(merged)), dtype=bool), merged[1:] != merged[:-1])))
    merged, n = merged[first], np.add.reduceat(packed, first) if len(first) else packed
    np.add.at(n, np.searchsorted(merged, keys[high]), counts[high] & ~low)
    return merged, n


def apart(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inputs (ORDERS x bits) and gates of keys."""
    x = np.stack([(keys >> 8 * (ORDERS - 1 - i) & 255).astype(np.uint8).view(np.int8) for i in range(ORDERS)]).astype(np.float32)
    return x / np.float32(STEPS_OF_LOGIT), (keys >> 8 * ORDERS).astype(np.int64)


def laid_out(flat: np.ndarray, marks: np.ndarray, sizes: np.ndarray, joint_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the words of a text in turn: each bit's place among the units' bits; where the bits of transitions stand among
    them, and their places among the transitions' bits."""
    firsts, each = np.cumsum(sizes) - sizes, sizes[flat]
    joint_firsts, joint_each = np.cumsum(joint_sizes) - joint_sizes, joint_sizes[marks]
    begin = np.cumsum(each) - each
    return ranges(firsts[flat], each), ranges(begin, joint_each), ranges(joint_firsts[marks], joint_each)


def numbered(*known: bytes) -> defaultdict[bytes, int]:
    """Words by number; a new word takes the next."""
    out = defaultdict(count(len(known)).__next__)
    out.update(zip(known, range(len(known)), strict=True))
    return out


def transitions(words: list[bytes]) -> list[bytes]:
    """For each word, the last two bytes of the one before, a space, and its own first bytes."""
    return [a[-2:] + b" " + b[:JOINT] for a, b in zip([b"", *words], words, strict=False)]


def split_units(raws: list[bytes]) -> tuple[list[bytes], list[np.ndarray], list[bytes], list[np.ndarray]]:
    """Distinct words, 0 the end, and each text's words as indices, the end last; distinct transitions, and each text's
    as indices."""
    ids, joints, docs, marks = numbered(b""), numbered(), [], []
    for raw in raws:
        words = raw.lower().split()
        words.append(b"")
        docs.append(np.fromiter(map(ids.__getitem__, words), dtype=np.int64, count=len(words)))
        marks.append(np.fromiter(map(joints.__getitem__, transitions(words)), dtype=np.int64, count=len(words)))
    return list(ids), docs, list(joints), marks


def short_keys(raw: bytes, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two numbers that hold the bytes and size of each word of at most SHORT bytes, and a mix of both; 16 more bytes follow
    the words."""
    eight = np.ndarray(len(raw) - 7, dtype="<u8", buffer=raw, strides=(1,))
    first = eight[starts] & KEPT_BYTES.take(np.minimum(sizes, 8))
    second = eight[np.minimum(starts + 8, len(eight) - 1)] & KEPT_BYTES.take(np.clip(sizes - 8, 0, 7))
    second |= np.minimum(sizes, SHORT).astype(np.uint64) << np.uint64(56)
    return first, second, (first * _P ^ second) * _P


class Head:
    """Counts of frequent words: those of at most SHORT bytes by their `short_keys`, in order of the mix; longer ones, and those
    whose mix another has, in a dictionary. common: the first PREPARED of them, the end first."""

    def __init__(self, words: list[bytes], n: np.ndarray):
        first, second, mixed, sizes = self._keys(words)
        short = np.flatnonzero(sizes <= SHORT)
        self.mixed, at = np.unique(mixed[short], return_index=True)
        at = short[at]
        self.first, self.second, self.n = first[at], second[at], n[at]
        apart = np.ones(len(words), dtype=bool)
        apart[at] = False
        self.rest = {words[i]: int(n[i]) for i in np.flatnonzero(apart).tolist()}
        least = np.sort(n)[-PREPARED - 1 :][:1]
        often = [(-int(n[i]), words[i]) for i in np.flatnonzero(n >= least).tolist() if words[i]] if len(n) else []
        self.common = [b"", *(w for _, w in sorted(often)[:PREPARED])]

    @staticmethod
    def _keys(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        return *short_keys(b"".join(words) + b" " * 16, np.cumsum(sizes) - sizes, sizes), sizes

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Of each word; 0 where it is not among these."""
        first, second, mixed, sizes = self._keys(words)
        out = np.zeros(len(words), dtype=np.float64)
        apart = sizes > SHORT
        if len(self.mixed):
            at = np.minimum(np.searchsorted(self.mixed, mixed), len(self.mixed) - 1)
            same = (self.first[at] == first) & (self.second[at] == second) & ~apart
            out[same] = self.n[at[same]]
            apart |= (self.mixed[at] == mixed) & ~same
        for i in np.flatnonzero(apart).tolist():
            out[i] = self.rest.get(words[i], 0)
        return out


class Vocabulary:
    """Words by number, as they are met. A transition's key is exact: the last two bytes of the word before, the first JOINT
    of the word, and how many there are of each."""

    def __init__(self):
        self.ids, self.words, self.heads, self.tails = numbered(), [], Grown(np.int64), Grown(np.int64)
        self.seen, self.seen_numbers = np.zeros((1 << LOOKUP_BITS, 2), dtype=np.uint64), np.zeros(1 << LOOKUP_BITS, dtype=np.int64)

    def read(self, raws: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """split_texts, with numbers for the words. Words of at most SHORT bytes are told by two numbers that hold their bytes
        and size; those met last in each slot are found without the dictionary, and only others become Python's bytes."""
        raw = b" ".join([x or b"" for x in raws]).lower() + b" " * 16
        lengths = np.fromiter((len(x or b"") for x in raws), dtype=np.int64, count=len(raws))
        solid = SOLID.take(np.frombuffer(raw, dtype=np.uint8))
        edges = np.flatnonzero(solid[1:] != solid[:-1]) + 1
        starts, ends = (edges[1::2], edges[2::2]) if solid[0] else (edges[::2], edges[1::2])
        if solid[0]:
            starts, ends = np.concatenate((np.zeros(1, dtype=np.int64), starts)), edges[::2]
        sizes = ends - starts
        first, second, mixed = short_keys(raw, starts, sizes)
        slot = (mixed >> np.uint64(64 - LOOKUP_BITS)).view(np.int64)
        seen, numbers = self.seen.take(slot, axis=0), self.seen_numbers.take(slot)
        missed = np.flatnonzero((seen[:, 0] != first) | (seen[:, 1] != second) | (sizes > SHORT))
        if len(missed):
            numbers[missed] = self.split([raw[a:b] for a, b in zip(starts[missed].tolist(), ends[missed].tolist(), strict=True)])
            short = missed[sizes[missed] <= SHORT]
            # Of several in one slot one is kept whole: numbers, then keys, come from the same word.
            self.seen_numbers[slot[short]] = short
            last = self.seen_numbers[slot[short]]
            self.seen[slot[short], 0], self.seen[slot[short], 1], self.seen_numbers[slot[short]] = first[last], second[last], numbers[last]
        end = self.split([b""])[0]
        after = np.searchsorted(starts, np.cumsum(lengths + 1))  # words up to each text's end
        flat = np.full(len(starts) + len(raws), end, dtype=np.int64)
        own = np.ones(len(flat), dtype=bool)
        own[after + np.arange(len(raws))] = False
        flat[own] = numbers
        return flat, np.diff(after, prepend=0) + 1

    def split(self, words: list[bytes]) -> np.ndarray:
        """Numbers of words; new ones take the next."""
        flat = np.fromiter(map(self.ids.__getitem__, words), dtype=np.int64, count=len(words))
        if len(self.ids) > len(self.words):
            self.meet(list(islice(reversed(self.ids), len(self.ids) - len(self.words)))[::-1])
        return flat

    def meet(self, new: list[bytes]) -> None:
        self.words += new
        sizes = np.fromiter(map(len, new), dtype=np.int64, count=len(new))
        ends = np.cumsum(sizes)
        raw = b"\x00\x00" + b"".join(new) + b"\x00" * 4
        four, two = (np.ndarray(len(raw) - k + 1, dtype=f"<u{k}", buffer=raw, strides=(1,)) for k in (4, 2))
        head = four[ends - sizes + 2].astype(np.int64) & KEPT_BYTES.view(np.int64).take(np.minimum(sizes, JOINT))
        tail = two[ends].astype(np.int64) >> 8 * (2 - np.minimum(sizes, 2))
        self.heads.add(head | np.minimum(sizes, JOINT) << 24)
        self.tails.add((tail | np.minimum(sizes, 2) << 16) << 26)

    def keys(self, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Of the transition to each word of texts, which start at `starts`."""
        key = self.heads.held[flat]
        before = self.tails.held[flat[:-1]]
        before[starts[1:] - 1] = 0
        key[1:] |= before
        return key


def key_joints(keys: np.ndarray) -> pa.Array:
    """The transitions of keys."""
    before, after = keys >> 26, keys & (1 << 26) - 1
    whole, held = np.empty((len(keys), 3 + JOINT), dtype=np.uint8), np.ones((len(keys), 3 + JOINT), dtype=bool)
    whole[:, 2] = ord(" ")
    for value, size, places in ((before & 0xFFFF, before >> 16, (0, 1)), (after & 0xFFFFFF, after >> 24, range(3, 3 + JOINT))):
        for k, at in enumerate(places):
            whole[:, at], held[:, at] = value >> 8 * k & 255, size > k
    ends = np.concatenate((np.zeros(1, dtype=np.int32), np.cumsum(held.sum(axis=1), dtype=np.int32)))
    return pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(ends), pa.py_buffer(whole[held])])


def split_texts(raws: list[bytes | None]) -> tuple[list[bytes], np.ndarray]:
    """The words of all texts in turn, each text's end last, and how many are each text's."""
    words, sizes = [], []
    for raw in raws:
        mine = (raw or b"").lower().split()
        mine.append(b"")
        words += mine
        sizes.append(len(mine))
    return words, np.array(sizes, dtype=np.int64)


class Lexicon(Vocabulary):
    """Words and transitions met so far with their bits; starts with common words, the end first."""

    def __init__(self, mixer: Mixer, common: list[bytes]):
        super().__init__()
        self.rows, self.joints = Rows(mixer, HELD_BITS + HELD_BITS // 4), {}
        self.slots, self.numbers = np.full(1 << JOINT_BITS, -1, dtype=np.int64), np.zeros(1 << JOINT_BITS, dtype=np.int64)
        self.split(common)

    def meet(self, new: list[bytes]) -> None:
        super().meet(new)
        self.rows.add_words(unit_bytes(new))

    def marks(self, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Numbers of the transitions; those met last in each slot are found without the dictionary."""
        key = self.keys(flat, starts)
        at = (key.view(np.uint64) * _P >> np.uint64(64 - JOINT_BITS)).view(np.int64)
        out, missed = self.numbers[at], np.flatnonzero(self.slots[at] != key)
        if len(missed):
            got, back = np.unique(key[missed], return_inverse=True)
            new = [k for k in got.tolist() if k not in self.joints]
            self.joints.update(zip(new, range(len(self.joints), len(self.joints) + len(new)), strict=True))
            before = np.array(new, dtype=np.uint64) >> np.uint64(26)
            self.rows.add_joints([self._unit(k) for k in new], (before & np.uint64(0xFFFF)) * np.uint64(3) + (before >> np.uint64(16)))
            out[missed] = np.fromiter(map(self.joints.__getitem__, got.tolist()), dtype=np.int64, count=len(got))[back]
            self.numbers[at[missed]] = out[missed]
            self.slots[at[missed]] = key[missed]
        return out

    @staticmethod
    def _unit(key: int) -> bytes:
        """joint_unit of a key."""
        size = key >> 24 & 3
        return END if not size else (key & 0xFFFFFF).to_bytes(3, "little") if size == JOINT else (key & 0xFFFFFF).to_bytes(3, "little")[:size] + b" "


def unit_bytes(words: list[bytes]) -> list[bytes]:
    return [w + b" " if w else b"\xff" for w in words]


def text_counts(df: DataFrame, text: str) -> DataFrame:
    """w, joint, n: tokens of all rows (the empty word is the end token), and, where joint, their transitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def part(keys: pa.Array, joint: bool, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([keys, pa.array([joint] * len(keys), pa.bool_()), pa.array(n, pa.int64())], names=["w", "joint", "n"])

        met, times, joints, tokens = Vocabulary(), np.zeros(0, np.int64), (np.zeros(0, np.int64), np.zeros(0, np.int64)), []

        def gathered() -> tuple[np.ndarray, np.ndarray]:
            keys = np.concatenate(tokens or [np.zeros(0, np.int64)])
            return summed(np.concatenate((joints[0], keys)), np.concatenate((joints[1], np.ones(len(keys), np.int64))))

        for whole in batches:
            for batch in slices([whole.set_column(0, text, whole.column(0).cast(pa.binary()))], text, SCORE_BYTES):
                flat, sizes = met.read(batch.column(0).to_pylist())
                more = np.bincount(flat, minlength=len(met.words))
                more[: len(times)] += times
                times = more
                tokens.append(met.keys(flat, np.cumsum(sizes) - sizes))
                if sum(map(len, tokens)) > FLUSH_WORDS:
                    joints = gathered()
                    tokens.clear()
                if len(times) + len(joints[0]) > FLUSH_WORDS:
                    joints = gathered()
                    tokens.clear()
                    yield part(pa.array(met.words, pa.binary()), False, times)
                    yield part(key_joints(joints[0]), True, joints[1])
                    met, times, joints = Vocabulary(), np.zeros(0, np.int64), (np.zeros(0, np.int64), np.zeros(0, np.int64))
        joints = gathered()
        yield part(pa.array(met.words, pa.binary()), False, times)
        yield part(key_joints(joints[0]), True, joints[1])

    return df.select(text).mapInArrow(tidy(run), "w binary, joint boolean, n long").groupBy("joint", "w").agg(F.sum("n").alias("n"))


def train_counts(counted: DataFrame, code: Code, table: Slots) -> np.ndarray:
    """Logits of all counters, from bit counts over all training tokens; summed chunk by chunk, one byte each collected."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(table.total * 2)
        for whole in batches:
            for batch in slices([whole], "w", BATCH_BYTES):
                joint = batch.column("joint").to_numpy(zero_copy_only=False)
                keys, n = batch.column("w").to_pylist(), batch.column("n").to_numpy(zero_copy_only=False).astype(np.float64)
                for kind in (False, True):
                    some = np.flatnonzero(joint == kind)
                    if not len(some):
                        continue
                    mine = [keys[i] for i in some.tolist()]
                    slots, bits, _, sizes = joint_bits(mine, code, table) if kind else unit_bits(unit_bytes(mine), code, table)
                    weight = np.repeat(n[some], sizes)
                    for row in np.atleast_2d(slots):
                        at = row.astype(np.int64)
                        at *= 2
                        at += bits
                        np.add.at(out, at, weight)  # the tables, far larger than a batch, are not gone through for each
        for k in range(0, len(out), CHUNK):
            part = out[k : k + CHUNK]
            if most := part.max():
                kind = np.min_scalar_type(int(most))  # counts are whole; most need a byte or two
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([kind.str]), pa.array([part.astype(kind).tobytes()], pa.binary())], names=["at", "kind", "part"])

    def add(part: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, dtype=kind).astype(np.float64) for kind, x in zip(part.column("kind").to_pylist(), part.column("part").to_pylist(), strict=True))
        return pa.table({"at": part.column("at").slice(0, 1), "part": pa.array([logits(total.reshape(-1, 2)).tobytes()], pa.binary())})

    out = np.zeros(table.total, dtype=np.int8)
    for r in counted.mapInArrow(tidy(run), "at long, kind string, part binary").groupBy("at").applyInArrow(add, "at long, part binary").collect():
        out[r["at"] // 2 : (r["at"] + CHUNK) // 2] = np.frombuffer(r["part"], dtype=np.int8)
    return out


def byte_counts(words: DataFrame) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(256)
        for whole in batches:
            for batch in slices([whole], "w", BATCH_BYTES):
                units = unit_bytes(batch.column("w").to_pylist())
                n = np.repeat(batch.column("n").to_numpy(zero_copy_only=False).astype(np.float64), [len(u) for u in units])
                out += np.bincount(np.frombuffer(b"".join(units), dtype=np.uint8), weights=n, minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256, dtype=np.int32)), pa.array(out)], names=["b", "n"])

    out = np.zeros(256)
    for r in words.mapInArrow(tidy(run), "b int, n double").groupBy("b").agg(F.sum("n").alias("n")).collect():
        out[r["b"]] = r["n"]
    return out


def fit_weights(counted: DataFrame, mixer: Mixer) -> None:
    """The mixer's gated weights, from the bits of all training tokens."""
    sc = counted.sparkSession.sparkContext
    shared = sc.broadcast(mixer)

    def like(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def rows(pairs):
            return pa.RecordBatch.from_arrays([pa.array(x) for x in summed(*(np.concatenate(x) for x in zip(*pairs, strict=True)))], names=["k", "n"])

        for whole in batches:
            for batch in slices([whole], "w", BATCH_BYTES):
                joint = batch.column("joint").to_numpy(zero_copy_only=False)
                keys, n = batch.column("w").to_pylist(), batch.column("n").to_numpy(zero_copy_only=False)
                a, b = np.flatnonzero(~joint).tolist(), np.flatnonzero(joint).tolist()
                held.append(shared.value.alike([keys[i] for i in a], n[a], [keys[i] for i in b], n[b]))
                if sum(len(k) for k, _ in held) > ALIKE:
                    yield rows(held)
                    held.clear()
        if held:
            yield rows(held)

    alike = stored(counted.mapInArrow(tidy(like), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")), "alike")
    for _ in range(ROUNDS):
        sent = sc.broadcast(mixer.weights)

        def derive(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = Mixer(None, None, None)
            own.weights = sent.value
            slope, bend = np.zeros((GATES, ORDERS)), np.zeros((GATES, ORDERS, ORDERS))
            for batch in batches:
                x, gates = apart(batch.column("k").to_numpy())
                own.slopes(x, gates, batch.column("n").to_numpy().astype(np.float64), slope, bend)
            flat = np.concatenate((slope.ravel(), bend.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["i", "v"])

        total = np.zeros(GATES * ORDERS * (ORDERS + 1))
        for r in alike.mapInArrow(tidy(derive), "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
            total[r["i"]] = r["v"]
        mixer.step(total[: GATES * ORDERS].reshape(GATES, ORDERS), total[GATES * ORDERS :].reshape(GATES, ORDERS, ORDERS))
        sent.destroy()
    shared.destroy()


class Model:
    """Word table (a stored DataFrame), totals, frequent words, and the mixer."""

    def __init__(self, words: DataFrame, tokens: int, distinct: int, head: Head, mixer: Mixer):
        self.words, self.tokens, self.distinct, self.head, self.mixer = words, tokens, distinct, head, mixer


def learn(df: DataFrame, text: str = "text") -> Model:
    """From every row of df."""
    counted = stored(text_counts(df, text), "counts")
    words = counted.where("not joint").select("w", "n")
    tokens = distinct = 0
    least = None  # of a word in the head
    for r in sorted(words.groupBy("n").agg(F.count("*").alias("v")).collect(), reverse=True):
        tokens, distinct = tokens + r["n"] * r["v"], distinct + r["v"]
        least = r["n"] if distinct <= HEAD else least
    most = words.where("false" if least is None else F.col("n") >= least).toArrow()
    head = Head(most.column("w").to_pylist(), most.column("n").to_numpy())
    code, table = Code(byte_counts(words)), Slots(distinct)
    mixer = Mixer(code, table, train_counts(counted, code, table))
    fit_weights(counted, mixer)
    return Model(words, tokens, distinct, head, mixer)


def score_texts(df: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """`keep` columns, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte (of the coded bytes)."""
    raw_text, row, tail_name = fresh(keep, "text", "row", "tail")
    total = model.tokens + 0.5 * (model.distinct + 1)
    sc = df.sparkSession.sparkContext
    shared = sc.broadcast((model.head, model.mixer))
    out = fresh([*keep, raw_text, row, tail_name], "n_tokens", "head_known", "head_base", "score", "n_bytes")
    kinds = [(row, T.LongType()), *zip(out, (T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType(), T.LongType()), strict=True)]
    tail = T.ArrayType(T.StructType([T.StructField("w", T.BinaryType()), T.StructField("k", T.LongType())]))
    rows = df.select(*keep, F.col(text).alias(raw_text)).withColumn(row, F.monotonically_increasing_id())
    schema = T.StructType([*df.select(*keep).schema.fields, *(T.StructField(n, t) for n, t in kinds), T.StructField(tail_name, tail)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, mixer = shared.value
        lexicon = facts = None
        waiting: list[tuple[list[pa.Array], pa.Array, np.ndarray, np.ndarray, np.ndarray, int]] = []

        def walked() -> Iterator[pa.RecordBatch]:
            if waiting:
                flat, marks, sizes = (np.concatenate(x) for x in list(zip(*waiting, strict=True))[2:5])
                scores = np.split(mixer.score_rows(lexicon.rows, flat, marks, sizes), np.cumsum([len(x[4]) for x in waiting])[:-1])
                for (arrays, last, *_), part in zip(waiting, scores, strict=True):
                    yield pa.RecordBatch.from_arrays([*arrays[:-1], pa.array(part), arrays[-1], last], names=schema.names)
                waiting.clear()

        for batch in slices((b.set_column(b.schema.get_field_index(raw_text), raw_text, b.column(raw_text).cast(pa.binary())) for b in batches), raw_text, SCORE_BYTES):
            if lexicon is None or lexicon.rows.x.n > HELD_BITS:
                yield from walked()
                lexicon, facts = Lexicon(mixer, head.common), (Grown(np.float64), Grown(np.float64), Grown(np.int64))
            flat, sizes = lexicon.read(batch.column(raw_text).to_pylist())
            words = lexicon.words
            starts = np.cumsum(sizes) - sizes
            new = words[facts[0].n :]
            counts = head.counts(new)
            value = np.where(counts > 0, np.log10(np.maximum(counts, 1) + 0.5) - math.log10(total), 0.0)
            for kind, part in zip(facts, (counts, value, np.array([len(w) + 1 for w in new], dtype=np.int64)), strict=True):
                kind.add(part)
            counts, value, lengths = (x.held for x in facts)
            found = np.add.reduceat((counts > 0).astype(np.int64)[flat], starts)
            base = np.add.reduceat(value[flat], starts)
            n_bytes = np.add.reduceat(lengths[flat], starts)
            rare = np.flatnonzero(counts[flat] == 0)
            pair, n = np.unique(np.repeat(np.arange(len(sizes)), sizes)[rare] * len(words) + flat[rare], return_counts=True)
            at, word = np.divmod(pair, max(1, len(words)))
            offsets = np.searchsorted(at, np.arange(len(sizes) + 1)).astype(np.int32)
            items = pa.StructArray.from_arrays([pa.array([words[k] for k in word.tolist()], pa.binary()), pa.array(n.astype(np.int64))], names=["w", "k"])
            arrays = [*(batch.column(k) for k in keep), batch.column(row), pa.array(sizes), pa.array(found), pa.array(base), pa.array(n_bytes)]
            marks = lexicon.marks(flat, starts)
            bits = int(lexicon.rows.words[1].held[flat].sum() + lexicon.rows.joints[1].held[marks].sum())
            if bits + sum(x[5] for x in waiting) > WALK_BITS:
                yield from walked()
            waiting.append((arrays, pa.ListArray.from_arrays(pa.array(offsets), items), flat, marks, sizes, bits))
        yield from walked()

    scored = stored(rows.mapInArrow(tidy(run), schema), "scored")
    n_tokens, head_known, head_base, total_score, n_bytes = out
    asked = scored.select(F.col(row).alias("row"), F.explode(tail_name).alias("x")).select("row", "x.w", "x.k")
    c = F.coalesce(F.col("n"), F.lit(0))
    (tail_row,) = fresh(scored.columns, "tail_row")
    found = asked.join(model.words, "w", "left").groupBy(F.col("row").alias(tail_row)).agg(
        F.sum(F.when(c > 0, F.col("k")).otherwise(0)).alias("tail_known"),
        F.sum(F.col("k") * (F.log10(c + 0.5) - math.log10(total))).alias("tail_base"),
    )
    known, base = fresh([*scored.columns, tail_row], "tail_known", "tail_base")
    found = found.withColumnsRenamed({"tail_known": known, "tail_base": base})
    whole = scored.drop(tail_name).join(found, F.col(row) == F.col(tail_row), "left")
    return whole.select(
        *keep,
        F.col(n_tokens).alias("n_tokens"),
        (F.col(head_known) + F.coalesce(F.col(known), F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col(head_base) + F.coalesce(F.col(base), F.lit(0.0))).alias("base_score"),
        F.col(total_score).alias("score"),
        (-F.col(total_score) / math.log10(2) / F.col(n_bytes)).alias("bits_per_byte"),
    )


def lm_score(df: DataFrame, use: Column, keep: list[str], text: str = "text") -> DataFrame:
    """Learn from the rows where `use` holds; score all."""
    return score_texts(df, learn(df.where(use), text), keep, text)
