"""The registered score against a slow model: one loop over bits for counts, weights and adaptation."""

import heapq
import math

import numpy as np
import pytest

from siltstone.llm import lm_score
from siltstone.llm.lm_score import BLOCK_BITS, GATES, ORDERS, RATE

M = 1 << 64


def slow_code(counts):
    heap = [(float(c) + 1e-3, b, (b,)) for b, c in enumerate(counts)]
    heapq.heapify(heap)
    paths, serial = {b: [] for b in range(256)}, 256
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for bit, side in enumerate((a, b)):
            for x in side[2]:
                paths[x].insert(0, (serial - 256, bit))
        heapq.heappush(heap, (a[0] + b[0], serial, a[2] + b[2]))
        serial += 1
    return paths


def slow_bits(word, before, paths, table):
    """For each bit of a word: slots of its predictors (None: silent), the bit, the gate."""
    data = word + b" " if word else b"\xff"
    for k, byte in enumerate(data):
        last = [data[k - i] + 1 if k >= i else 0 for i in (1, 2, 3)]
        whole = sum((b + 1) * pow(1_000_003, j, M) for j, b in enumerate(data[:k])) % M
        tail = before[-2:]
        across = (int.from_bytes(tail, "little") * 3 + len(tail)) << 20 | last[0] << 9 | last[1]
        contexts = [last[0], last[0] | last[1] << 9, last[0] | last[1] << 9 | last[2] << 18, whole, across]
        for depth, (node, bit) in enumerate(paths[byte]):
            slots = []
            for order, ctx in enumerate(contexts):
                h = ((ctx * 0x9E3779B97F4A7C15 % M >> 32) + node * 0x85EBCA6B) % (1 << 32)
                slots.append((h >> 32 - table.bits[order]) + table.starts[order])
            if k >= 3:
                slots[4] = None
            yield slots, bit, 4 * min(k, 3) + min(depth, 3)


def text_bits(text, paths, table):
    before = b""
    for w in [*text.encode().lower().split(), b""]:
        yield from slow_bits(w, before, paths, table)
        before = w


def vector(slots, bit, counts):
    x = []
    for s in slots:
        zeros, ones = counts.get((s, 0), 0), counts.get((s, 1), 0)
        v = 0 if s is None else np.clip(math.log((ones + 0.4) / (zeros + 0.4)), -7.9375, 7.9375)
        x.append(round(v * 16) / 16 * (-1 if bit else 1))
    return np.array(x)


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(16)
    vocabulary = [f"{a}{b}" for a in ("the", "a", "stone", "x", "fern", "é") for b in ("", "s", "ing", "1")]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(1, 50))) for _ in range(30)] + ["", "UPPER Stone", "one unseen wörd"]
    return [(i, t) for i, t in enumerate(texts)]


def test_registered_score_against_slow_model(spark, corpus):
    from pyspark.sql import functions as F

    train = [t for i, t in corpus if i % 3]
    df = spark.createDataFrame(corpus, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in lm_score.lm_score(df, F.col("doc_id") % 3 != 0, ["doc_id"]).collect()}
    byte_counts = np.zeros(256)
    for t in train:
        for w in [*t.encode().lower().split(), b""]:
            for b in w + b" " if w else b"\xff":
                byte_counts[b] += 1
    paths = slow_code(byte_counts)
    table = lm_score.Slots(len({w for t in train for w in t.encode().lower().split()} | {b""}))
    counts = {}
    for t in train:
        for slots, bit, _ in text_bits(t, paths, table):
            for s in slots:
                if s is not None:
                    counts[s, bit] = counts.get((s, bit), 0) + 1
    rows = [(vector(s, b, counts), g) for t in sorted(set(train)) for s, b, g in text_bits(t, paths, table)]
    weights = np.full((GATES, ORDERS), 0.3)
    for _ in range(6):
        for g in range(GATES):
            xs = np.array([x for x, k in rows if k == g]).reshape(-1, ORDERS)
            p = 1 / (1 + np.exp(xs @ weights[g]))
            slope = -xs.T @ (1 - p) - (weights[g] - 0.3)
            weights[g] = np.clip(weights[g] + np.linalg.solve((xs.T * (p * (1 - p))) @ xs + np.eye(ORDERS), slope), -1, 2)
    for i, t in corpus:
        total, moved, step, size = 0.0, np.zeros(ORDERS), np.zeros(ORDERS), sum(len(w) + 1 for w in [*t.encode().lower().split(), b""])
        for k, (s, b, g) in enumerate(text_bits(t, paths, table)):
            if k % BLOCK_BITS == 0:
                moved, step = moved + step, np.zeros(ORDERS)
            x = vector(s, b, counts)
            z = x @ (weights[g] + moved)
            total -= math.log10(1 + math.exp(z))
            step -= RATE * x / (1 + math.exp(-z))
        assert got[i]["score"] == pytest.approx(total, rel=2e-3), t
        assert got[i]["bits_per_byte"] == pytest.approx(-total / math.log10(2) / size, rel=2e-3)


def mixer(texts):
    words, _, joints, _ = lm_score.split_units([t.encode() for t in texts])
    units = lm_score.unit_bytes(words)
    code, table = lm_score.Code(np.bincount(np.frombuffer(b"".join(units), np.uint8), minlength=256)), lm_score.Slots(1000)
    counts = np.zeros((table.total, 2))
    slots, bits, _, _ = lm_score.unit_bits(units, code, table)
    for row in slots:
        np.add.at(counts, (row, bits), 2)
    slots, bits, _, _ = lm_score.joint_bits(joints, code, table)
    np.add.at(counts, (slots, bits), 2)
    out = lm_score.Mixer(code, table, lm_score.logits(counts))
    out.fit([t.encode() for t in texts])
    return out


def scores(model, texts):
    words, docs, joints, marks = lm_score.split_units([t.encode() for t in texts])
    return model.score(lm_score.unit_bytes(words), docs, joints, marks)


def test_texts_do_not_depend_on_their_batch(corpus):
    """Nor on pieces that are not there: alone, together and in any order the same score."""
    texts = [t for _, t in corpus] + [" ".join(t for _, t in corpus * 3)]
    model = mixer(texts)
    together = scores(model, texts)
    assert together == pytest.approx([scores(model, [t])[0] for t in texts], rel=1e-4)
    assert together[::-1] == pytest.approx(scores(model, texts[::-1]), rel=1e-4)


def test_adaptation_lasts_through_the_text(corpus, monkeypatch):
    """The corrections go on from block to block, and from piece to piece of a long text."""
    texts = [t for _, t in corpus]
    model = mixer(texts[:5])
    long = " ".join("stoneing x1 fern" for _ in range(3000))
    whole = scores(model, [long])[0]
    parts = scores(model, [" ".join("stoneing x1 fern" for _ in range(10))])[0] * 300
    assert whole > parts * 0.9  # less negative: what it learned from the first blocks still holds in the last
    monkeypatch.setattr(lm_score, "PIECE_WORDS", 100)
    assert scores(model, [long])[0] == pytest.approx(whole, rel=0.02)


def test_probabilities_sum_to_one(corpus):
    model = mixer([t for _, t in corpus])
    units = [bytes([b]) for b in range(256)]
    x, sizes = model.prepared(units)
    total = sum(math.exp(-np.log1p(np.exp(x[-1][a:b])).sum()) for a, b in zip(np.cumsum(sizes) - sizes, np.cumsum(sizes), strict=True))
    assert total == pytest.approx(1, rel=1e-4)


def test_tables_grow_with_the_words():
    assert [lm_score.Slots(n).bits[3:] for n in (0, 1 << 15, 1 << 17, 1 << 18, 1 << 40)] == [(18, 18), (19, 19), (21, 21), (22, 22), (22, 22)]


def test_word_order_counts(corpus):
    """Texts of the same words in an order never seen score lower."""
    model = mixer(["alpha beta gamma delta " * 5] * 2 + [t for _, t in corpus])
    seen, shuffled = scores(model, ["alpha beta gamma delta", "delta beta alpha gamma"])
    assert seen > shuffled


def test_weights_come_from_every_training_row(spark, corpus):
    """500 distinct texts and a copy: the gated weights are those of a fit on all of them, text by text."""
    rng = np.random.default_rng(17)
    words = [w for _, t in corpus for w in t.split()]
    texts = [" ".join(rng.choice(words, 12)) + f" {k}" for k in range(500)] + ["a stone"] * 2
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    got = lm_score.learn(df).mixer
    whole = lm_score.Mixer(got.code, got.table, got.stretch)
    whole.fit([t.encode() for t in texts])
    assert np.abs(got.weights - whole.weights).max() < 1e-3


def test_words_and_transitions_are_prepared_once(corpus):
    """A lexicon adds bits for what it meets first only; later batches, in any order, score as texts on their own do."""
    texts = [t for _, t in corpus] + ["a\x00 \x00a a", "x", "stone\x00 a"]
    model = mixer(texts)
    lexicon = lm_score.Lexicon(model, [b"", b"stone"])

    def score(some):
        words, sizes = lm_score.split_texts([t.encode() for t in some])
        flat = lexicon.split(words)
        return model.score_rows(lexicon.rows, flat, lexicon.marks(flat, np.cumsum(sizes) - sizes), sizes)

    first, held = score(texts), lexicon.rows.x.n
    again = score(texts[::-1])[::-1]
    assert lexicon.rows.x.n == held and lexicon.rows.joints[0].n == len(lexicon.joints)
    assert first == pytest.approx(scores(model, texts), rel=1e-5) and again == pytest.approx(first, rel=1e-5)


def test_a_full_lexicon_starts_anew(spark, corpus, monkeypatch):
    """Small batches with a lexicon that is full after each: the same scores and counts."""
    df = spark.createDataFrame([*corpus, (None, None)], "doc_id long, text string").repartition(2)
    model = lm_score.learn(df)
    whole = {r["doc_id"]: r for r in lm_score.score_texts(df, model, ["doc_id"]).collect()}
    monkeypatch.setattr(lm_score, "HELD_BITS", 1)
    monkeypatch.setattr(lm_score, "SCORE_BYTES", 64)
    small = {r["doc_id"]: r for r in lm_score.score_texts(df, model, ["doc_id"]).collect()}
    assert whole.keys() == small.keys() == {None, *(i for i, _ in corpus)}
    for i, r in whole.items():
        assert (small[i]["n_tokens"], small[i]["n_known"]) == (r["n_tokens"], r["n_known"])
        assert [small[i][k] for k in ("base_score", "score", "bits_per_byte")] == pytest.approx([r[k] for k in ("base_score", "score", "bits_per_byte")], rel=1e-5)


@pytest.mark.parametrize("flush", [3, 300_000])
def test_counts_of_words_and_transitions(spark, corpus, monkeypatch, flush):
    """All rows, against plain counters, however often the counts are handed on."""
    from collections import Counter

    texts = [t for _, t in corpus] + [None, "a\x00 \x00a a", "zz\x00"] * 3
    words, joints = Counter(), Counter()
    for t in texts:
        mine = [*(t or "").encode().lower().split(), b""]
        words.update(mine)
        joints.update(lm_score.transitions(mine))
    monkeypatch.setattr(lm_score, "FLUSH_WORDS", flush)
    monkeypatch.setattr(lm_score, "SCORE_BYTES", 64)
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    got = {(bytes(r["w"]), r["joint"]): r["n"] for r in lm_score.text_counts(df, "text").collect()}
    assert got == {(w, False): n for w, n in words.items()} | {(j, True): n for j, n in joints.items()}
    assert lm_score.text_counts(df.where("false"), "text").count() == 0


def test_sums_of_counts_of_any_size():
    """Keys of 44 bits, counts on both sides of the bits that are sorted with the keys."""
    from collections import Counter

    rng = np.random.default_rng(19)
    keys = np.concatenate((rng.integers(0, 50, 400), (1 << 44) - 1 - rng.integers(0, 50, 400)))
    counts = rng.choice([0, 1, 7, (1 << 19) - 1, 1 << 19, (1 << 19) + 1, 1 << 50], 800)
    want = Counter()
    for k, n in zip(keys.tolist(), counts.tolist(), strict=True):
        want[k] += n
    got = lm_score.summed(keys, counts)
    assert dict(zip(*(x.tolist() for x in got), strict=True)) == dict(want) and (np.diff(got[0]) > 0).all()
    assert [len(x) for x in lm_score.summed(keys[:0], counts[:0])] == [0, 0]


def test_bits_from_a_place_on(corpus):
    """Bits of words from the byte JOINT on are those of whole words without the bytes before, and no others are made."""
    model = mixer([t for _, t in corpus])
    units = lm_score.unit_bytes([b"", b"a", b"abc", b"stoneing", "wörd".encode(), b"fern1"])
    slots, bits, gates, sizes = lm_score.unit_bits(units, model.code, model.table)
    late = lm_score.unit_bits(units, model.code, model.table, least=lm_score.JOINT)
    keep = gates >= 4 * lm_score.JOINT
    assert all((a == b).all() for a, b in zip(late, (slots[:, keep], bits[keep], gates[keep]), strict=False))
    assert late[3].tolist() == [int(keep[e - n : e].sum()) for e, n in zip(np.cumsum(sizes), sizes, strict=True)]


def test_counters_beyond_single_precision(spark, corpus):
    """Counts of ones are not lost beside one of 2^25 in the same counter, wherever they stand in a batch."""
    from pyspark.sql import functions as F

    words = [(b"ab", 1 << 25)] + [(b"ab%d" % k, 8) for k in range(1 << 15)]
    counted = spark.createDataFrame(words, "w binary, n long").select("w", F.lit(False).alias("joint"), "n").coalesce(1)
    code, table = lm_score.Code(np.ones(256)), lm_score.Slots(1)
    got = lm_score.train_counts(counted, code, table)
    counts = np.zeros((table.total, 2))
    for w, n in words:
        slots, bits, _, _ = lm_score.unit_bits([w + b" "], code, table)
        for row in slots:
            np.add.at(counts, (row, bits), n)
    assert (got == lm_score.logits(counts)).all()


def test_transitions_of_keys():
    """Built at once for all keys: whatever bytes they hold, and fewer than they may."""
    words = [b"", b"a", b"stone\x00", b"\x00", b"x\x00", b"\xc3\xa9", b"fern", b""]
    met = lm_score.Vocabulary()
    keys = met.keys(met.split(words), np.array([0]))
    assert lm_score.key_joints(keys).to_pylist() == lm_score.transitions(words)
    assert lm_score.key_joints(keys[:0]).to_pylist() == []


@pytest.mark.parametrize("slots", [1, 18])
def test_words_read_as_they_split(monkeypatch, slots):
    """Numbers of words found without Python's bytes are those of split texts: any white space, NULs, sizes about SHORT."""
    monkeypatch.setattr(lm_score, "LOOKUP_BITS", slots)
    long = [b"x" * n + tail for n in (7, 8, 9, 14, 15, 16, 17) for tail in (b"", b"\x00", b"y", b"Y\x00")]
    spaces = b" \t\n\r\x0b\x0c"
    texts = [None, b"", b"  ", spaces, b"a", b" a", b"a ", b"A\x1ca\x00 \x00A \x00 a\x00\x00", "\u00c9 \u00e9\u0085\u00a0x".encode(), b"zz\x00"]
    texts += [b" ".join(long), b"".join(w + spaces[i % 6 : i % 6 + 1] for i, w in enumerate(long)), b"last"]
    for some in (texts, texts[::-1], [b""], [None], texts[4:5], [b"a b"]):
        met = lm_score.Vocabulary()
        for _ in range(3):  # met, found again
            flat, sizes = met.read(some)
            words, want = lm_score.split_texts(some)
            assert [met.words[i] for i in flat] == words and sizes.tolist() == want.tolist()
        assert len(set(met.words)) == len(met.words) == len(set(words))
        assert lm_score.key_joints(met.keys(flat, np.cumsum(sizes) - sizes)).to_pylist() == [j for a, b in zip(np.cumsum(sizes) - sizes, np.cumsum(sizes), strict=True) for j in lm_score.transitions(words[a:b])]


@pytest.mark.parametrize("lanes", [1, 3, 64])
def test_lanes_take_up_the_next_text(corpus, monkeypatch, lanes):
    """Whatever lane and turn a text has, its score is the one it has alone; no lane idles while texts wait."""
    texts = [t for _, t in corpus] + [" ".join(t for _, t in corpus[:k]) for k in (30, 3, 12, 20)]
    model = mixer(texts)
    alone = [scores(model, [t])[0] for t in texts]
    monkeypatch.setattr(lm_score, "LANES", lanes)
    assert scores(model, texts) == pytest.approx(alone, rel=1e-5)
    blocks = np.array([40, 1, 7, 7, 3, 1, 1, 20])
    got = lm_score.dealt(blocks, lanes)
    loads = [int(blocks[mine].sum()) for mine in got]
    assert sorted(d for mine in got for d in mine) == list(range(8)) and loads == sorted(loads, reverse=True)
    assert loads[0] == max(40, -(-80 // lanes)) and len(got) == min(lanes, 8)


def test_batches_walk_together(spark, corpus, monkeypatch):
    """Each text once, with its own columns, whether batches wait for each other or not."""
    df = spark.createDataFrame([*corpus, (None, None)], "doc_id long, text string").repartition(2)
    model = lm_score.learn(df)
    monkeypatch.setattr(lm_score, "SCORE_BYTES", 64)
    found = []
    for most in (1, 2000, 1 << 24):
        monkeypatch.setattr(lm_score, "WALK_BITS", most)
        found.append({r["doc_id"]: r for r in lm_score.score_texts(df, model, ["doc_id"]).collect()})
    assert found[0].keys() == {None, *(i for i, _ in corpus)}
    for i, r in found[0].items():
        for other in found[1:]:
            assert other[i][:4] == r[:4] and list(other[i][4:]) == pytest.approx(list(r[4:]), rel=1e-5)


def test_lines_hold_the_gated_sum(corpus):
    """The last four bytes of a bit's line are its gated sum, the first five its logits, for words and transitions."""
    model = mixer([t for _, t in corpus])
    model.weights = np.random.default_rng(21).uniform(-1, 2, model.weights.shape).astype(np.float32)
    words, _, joints, _ = lm_score.split_units([t.encode() for _, t in corpus])
    rows = lm_score.Rows(model)
    rows.add_words(lm_score.unit_bytes(words))
    rows.add_joints([lm_score.joint_unit(j) for j in joints], lm_score.ends_before(joints))
    some = [w for w in lm_score.unit_bytes(words) if len(w) > lm_score.JOINT]
    gates = np.concatenate((lm_score.unit_bits(some, model.code, model.table, least=lm_score.JOINT)[2], lm_score.joint_bits(joints, model.code, model.table)[2]))
    lines = rows.x.held[BLOCK_BITS : rows.x.n]
    want = (lines[:, :ORDERS] / 16 * model.weights[gates].astype(np.float64)).sum(axis=1)
    got = np.ascontiguousarray(lines).view(np.int32)[:, 1] / (1 << lm_score.FINE)
    assert len(got) == len(gates) and np.abs(got - want).max() < 2e-5 and np.abs(want).max() > 10


@pytest.mark.parametrize("most", [0, 1, 5, 10**6])
def test_frequent_words_are_those_of_most_tokens(spark, corpus, monkeypatch, most):
    """However many are in the head, the rest are joined: the counts and base scores of a plain counter."""
    from collections import Counter

    long = ["x" * 15, "x" * 16, "x" * 15 + "y", "a\x00", "a"]
    texts = [t for _, t in corpus] + [" ".join(long[: k % 6]) for k in range(12)]
    split = [[*t.encode().lower().split(), b""] for t in texts]
    n = Counter(w for k, mine in enumerate(split) if k % 4 for w in mine)
    monkeypatch.setattr(lm_score, "HEAD", most)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    model = lm_score.learn(df.where("doc_id % 4 != 0"))
    held = {w: int(c) for w, c in zip(n, model.head.counts(list(n)), strict=True) if c}
    assert held.items() <= n.items() and len(held) <= most and all(n[w] < min(held.values(), default=n.total() + 1) for w in n.keys() - held.keys())
    assert len(held) + Counter(n.values())[max((n[w] for w in n.keys() - held.keys()), default=0)] > min(most, len(n) - 1)
    total = math.log10(n.total() + 0.5 * (len(n) + 1))
    for r in lm_score.score_texts(df, model, ["doc_id"]).collect():
        mine = split[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(mine), sum(w in n for w in mine), n.total())
        assert r["base_score"] == pytest.approx(sum(math.log10(n[w] + 0.5) - total for w in mine), rel=1e-9)


def test_words_of_one_mix_are_told_apart(monkeypatch):
    """Words whose keys mix alike, and those too long for keys, keep their own counts; absent ones have none."""
    words = [b"", b"a", b"a\x00", b"stone", b"x" * 15, b"x" * 16, b"x" * 17]
    absent = [b"\x00", b"b", b"x" * 14, b"x" * 18, b"stones"]
    keys = lm_score.short_keys
    for mix in (lambda m: m, np.zeros_like):
        monkeypatch.setattr(lm_score, "short_keys", lambda *x, mix=mix: (*keys(*x)[:2], mix(keys(*x)[2])))
        head = lm_score.Head(words, np.arange(1, 8))
        assert head.counts(words + absent).tolist() == [*range(1, 8), *[0] * 5] and head.counts([]).tolist() == []
        assert head.common == [b"", *words[:0:-1]]
    assert lm_score.Head([], np.zeros(0, np.int64)).counts(words).tolist() == [0] * 7
