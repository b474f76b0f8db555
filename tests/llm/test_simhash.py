"""The near-duplicate search against brute-force Jaccard similarity of 5-word shingles; trees that are broadcast; long
texts; components that do not settle; clashing columns."""

import numpy as np
import pytest

import corpus_pipeline
from siltstone.llm import simhash


def grams(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_stage_reaches_jaccard(spark, tmp_path):
    rng = np.random.default_rng(8)
    texts = []
    for n in rng.integers(40, 300, 30):
        base = [f"w{x}" for x in rng.integers(0, 5000, n)]
        texts.append(" ".join(base))
        for edits in (1, max(1, n // 60), max(2, n // 25), n // 8):
            changed = list(base)
            for at in rng.choice(n, edits, replace=False):
                changed[at] = f"x{rng.integers(0, 5000)}"
            texts.append(" ".join(changed))
    texts += [texts[0], "", " ", "a b", "A  b"]
    sets = [grams(t) for t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for k in range(i):
            if len(sets[i] & sets[k]) >= 0.8 * len(sets[i] | sets[k]):
                low, high = sorted((group[i], group[k]))
                group = [low if g == high else g for g in group]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    assert sorted(r["doc_id"] for r in stage(spark, df, str(tmp_path)).collect()) == sorted(set(group))
    assert len(set(group)) < len(texts) - 30
    parts = simhash.keep_similar(df, shard_rows=2)
    assert sorted(r["doc_id"] for r in parts.collect()) == sorted(set(group))


def brute_components(values, radius=3):
    group = {v: v for v in values}

    def root(v):
        while group[v] != v:
            v = group[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= radius:
                x, y = sorted((root(a), root(b)))
                group[y] = x
    out = {}
    for v in values:
        out.setdefault(root(v), set()).add(v)
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("tree_from, tree_rows", [(256, 1 << 16), (3, 1 << 16), (3, 40), (1 << 20, 1 << 20)])
def test_broadcast_trees_and_shuffled_shards_agree(spark, tree_from, tree_rows):
    rng = np.random.default_rng(10)
    values = {int(x) for x in rng.integers(0, 1 << 62, 60)}
    hot = int(rng.integers(0, 1 << 62))  # its shards hold many: the low 16 bits differ
    values |= {hot ^ (int(x) & 0xFFFF) for x in rng.integers(0, 1 << 16, 150)}
    values = sorted(values)
    df = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long")
    edges = simhash.links(df, shard_rows=16, tree_from=tree_from, tree_rows=tree_rows)
    table = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    got = {}
    for v in values:
        got.setdefault(table.get(simhash._signed(v), simhash._signed(v)), set()).add(v)
    assert sorted(map(sorted, got.values())) == brute_components(values)


def test_unsettled_components_raise(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(64)], "a long, b long")
    assert {r["root"] for r in simhash.components(path).collect()} == {0}
    with pytest.raises(RuntimeError):
        simhash.components(path, max_rounds=1)


@pytest.mark.parametrize("width", [1, 3, 5])
def test_long_texts_in_pieces(width):
    rng = np.random.default_rng(11)
    for n in (0, 1, 2, 3, 4, 5, 6, 40, 300):
        raw = b"".join(b"w%d%s" % (x, rng.choice([b" ", b"\n\t ", b"  "])) for x in rng.integers(0, 50, n))
        whole = simhash.shingle_hashes(raw, width)
        for size in (1, 7, 50):
            assert np.concatenate([np.zeros(0, np.uint64), *simhash.shingle_pieces(raw, width, size)]).tolist() == whole
        old, simhash.PIECE = simhash.PIECE, 64
        try:
            assert simhash.text_fingerprints([raw, b"a", raw], width).tolist() == simhash.fingerprints_of([whole, simhash.shingle_hashes(b"a", width), whole]).tolist()
        finally:
            simhash.PIECE = old


def test_bands_rarely_miss():
    """Pairs of exactly 0.8 share a key, and their fingerprints lie within the wide radius."""
    rng = np.random.default_rng(12)
    missed = far = 0
    for _ in range(400):
        size = int(rng.integers(1, 9)) * 10
        common = rng.integers(0, 1 << 63, 8 * size // 10 * 10, dtype=np.uint64)
        own = rng.integers(0, 1 << 63, (2, size), dtype=np.uint64)
        a, b = (np.unique(np.concatenate((common, x))) for x in own)
        x, y = simhash.band_keys([a, b])
        missed += not (x == y).any()
        p, q = simhash.set_fingerprints([a, b]).tolist()
        far += (p ^ q).bit_count() > simhash.WIDE
    assert missed <= 2 and far <= 2


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c d", 5, 6, 7, 8, 9), (2, "a b c d", 1, 2, 3, 4, 5), (3, None, 0, 0, 0, 0, 0)], "doc_id long, text string, row int, fp int, node int, keys int, set int")
    for keep in (simhash.keep_one, simhash.keep_similar):
        got = keep(df)
        assert got.columns == df.columns and sorted(tuple(r) for r in got.collect()) == [(1, "a b c d", 5, 6, 7, 8, 9), (3, None, 0, 0, 0, 0, 0)]
