"""Candidate search of decontamination with many items, short ones included, and the row counts of a large corpus."""

import numpy as np

from siltstone.llm import decontaminate


def test_recall_with_many_items_and_rows(spark, monkeypatch):
    rng = np.random.default_rng(4)
    common = [f"c{k}" for k in range(300)]
    share = 0.9 / np.arange(1, 301) ** 0.5

    def words(n, rare):
        return [f"r{rng.integers(0, 30000)}" if rng.random() < rare else common[k] for k in rng.choice(300, n, p=share / share.sum())]

    items = [words(n, 0.4) for n in rng.choice([8, 10, 14, 20, 40, 60], 1000)]
    docs, planted = [], {}
    for d in range(120):
        text = words(200, 0.4)
        if d >= 20:
            planted[d] = int(rng.integers(0, len(items)))
            text[90:90] = items[planted[d]]
        docs.append((d, " ".join(text)))
    bench = [(k, ("w " + " ".join(x))[2:]) for k, x in enumerate(items)]
    real = decontaminate.frequencies

    def scaled(df, block, text):
        found, rows = real(df, block, text)
        return {k: n * 100_000 for k, n in found.items()}, rows * 100_000

    monkeypatch.setattr(decontaminate, "frequencies", scaled)
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(2)
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, spark.createDataFrame(bench, "item_id long, text string")).collect()}
    found = sum((d, i) in got for d, i in planted.items())
    assert found >= 0.95 * len(planted), found


def test_paraphrases_and_many_blocks(spark, monkeypatch):
    """Three words of ten replaced, words put in between, two clauses exchanged: found, whatever the blocks and waves."""
    rng = np.random.default_rng(14)
    vocabulary = [f"v{k}" for k in range(4000)]
    items = [(k, " ".join(rng.choice(vocabulary, rng.integers(20, 50)))) for k in range(60)]
    docs, want = [], set()
    for d in range(90):
        host = rng.choice(vocabulary, 150).tolist()
        if d < 60:
            words = items[d][1].split()
            if d % 3 == 0:
                for at in rng.choice(len(words), 3 * len(words) // 10, replace=False):
                    words[at] = f"synonym{at}"
            elif d % 3 == 1:
                for at in sorted(rng.choice(len(words), len(words) // 4, replace=False), reverse=True):
                    words.insert(at, f"between{at}")
            else:
                cut = len(words) * 7 // 10
                words = words[cut:] + words[:cut]
            host[60:60] = words
            want.add((d, d))
        docs.append((d, " ".join(host)))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    found = []
    for wave, block, fit in ((16384, 256, 4), (16384, 20, 2), (25, 10, 1)):
        monkeypatch.setattr(decontaminate, "WAVE_ITEMS", wave)
        monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", block)
        monkeypatch.setattr(decontaminate, "FIT_BLOCKS", fit)
        found.append({(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, bench).collect()})
    for got in found:
        assert got <= want and len(got) >= 0.9 * len(want), len(got)


def test_latent_vectors_are_those_of_the_plain_svd(spark):
    """The sparse latent vectors of a small index against numpy's decomposition of the same matrix."""
    rng = np.random.default_rng(15)
    items = [(k, [b"w%d" % x for x in rng.integers(0, 40, 12)], frozenset()) for k in range(6)]
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 60, 50)) for _ in range(40)]
    index = decontaminate.Index(items)
    index.weigh({i: 1 + i % 7 for i in index.ids.values()}, 40)
    decontaminate.fit(index, spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), [list(range(6))], rank=4)
    own = sorted({i for w in index.words for i in w.tolist()})
    rows = []
    for t in texts:
        ids = np.array([index.ids.get(w.encode(), 0) for w in t.split()])
        row = np.array([np.sqrt((ids == i).sum()) * index.idf[i] for i in own])
        rows.append(row / np.sqrt((index.idf[ids].astype(float) ** 2).sum()))
    units = np.zeros((6, len(own)))
    for k in range(6):
        i, w = index.unit(k)
        units[k, np.searchsorted(own, i)] = w
    _, _, v = np.linalg.svd(np.vstack([np.array(rows), np.sqrt(len(texts) / 6) * units]), full_matrices=False)
    for k in range(6):
        smooth = v[:4].T @ (v[:4] @ units[k])
        smooth /= np.linalg.norm(v[:4] @ units[k])
        got = np.zeros(len(own))
        i, w = index.latent[k]
        got[np.searchsorted(own, i)] = w
        assert np.dot(got, smooth) > 0.95 * np.linalg.norm(got) * np.linalg.norm(smooth)


def plain_space(index, texts, rank):
    """The items' words, and numpy's leading directions of all passages (texts of one window) and the items."""
    own = sorted({i for w in index.words for i in w.tolist()})
    rows = []
    for t in texts:
        ids = np.array([index.ids.get(w.encode(), 0) for w in t.split()])
        row = np.array([np.sqrt((ids == i).sum()) * index.idf[i] for i in own])
        rows.append(row / np.sqrt((index.idf[ids].astype(float) ** 2).sum()))
    units = np.zeros((len(index.words), len(own)))
    for k in range(len(units)):
        i, w = index.unit(k)
        units[k, np.searchsorted(own, i)] = w
    held = sum(r.any() for r in rows)
    _, _, v = np.linalg.svd(np.vstack([np.array(rows), np.sqrt(held / len(units)) * units]), full_matrices=False)
    return own, units, v[:rank]


def test_latent_space_is_that_of_every_row(spark, monkeypatch):
    """3000 texts, some words of which stand together in few of them: none may be left out of the fit."""
    rng = np.random.default_rng(21)
    items = [(k, " ".join(f"w{x}" for x in rng.choice(80, 12, replace=False))) for k in range(40)]
    texts = [" ".join(f"w{x}" for x in (5 * rng.integers(0, 1 + d % 16) + rng.integers(0, 6, 40)) % 100) for d in range(3000)]
    monkeypatch.setattr(decontaminate, "RANK", 40)
    monkeypatch.setattr(decontaminate, "POWER_ROUNDS", 30)
    df, bench = spark.createDataFrame([(t,) for t in texts], "body string").repartition(5), spark.createDataFrame(items, "item_id long, text string")
    real, fitted = decontaminate.fit, []

    def watched(index, docs, *rest, **more):
        fitted.append(docs.count())
        real(index, docs, *rest, **more)

    monkeypatch.setattr(decontaminate, "fit", watched)
    (index,) = decontaminate.indexes(df, bench, "body", "item_id", "text")
    assert fitted == [3000]
    own, units, v = plain_space(index, texts, 40)
    for k in range(len(items)):
        smooth = v.T @ (v @ units[k])
        got = np.zeros(len(own))
        i, w = index.latent[k]
        got[np.searchsorted(own, i)] = w
        assert np.abs(got - smooth / np.linalg.norm(v @ units[k])).max() < 0.01


def test_gram_matrix_of_batches(monkeypatch):
    """Dense head and paired tail, cut into chunks, against the plain product."""
    monkeypatch.setattr(decontaminate, "HEAD_WORDS", 7)
    monkeypatch.setattr(decontaminate, "CHUNK_ROWS", 16)
    rng = np.random.default_rng(22)
    gram, total = decontaminate.Gram(50), np.zeros((50, 50))
    for _ in range(4):
        rows = rng.random((30, 50)) * (rng.random((30, 50)) < 0.2)
        row, word = np.nonzero(rows)
        gram.add(row, word, rows[row, word].astype(np.float32))
        total += rows.T @ rows
    got = np.zeros((50, 50))
    for low in range(0, 50, 16):
        at, part = gram.chunk(low)
        got[low + at // 50, at % 50] = part
    assert np.allclose(got, np.tril(total), atol=1e-4) and gram.rows == 120


def test_blocks_are_bounded_by_their_words(monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 10)
    index = decontaminate.Index([(k, [b"w%d" % (3 * k + j) for j in range(4)], frozenset()) for k in range(7)])
    blocks = decontaminate.item_blocks(index)
    assert sum(blocks, []) == list(range(7)) and len(blocks) > 1
    assert all(len({w for k in b for w in index.words[k].tolist()}) <= 10 for b in blocks)
