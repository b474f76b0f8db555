"""SimHash near-duplicates: 64-bit fingerprints, BK-trees of shards, connected components.

A shard's fingerprints form a BK-tree: children are keyed by their integer Hamming distance to the parent, and a
search follows only edges within the radius of the query's own distance. There are two searches.

`simhash_components` links fingerprints that differ in at most 3 of 64 bits. Those agree on all bits of at least
`blocks - 3` of `blocks` equal blocks, so every linked pair meets in the shard of some choice of blocks. The trees of
the largest shards (`TREE_FROM` fingerprints or more, `TREE_ROWS` in all, which bounds what is broadcast) are
broadcast and every fingerprint of those shards asks them where it lies. Fingerprints of a corpus have no size bound,
so all other shards go by the shuffle: a shard is a group, and one above `SHARD_ROWS` is cut into parts, every pair of
parts being one task (the tree of one, the other as queries). No task holds an unbounded group and no link is lost.

`keep_similar` links texts with a Jaccard similarity of `SIMILARITY` or more over 5-word shingles. Such fingerprints
differ in about 10 bits, for which blocks would be 3 bits wide and a shard a part of the corpus; its shards are dealt by
`BANDS` keys of `ROWS` minima of the shingles instead (a pair of 0.8 shares none with probability (1 - 0.8^ROWS)^BANDS,
0.0002, and a more similar pair with less). In a shard the BK-tree proposes what lies within `WIDE` bits, and the exact
similarity of the shingle sets (the upper 32 bits of their hashes) decides. Equal sets are one node.

A task returns a spanning forest of its links, not all pairs. Components come from large-star/small-star rounds whose
edges are written between rounds; if they do not settle an error is raised.

Edge cases: null text counts as empty; fewer words than a shingle form one shingle of all words; no words give the
fingerprint zero, which links like any other, and the empty set, which equals any other; equal fingerprints are one
node, so copies are never expanded into pairs; very long texts are hashed in pieces; rows without an id keep their
fingerprint and take the component of the others; an empty table gives an empty result; columns may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.scratch import fresh
from siltstone.functions.shipping import ship
from siltstone.llm.common import slices, stored, tidy, utf8

BITS, RADIUS, SHINGLE_WORDS, SEED, SHARD_ROWS = 64, 3, 3, 42, 2048
TREE_FROM, TREE_ROWS, BROADCAST_ROWS = 256, 1 << 16, 500_000
WIDE, WIDE_WORDS, SIMILARITY, BANDS, FIRST_BANDS, ROWS, SIMILAR_ROWS = 22, 5, 0.8, 16, 4, 4, 1024
PIECE, HASHES, BATCH_BYTES = 1 << 20, 200_000, 1 << 22
_RANDOM = np.random.default_rng(5).integers(0, 1 << 64, (2, BANDS * ROWS), dtype=np.uint64)
_TIMES, _PLUS, _MIX = _RANDOM[0] | np.uint64(1), _RANDOM[1], np.uint64(0x9E3779B97F4A7C15)
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def shingle_hashes(raw: bytes, width: int = SHINGLE_WORDS) -> list[int]:
    words = raw.lower().split()
    if not words:
        return []
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return [digest(b" ".join(words), SEED)]
    join = b" ".join
    return [digest(join(words[i : i + width]), SEED) for i in range(len(words) - width + 1)]


def shingle_pieces(raw: bytes, width: int, size: int = PIECE) -> Iterator[np.ndarray]:
    """The hashes of shingle_hashes, of about `size` bytes of text at a time."""
    if len(raw) <= size:
        yield np.array(shingle_hashes(raw, width), dtype=np.uint64)
        return
    at, head, seen = 0, b"", False
    while at < len(raw):
        cut = _SPACE.search(raw, min(len(raw), at + size))
        end = cut.start() if cut else len(raw)
        piece = head + b" " + raw[at:end]
        words = piece.split()
        if len(words) >= width or (end == len(raw) and not seen):
            yield np.array(shingle_hashes(piece, width), dtype=np.uint64)
            seen, head = True, b" ".join(words[-(width - 1) :]) if width > 1 else b""
        else:
            head = piece
        at = end


def fingerprints_of(hashes: list) -> np.ndarray:
    """A fingerprint for each list of hashes: a bit is set where over half of the hashes have it."""
    out = np.zeros(len(hashes), dtype=np.uint64)
    sizes = np.array([len(h) for h in hashes], dtype=np.int64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    flat = np.concatenate([np.asarray(h, dtype="<u8") for h in hashes])
    bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    starts = np.cumsum(sizes[full]) - sizes[full]
    counts = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    ones = (2 * counts > sizes[full, None]).astype(np.uint8)
    out[full] = np.packbits(ones, axis=1, bitorder="little").view("<u8").ravel()
    return out


def long_fingerprint(raw: bytes, width: int) -> np.ndarray:
    """The fingerprint of one text, piece by piece."""
    ones, n = np.zeros(BITS, dtype=np.int64), 0
    for hashes in shingle_pieces(raw, width):
        ones += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view("<u8")


def text_fingerprints(raws: list[bytes | None], width: int = SHINGLE_WORDS) -> np.ndarray:
    fps, held, size = [], [], 0
    for raw in raws:
        if raw and len(raw) > PIECE:
            fps += [fingerprints_of(held), long_fingerprint(raw, width)]
            held, size = [], 0
            continue
        held.append(shingle_hashes(raw or b"", width))
        size += len(held[-1])
        if size > HASHES:
            fps.append(fingerprints_of(held))
            held, size = [], 0
    return np.concatenate([*fps, fingerprints_of(held)])


def fingerprints(df: DataFrame, keep: list[str], text: str = "text", name: str = "fp") -> DataFrame:
    """The `keep` columns and the fingerprint's 64 bits as a signed long."""
    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = text_fingerprints(utf8(batch, text))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(fps.view(np.int64))], names=schema.names)

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(tidy(run), schema)


class BKTree:
    """Distinct integers; a child hangs on the edge of its Hamming distance to the parent."""

    __slots__ = ("values", "edges")

    def __init__(self):
        self.values: list[int] = []
        self.edges: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        self.values.append(value)
        self.edges.append({})
        me, at = len(self.values) - 1, 0
        while me:
            d = (self.values[at] ^ value).bit_count()
            nxt = self.edges[at].get(d)
            if nxt is None:
                self.edges[at][d] = me
                return
            at = nxt

    def within(self, value: int, radius: int) -> list[int]:
        """Positions of all values at most `radius` bits away."""
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            for edge, child in self.edges[at].items():
                if d - radius <= edge <= d + radius:
                    todo.append(child)
        return found


class Forest:
    """Keeps of all links those that connect something new."""

    def __init__(self):
        self.parent: dict[int, int] = {}
        self.out: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        parent = self.parent
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    def link(self, a: int, b: int) -> None:
        ra, rb = self.root(a), self.root(b)
        if ra != rb:
            self.parent[max(ra, rb)] = min(ra, rb)
            self.out.append((a, b))


def forest(tree_values: list[int], queries: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that connect what links of tree x (tree or queries) connect; at most one per value."""
    tree, found = BKTree(), Forest()
    for v in tree_values:
        if not queries:
            for at in tree.within(v, radius):
                found.link(tree.values[at], v)
        tree.add(v)
    for v in queries:
        for at in tree.within(v, radius):
            found.link(tree.values[at], v)
    return found.out


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Elements common to two sorted sets."""
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


def similar_forest(nodes: list[int], fps: list[int], sets: list[bytes], query: list[bool], similarity: float = SIMILARITY, radius: int = WIDE) -> list[tuple[int, int]]:
    """Links that connect what all similar pairs connect: of queries with the others, or of all where there are no
    queries. The BK-tree of the fingerprints proposes; sets whose nodes are connected already are not compared."""
    arrays = [np.frombuffer(x, dtype="<u4") for x in sets]
    tree, found, both = BKTree(), Forest(), any(query)

    def ask(i: int) -> None:
        mine, me = arrays[i], nodes[i]
        for at in tree.within(fps[i], radius):
            k = places[at]
            other = arrays[k]
            if found.root(me) == found.root(nodes[k]) or min(len(mine), len(other)) < similarity * max(len(mine), len(other)) - 1e-9:
                continue
            common = shared(mine, other)
            if common >= similarity * (len(mine) + len(other) - common) - 1e-9:
                found.link(nodes[k], me)

    places: list[int] = []
    for i, asks in enumerate(query):
        if not asks:
            if not both:
                ask(i)
            tree.add(fps[i])
            places.append(i)
    for i, asks in enumerate(query):
        if asks:
            ask(i)
    return found.out


def masks(blocks: int, radius: int = RADIUS) -> list[int]:
    """One mask for each choice of blocks - radius blocks."""
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(x) for x in combinations(block, blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def blocks_for(n: int) -> int:
    """More, narrower shards as the number of fingerprints grows; exact for any choice."""
    return 4 if n <= 1 << 21 else 5 if n <= 1 << 29 else 6


def dealt(keyed: DataFrame, sizes: DataFrame, by: str, rows: int, carry: list[str]) -> DataFrame:
    """Rows of shards (c, k) with their tasks: a, b (parts of the shard) and query (the row is of b, asked of a's tree).
    Sorted by task; `by` deals a shard's rows over its parts."""
    parts = F.ceil(F.col("count") / rows).cast("int")
    placed = keyed.join(sizes, ["c", "k"]).select("c", "k", *carry, F.pmod(F.xxhash64(by), parts).cast("int").alias("s"), parts.alias("parts"))
    return placed.select(*placed.columns, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("t")).select(
        "c", "k", F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b"), (F.col("s") > F.col("t")).alias("query"), *carry
    )


def by_task(tasks: DataFrame, carry: list[str], solve) -> DataFrame:
    """a, b: the pairs that solve(columns of carry, query) returns for each task; a part alone is its own task."""
    by = ["c", "k", "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, [[] for _ in range(len(carry) + 1)]
        out: list[tuple[int, int]] = []

        def ended():
            if len(held[0]) > 1 and (key[2] == key[3] or any(held[-1])):
                out.extend(solve(*held))

        for batch in batches:
            cols = [batch.column(x).to_pylist() for x in (*by, *carry, "query")]
            for c, k, a, b, *x in zip(*cols, strict=True):
                if (c, k, a, b) != key:
                    ended()
                    key, held = (c, k, a, b), [[] for _ in range(len(carry) + 1)]
                for column, value in zip(held, x, strict=True):
                    column.append(value)
            if out:
                yield _pairs(out)
                out.clear()
        ended()
        yield _pairs(out)

    return tasks.repartition(*by).sortWithinPartitions(*by, carry[0]).mapInArrow(tidy(run), "a long, b long")


def _unsigned(x: int) -> int:
    return x & 0xFFFFFFFFFFFFFFFF


def _solve(radius: int):
    def solve(fps: list[int], query: list[bool]) -> list[tuple[int, int]]:
        tree = [_unsigned(x) for x, q in zip(fps, query, strict=True) if not q]
        asked = [_unsigned(x) for x, q in zip(fps, query, strict=True) if q]
        return [(_signed(x), _signed(y)) for x, y in forest(tree, asked, radius)]

    return solve


def links(distinct: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS, tree_from: int = TREE_FROM, tree_rows: int = TREE_ROWS) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) whose components are those of all links."""
    keyed = masks(blocks_for(distinct.count()), radius)
    rows = distinct.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for i, m in enumerate(keyed)))).alias("x")).select("fp", "x.c", "x.k")
    sizes = stored(rows.groupBy("c", "k").count().where("count > 1"), "shards")
    large, held = [], 0
    for r in sizes.where(F.col("count").between(tree_from, tree_rows)).orderBy(F.desc("count"), "c", "k").limit(max(1, tree_rows // tree_from)).collect():
        if held + r["count"] <= tree_rows:
            large.append((r["c"], r["k"]))
            held += r["count"]
    if not large:
        return by_task(dealt(rows, sizes, "fp", shard_rows, ["fp"]), ["fp"], _solve(radius)).distinct()
    spark = distinct.sparkSession
    some = F.broadcast(spark.createDataFrame(large, "c int, k long"))
    theirs = rows.join(some, ["c", "k"], "left_semi")
    trees: dict[tuple[int, int], list[int]] = {}
    for r in theirs.collect():  # tree_rows at most
        trees.setdefault((r["c"], r["k"]), []).append(r["fp"])
    sent = spark.sparkContext.broadcast({x: np.sort(np.array(v, dtype=np.int64)) for x, v in trees.items()})

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built: dict[tuple[int, int], BKTree] = {}
        for batch in batches:
            found = Forest()
            for c, k, fp in zip(*(batch.column(x).to_pylist() for x in ("c", "k", "fp")), strict=True):
                if (c, k) not in built:
                    built[c, k] = BKTree()
                    for v in sent.value[c, k].tolist():
                        built[c, k].add(_unsigned(v))
                tree = built[c, k]
                for at in tree.within(_unsigned(fp), radius):
                    found.link(_signed(tree.values[at]), fp)
            yield _pairs(found.out)

    rest = sizes.join(some, ["c", "k"], "left_anti")
    shuffled = by_task(dealt(rows, rest, "fp", shard_rows, ["fp"]), ["fp"], _solve(radius))
    return theirs.mapInArrow(ask, "a long, b long").unionByName(shuffled).distinct()


def _pairs(out: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(2)], names=["a", "b"])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root for every node of the edges (a, b); root is the least node of its component. The rounds grow with the
    logarithm of the nodes; if `max_rounds` do not settle them, an error is raised."""
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    for _ in range(max_rounds):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u")
        new = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        now = stored(new, "edges")
        got = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if got == state:
            break
        state = got
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def component_table(prints: DataFrame, fp: str, rank: Column, radius: int = RADIUS) -> DataFrame:
    """fp and least: for each distinct fingerprint, the smallest `rank` among the rows of its component."""
    distinct = stored(prints.groupBy(F.col(fp).alias("fp")).agg(F.min(rank).alias("least")), "distinct")
    linked = components(links(distinct.select("fp"), radius))
    rooted = distinct.join(linked, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("least_of_all"))
    return rooted.join(smallest, "root").select("fp", F.col("least_of_all").alias("least"))


def simhash_components(df: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per input row: doc_id, fp (signed long), component_id, the smallest doc_id reachable."""
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    prints = stored(fingerprints(rows, ["doc_id"]), "fingerprints")
    table = component_table(prints, "fp", F.col("doc_id"), radius).withColumnRenamed("least", "component_id")
    return prints.join(table, "fp").select("doc_id", "fp", "component_id")


def without_losers(rows: DataFrame, winners: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """`columns` of the rows whose key is a winner's. Where the others are few (`BROADCAST_ROWS`) they are broadcast, so
    that texts stay where they are; else texts are dealt, not sorted."""
    losers = stored(rows.select(key).join(winners.select(key), key, "left_anti"), "losers")
    side = F.broadcast(losers) if losers.count() <= BROADCAST_ROWS else losers.hint("shuffle_hash")
    return rows.join(side, key, "left_anti").select(*columns)


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """All columns of one row for each component of linked fingerprints: that of the smallest doc_id, ids before nulls,
    then the first read."""
    row, fp = fresh(df.columns, "row", "fp")
    numbered = df.withColumn(row, F.monotonically_increasing_id())
    rows = stored(fingerprints(numbered, numbered.columns, text, fp), "fingerprinted")
    rank = F.struct(F.col(doc_id).isNull().alias("a"), F.col(doc_id).alias("b"), F.col(row).alias("c"))
    winners = component_table(rows.select(F.col(fp), F.col(doc_id), F.col(row)), fp, rank, radius).select(F.col("least.c").alias(row)).distinct()
    return without_losers(rows, winners, row, df.columns)


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BANDS keys for each set; an empty set counts as that of the hash zero."""
    sets = [s if len(s) else np.zeros(1, dtype=np.uint64) for s in sets]
    flat, sizes = np.concatenate(sets), np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    out = np.zeros((len(sets), BANDS), dtype=np.uint64)
    for k in range(BANDS * ROWS):
        band = out[:, k // ROWS]
        band *= _MIX
        band += np.minimum.reduceat(flat * _TIMES[k] + _PLUS[k], starts)
        band ^= band >> np.uint64(29)
    return out


def shingled(df: DataFrame, text: str, names: list[str]) -> DataFrame:
    """All columns and, under the four names: node (long: of equal sets), fingerprint, keys (array of long), set (4 bytes
    a shingle)."""
    kinds = (T.LongType(), T.LongType(), T.ArrayType(T.LongType()), T.BinaryType())
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in zip(names, kinds, strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices([whole], text, BATCH_BYTES):
                nodes, packed, fps = [], [], []
                keys, held, size = [np.zeros((0, BANDS), dtype=np.uint64)], [], 0
                for raw in utf8(batch, text):
                    raw = raw or b""
                    hashes = np.concatenate(list(shingle_pieces(raw, WIDE_WORDS))) if len(raw) > PIECE else np.array(shingle_hashes(raw, WIDE_WORDS), dtype=np.uint64)
                    got = np.unique(hashes)
                    nodes.append(xxhash.xxh64_intdigest(got.tobytes()))
                    packed.append(np.unique(got >> np.uint64(32)).astype("<u4").tobytes())
                    held.append(got)
                    size += len(got)
                    if size > HASHES:
                        keys.append(band_keys(held))
                        fps.append(set_fingerprints(held))
                        held, size = [], 0
                if held:
                    keys.append(band_keys(held))
                    fps.append(set_fingerprints(held))
                flat = pa.array(np.concatenate(keys).view(np.int64).ravel())
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(nodes) + 1, dtype=np.int32) * BANDS), flat)
                cols = [pa.array(np.array(nodes, dtype=np.uint64).view(np.int64)), pa.array(np.concatenate([np.zeros(0, np.uint64), *fps]).view(np.int64)), bands, pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=schema.names)

    return df.mapInArrow(tidy(run), schema)


def set_fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """The fingerprint of each set of distinct shingles; PIECE hashes at a time of a large one."""
    out = np.zeros(len(sets), dtype=np.uint64)
    small = [i for i, s in enumerate(sets) if len(s) <= PIECE]
    out[small] = fingerprints_of([sets[i] for i in small])
    for i, s in enumerate(sets):
        if len(s) > PIECE:
            ones = sum(np.unpackbits(s[a : a + PIECE].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for a in range(0, len(s), PIECE))
            out[i] = np.packbits((2 * ones > len(s)).astype(np.uint8), bitorder="little").view("<u8")[0]
    return out


def similar_links(keyed: DataFrame, sets: DataFrame, nodes: DataFrame, similarity: float = SIMILARITY, shard_rows: int = SIMILAR_ROWS) -> DataFrame:
    """a, b: links between nodes that share a shard. keyed: node, c, k; sets: at, fp, set; nodes: node and `at`, the row that
    stands for it."""
    sizes = keyed.groupBy("c", "k").count().where("count > 1")
    tasks = dealt(keyed, sizes, "node", shard_rows, ["node"]).join(nodes, "node").join(sets, "at").select("c", "k", "a", "b", "query", "node", "fp", "set")

    def solve(node, fp, held, query):
        return similar_forest(node, [_unsigned(x) for x in fp], held, query, similarity)

    return by_task(tasks, ["node", "fp", "set"], solve).distinct()


def similar_components(rows: DataFrame, nodes: DataFrame, similarity: float = SIMILARITY, shard_rows: int = SIMILAR_ROWS) -> DataFrame:
    """node, root of the nodes with a link. rows: row, node, fp, keys, set; nodes: node and `at`.

    The shards of the first FIRST_BANDS keys connect most of what is to be connected. A shard of the other keys whose nodes
    are in one component already can connect nothing more and is left out, sets and all."""
    keyed = stored(rows.select("node", F.posexplode("keys").alias("c", "k")).distinct(), "bands")
    sets = rows.select(F.col("row").alias("at"), "fp", "set")
    first = stored(similar_links(keyed.where(F.col("c") < FIRST_BANDS), sets, nodes, similarity, shard_rows), "links")
    roots = stored(components(first).withColumnRenamed("node", "n"), "roots")
    placed = keyed.where(F.col("c") >= FIRST_BANDS).join(roots, F.col("node") == F.col("n"), "left").select("node", "c", "k", F.coalesce("root", "node").alias("root"))
    open_shards = placed.groupBy("c", "k").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("c", "k")
    rest = placed.join(open_shards, ["c", "k"], "left_semi").select("node", "c", "k")
    return components(first.unionByName(similar_links(rest, sets, nodes, similarity, shard_rows)))


def keep_similar(df: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, shard_rows: int = SIMILAR_ROWS) -> DataFrame:
    """All columns of one row for each component of similar texts: that of the smallest doc_id, ids before nulls, then the
    first read."""
    ship(df.sparkSession)
    names = fresh(df.columns, "row", "node", "fp", "keys", "set")
    whole = stored(shingled(df.withColumn(names[0], F.monotonically_increasing_id()), text, names[1:]), "shingled")
    rank: Column = F.struct(F.col(doc_id).isNull().alias("a"), F.col(doc_id).alias("b"), F.col(names[0]).alias("c"))
    rows = whole.select(rank.alias("rank"), *(F.col(x).alias(y) for x, y in zip(names, ("row", "node", "fp", "keys", "set"), strict=True)))
    nodes = stored(rows.groupBy("node").agg(F.min("rank").alias("least")), "nodes")
    linked = similar_components(rows, nodes.select("node", F.col("least.c").alias("at")), similarity, shard_rows).withColumnRenamed("node", "n")
    rooted = nodes.join(linked, F.col("node") == F.col("n"), "left").select("least", F.coalesce("root", "node").alias("root"))
    winners = rooted.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.c").alias(names[0]))
    return without_losers(whole, winners, names[0], df.columns)


def fingerprint_text(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
