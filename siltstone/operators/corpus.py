"""Corpus build: contamination joins, ordered dedup, funnel, packing, holdouts."""

from __future__ import annotations

import re
from hashlib import blake2b
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import hashing as hs
from siltstone.functions import text as tx
from siltstone.functions.scratch import fresh, stored
from siltstone.functions.shipping import ship

NGRAM = 13
#: A side is broadcast only below this many rows; beyond it the join shuffles both sides.
BROADCAST_ROWS = 200_000


def small(df: DataFrame) -> DataFrame:
    """Broadcast hint if the frame has at most BROADCAST_ROWS rows, else the frame as it is."""
    n = df.limit(BROADCAST_ROWS + 1).count()
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def distinct_ngrams(benchmark: DataFrame, text: str = "text", n: int = NGRAM) -> DataFrame:
    return benchmark.select(F.explode(tx.shingles(tx.word_tokens(F.col(text)), n)).alias("gram")).distinct()


def contaminated_ids(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = NGRAM) -> DataFrame:
    """Ids of documents that share a word n-gram with the benchmark.

    Hashes alone meet first, so that no window's text is dealt; the windows of documents with a hit then meet as text."""
    wanted = stored(distinct_ngrams(benchmark, text, n).withColumn("h", F.xxhash64("gram")), "grams")
    grams = tx.shingles(tx.word_tokens(F.col(text)), n)
    hashes = docs.select(doc_id, F.explode(F.transform(grams, lambda g: F.xxhash64(g))).alias("h"))
    maybe = hashes.join(small(wanted.select("h").distinct()), "h", "left_semi").select(doc_id).distinct()
    found = docs.join(small(maybe), doc_id, "left_semi").select(doc_id, F.explode(grams).alias("gram"))
    return found.join(small(wanted.select("gram")), "gram", "left_semi").select(doc_id).distinct()


def shared_spans(docs: DataFrame, side: str, doc_id: str = "doc_id", text: str = "text", width: int = 32) -> DataFrame:
    """Ids of documents that share `width` words in a row with a document of the other side (a boolean column).

    Of every span the least fingerprint of its half spans stands for it: equal spans have equal ones, and neighbours mostly the
    same, so few are dealt. Spans whose fingerprint both sides hold then meet by 128-bit digests of their words."""
    half = width // 2
    ship(docs.sparkSession)
    rows = docs.where(F.col(side).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("i"), F.col(side).alias("s"), F.lower(text).alias("t"))
    kind = rows.schema["i"].dataType.simpleString()

    def spans(raw: str | None, known: dict) -> tuple[list[bytes], np.ndarray]:
        words = re.findall(rb"[a-z0-9]+", (raw or "").encode())
        if len(words) < width:
            return words, np.zeros(0, dtype=np.int64)
        for w in words:
            if w not in known:
                known[w] = int.from_bytes(blake2b(w, digest_size=8).digest(), "little")
        marks = hs.span_hashes(np.array([known[w] for w in words], dtype=np.uint64), half)
        return words, np.lib.stride_tricks.sliding_window_view(marks, width - half + 1).min(axis=1).view(np.int64)

    def mapped(some, schema: str, judge):
        """judge(words, marks, row's last column) gives the values of each row's output."""

        def run(batches):
            known: dict = {}
            for whole in batches:
                for at in range(0, whole.num_rows, 256):
                    batch = whole.slice(at, 256)
                    if len(known) > 500_000:
                        known.clear()
                    last = batch.column(batch.num_columns - 1).to_pylist()
                    got = [judge(*spans(x, known), y) for x, y in zip(batch.column("t").to_pylist(), last, strict=True)]
                    took = pa.array(np.repeat(np.arange(len(got)), [len(x) for x in got]))
                    values = [v for x in got for v in x]
                    yield pa.RecordBatch.from_arrays([batch.column("i").take(took), batch.column("s").take(took), pa.array(values, pa.int64() if schema == "long" else pa.binary())], names=["i", "s", "v"])

        return some.mapInArrow(run, f"i {kind}, s boolean, v {schema}")

    def digests(words, marks, wanted):
        at = np.flatnonzero(np.isin(marks, np.array(wanted, dtype=np.int64))).tolist()
        return list({blake2b(b" ".join(words[k : k + width]), digest_size=16).digest() for k in at})

    def both(df):
        return df.groupBy("v").agg(F.min("s").alias("a"), F.max("s").alias("b")).where("a <> b").select("v")

    marks = stored(mapped(rows, "long", lambda words, marks, _: np.unique(marks).tolist()), "marks")
    wanted = marks.join(both(marks), "v", "left_semi").groupBy("i").agg(F.collect_set("v").alias("wanted"))
    found = stored(mapped(rows.join(wanted, "i").select("i", "s", "t", "wanted"), "binary", digests), "spans")
    return found.join(both(found), "v", "left_semi").select(F.col("i").alias(doc_id)).distinct()


def phrase_ids(docs: DataFrame, questions: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 5, most: int = 12) -> DataFrame:
    """Ids of documents in which a whole question of least to most words stands. Only lengths that occur are tried."""
    q = questions.select(tx.word_tokens(F.col(text)).alias("w")).where(F.size("w").between(least, most)).select(F.size("w").alias("n"), F.array_join("w", " ").alias("gram")).distinct()
    lengths = sorted(r["n"] for r in q.select("n").distinct().collect())
    if not lengths:
        return docs.select(doc_id).limit(0)
    words = docs.select(doc_id, tx.word_tokens(F.col(text)).alias("w"))
    grams = words.select(doc_id, F.explode(F.concat(*(tx.shingles(F.col("w"), n) for n in lengths))).alias("gram"))
    return grams.join(small(q.select("gram").distinct()), "gram", "left_semi").select(doc_id).distinct()


def first_rows(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row of the least `order` for each key; a partial aggregate, so hot keys do not gather in one task."""
    firsts = df.groupBy(F.col(key).alias("__k")).agg(F.min(order).alias("__o"))
    return df.join(firsts, (F.col(key) == F.col("__k")) & (F.col(order) == F.col("__o")), "left_semi")


def funnel_status(docs: DataFrame, benchmark: DataFrame, minimum: int = 200, max_tokens: int = 262_144) -> DataFrame:
    """doc_id, digest and status: rejected text, contaminated, too long, duplicate of an accepted document, accepted.

    Contaminated and too long documents do not count as seen, so a later copy has its own reason."""
    clean = tx.stripped_text(F.col("text"))
    bad = contaminated_ids(docs.select("doc_id", clean.alias("text")), benchmark).withColumn("hit", F.lit(True))
    cleaned = docs.select("doc_id", "text", clean.alias("clean"))
    facts = cleaned.select("doc_id", tx.clean_reason(F.col("text"), minimum).alias("why"), hs.text_digest(tx.normalized(F.col("clean"))).alias("digest"), (F.size(tx.word_tokens(F.col("clean"))) > max_tokens).alias("long"))
    facts = stored(facts.join(bad, "doc_id", "left").withColumn("hit", F.coalesce("hit", F.lit(False))), "facts")
    firsts = facts.where("why IS NULL AND NOT hit AND NOT long").groupBy("digest").agg(F.min("doc_id").alias("first"))
    return facts.join(firsts, "digest", "left").select(
        "doc_id",
        "digest",
        F.when(F.col("why").isNotNull(), F.concat(F.lit("reject_"), "why"))
        .when(F.col("first") < F.col("doc_id"), "duplicate")
        .when(F.col("hit"), "contaminated")
        .when(F.col("long"), "too_long")
        .otherwise("accepted")
        .alias("status"),
    )


def prefix_sums(df: DataFrame, order: str, value: Column, name: str) -> DataFrame:
    """Sum of value over all rows before each, by the order column (equal ones by a hash of the row).

    Rows are dealt by ranges of the order, whatever its values; sums run within a range, then over the ranges' totals, of
    which there is one for each partition."""
    b, v, tie, local, base = fresh([*df.columns, name], "range", "value", "tie", "local", "base")
    ranged = stored(df.withColumns({v: value.cast("long"), tie: F.xxhash64(*df.columns)}).repartitionByRange(order, tie).withColumn(b, F.spark_partition_id()), "ranges")
    inner = Window.partitionBy(b).orderBy(order, tie).rowsBetween(Window.unboundedPreceding, -1)
    bases, at = [], 0
    for r in ranged.groupBy(b).agg(F.sum(v).alias("t")).orderBy(b).collect():
        bases.append((r[0], at))
        at += r["t"] or 0
    totals = F.broadcast(df.sparkSession.createDataFrame(bases, f"{b} int, {base} long"))
    rows = ranged.withColumn(local, F.coalesce(F.sum(v).over(inner), F.lit(0)))
    return rows.join(totals, b).withColumn(name, F.col(base) + F.col(local)).select(*df.columns, name)


def places(df: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """Each row's place in its group from 0, by the order column (equal ones by a hash of the row). Groups are cut by
    ranges like all rows, so no group has to fit a task; the bases that come back are one for each group."""
    key, at, g, base = fresh([*df.columns, name], "key", "at", "group", "base")
    placed = stored(prefix_sums(df.withColumn(key, F.struct(group, order)), key, F.lit(1), at), "places")
    bases = placed.groupBy(F.col(group).alias(g)).agg(F.min(at).alias(base))
    return placed.join(small(bases), F.col(group).eqNullSafe(F.col(g))).select(*df.columns, (F.col(at) - F.col(base)).alias(name))


def pack_blocks(docs: DataFrame, order: str, tokens: Column, block: int = 2049) -> DataFrame:
    """ord, block_no, slot, tokens: the pieces of the concatenated stream (each document ends in an empty token), cut at
    block bounds; slot is where a piece begins in its block. The tail that does not fill a block is dropped."""
    rows = docs.select(F.col(order).alias("ord"), F.concat(tokens, F.array(F.lit(""))).alias("tokens"))
    placed = stored(prefix_sums(rows, "ord", F.size("tokens"), "start"), "placed")
    kept = (placed.agg(F.max(F.col("start") + F.size("tokens"))).first()[0] or 0) // block
    stop = F.col("start") + F.size("tokens")
    each = placed.select("ord", "start", stop.alias("stop"), "tokens", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((stop - 1) / block))).alias("block_no"))
    low, high = F.greatest(F.col("start"), F.col("block_no") * block), F.least(F.col("stop"), (F.col("block_no") + 1) * block)
    piece = F.slice("tokens", (low - F.col("start") + 1).cast("int"), (high - low).cast("int"))
    return each.where(F.col("block_no") < kept).select("ord", "block_no", (low % block).alias("slot"), piece.alias("tokens"))


def block_ranges(docs: DataFrame, order: str, n_tokens: Column, block: int = 2049, shard_blocks: int = 8) -> DataFrame:
    """ord, start, stop, first_block, last_block, first_shard of each document."""
    placed = prefix_sums(docs.withColumn("__n", n_tokens + 1), order, F.col("__n"), "start")
    stop = F.col("start") + F.col("__n")
    return placed.select(
        F.col(order).alias("ord"), "start", stop.alias("stop"), F.floor(F.col("start") / block).alias("first_block"), F.floor((stop - 1) / block).alias("last_block"), F.floor(F.col("start") / (block * shard_blocks)).alias("first_shard")
    )


def near_copies(docs: DataFrame, old: DataFrame, ids: str, doc_id: str = "doc_id", width: int = 13, keep_one_in: int = 4, least: int = 2) -> DataFrame:
    """doc_id, sampled, found: sampled spans of each document and how many the old corpus holds; near copies have at
    least `least` found and half of the sampled."""
    span = lambda df: df.select(doc_id, F.explode(hs.span_fingerprints(F.col(ids), width, keep_one_in)).alias("span"))
    known = span(old).select("span").distinct().withColumn("known", F.lit(1))
    got = span(docs).join(known, "span", "left").groupBy(doc_id).agg(F.count("*").alias("sampled"), F.count("known").alias("found"))
    return got.withColumn("near_copy", (F.col("found") >= least) & (2 * F.col("found") >= F.col("sampled")))


def near_blocks(left: DataFrame, right: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """u, block, part of the distinct 64-bit values u of left.v and w, block, part of those of right.v.

    The 64 bits are cut into radius // 3 + 1 blocks, so a pair within the radius agrees in some block but for two bits at
    most: left values ask for every neighbour of that kind of each of their blocks, right values stand under their blocks.
    Spark takes neither side for longer than the values it comes from, so a join of them says that it is none to broadcast."""
    blocks = radius // 3 + 1
    reach = radius // blocks
    edges = [64 * k // blocks for k in range(blocks + 1)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    masks = [signed(((1 << b) - 1) ^ ((1 << a) - 1)) for a, b in zip(edges, edges[1:], strict=False)]
    part = lambda m: F.col("v").bitwiseAND(F.lit(m))
    neighbour = lambda i, own: lambda x: F.struct(i.alias("block"), own.bitwiseXOR(x).alias("part"))
    asked, stands = [], []
    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        flips = [signed(sum(1 << x for x in some)) for n in range(reach + 1) for some in combinations(range(a, b), n)]
        asked.append(F.transform(F.array(*map(F.lit, flips)).cast("array<long>"), neighbour(F.lit(i), part(masks[i]))))
        stands.append(F.struct(F.lit(i).alias("block"), part(masks[i]).alias("part")))
    ask = left.select("v").distinct().select(F.col("v").alias("u"), F.explode(F.concat(*asked)).alias("k")).select("u", "k.block", "k.part")
    stand = right.select("v").distinct().select(F.col("v").alias("w"), F.explode(F.array(*stands)).alias("k")).select("w", "k.block", "k.part")
    return ask.hint("merge"), stand.hint("merge")


def near_values(left: DataFrame, right: DataFrame, radius: int) -> DataFrame:
    """u, w, d: distinct 64-bit values u of left.v and w of right.v that differ in d <= radius bits."""
    ask, stand = near_blocks(left, right, radius)
    d = F.bit_count(F.col("u").bitwiseXOR(F.col("w"))).cast("long")
    return ask.join(stand, ["block", "part"]).where(d <= radius).select("u", "w").distinct().withColumn("d", d)


def hamming_pairs(df: DataFrame, key: str, bits: str, radius: int) -> DataFrame:
    """Pairs a < b whose 64-bit values differ in at most radius bits. Equal values meet once as values, not as rows,
    before pairs of rows are made; near_values alone is enough where pairs are only counted or asked for."""
    values = df.select(F.col(bits).alias("v"))
    left = df.select(F.col(key).alias("a"), F.col(bits).alias("u"))
    right = df.select(F.col(key).alias("b"), F.col(bits).alias("w"))
    return left.join(near_values(values, values, radius), "u").join(right, "w").where("a < b").select("a", "b", "d")


def near_pair_counts(df: DataFrame, bits: str, radius: int) -> DataFrame:
    """d, pairs: how many pairs of rows differ in d bits, 0 < d <= radius; by values and their multiplicities."""
    n = df.groupBy(F.col(bits).alias("v")).agg(F.count("*").alias("n"))
    near = near_values(n, n, radius).where("u < w")
    both = near.join(n.select(F.col("v").alias("u"), F.col("n").alias("nu")), "u").join(n.select(F.col("v").alias("w"), F.col("n").alias("nw")), "w")
    return both.groupBy("d").agg(F.sum(F.col("nu") * F.col("nw")).alias("pairs"))


def far_rows(df: DataFrame, prior: DataFrame, bits: str, radius: int) -> DataFrame:
    """Rows of df that differ in more than radius bits from every row of prior."""
    ask, stand = near_blocks(df.select(F.col(bits).alias("v")), prior.select(F.col(bits).alias("v")), radius)
    on = (ask["block"] == stand["block"]) & (ask["part"] == stand["part"]) & (F.bit_count(F.col("u").bitwiseXOR(F.col("w"))) <= radius)
    near = ask.join(stand, on, "left_semi").select(F.col("u").alias(bits)).distinct()
    return df.join(near, bits, "left_anti")


def grant(df: DataFrame, order: str, tokens: str, cap: int) -> DataFrame:
    """Adds granted: requests in order, each granted if it and all granted before fit the cap; a refused one adds nothing,
    and a request without a positive amount is refused.

    Each round grants by prefix sums up to the first request that does not fit, then goes on behind it with the requests
    that fit what is left, until none does. `order` must tell all rows apart."""
    rule, left, behind = F.lit(False), cap, None
    while left > 0:
        open_rows = df.select(F.col(order).alias("o"), F.col(tokens).cast("long").alias("n")).where(F.col("n").between(1, left))
        if behind is not None:
            open_rows = open_rows.where(F.col("o") > F.lit(behind))
        sums = stored(prefix_sums(open_rows, "o", F.col("n"), "before"), "sums")
        end = sums.where(F.col("before") + F.col("n") > left).agg(F.min("o")).first()[0]
        taken = F.col(tokens).between(1, left)
        if behind is not None:
            taken = taken & (F.col(order) > F.lit(behind))
        if end is None:
            rule = rule | taken
            break
        rule = rule | (taken & (F.col(order) < F.lit(end)))
        left -= sums.where(F.col("o") < F.lit(end)).agg(F.sum("n")).first()[0] or 0
        behind = end
    return df.withColumn("granted", F.coalesce(rule, F.lit(False)))


#: Phrases of page furniture.
FURNITURE = ["cookie policy", "privacy policy", "enable javascript", "click here", "subscribe now"]


def corpus_audit(df: DataFrame, order: str, text: str, url: Column, language: Column, language_score: Column, score: Column, wanted: str = "en", floor: float = 0.9, least: int = 200, limit: int = 20_000) -> DataFrame:
    """One row of figures over the first `limit` rows, by order, that are in the wanted language with its score at the
    floor or above and have at least `least` characters. rows_scanned counts up to the last of them, all rows where fewer
    pass. A missing score is 0, a quantile is the value at that share of the sorted ones; with no row, counts are 0 and the
    rest null."""
    c = F.col(text)
    zero = lambda x: F.coalesce(x.cast("double"), F.lit(0.0))
    spoken = F.coalesce((language == wanted) & (zero(language_score) >= floor), F.lit(False))
    furniture = F.lit(False)
    for x in FURNITURE:
        furniture = furniture | F.lower(c).contains(x)
    share = lambda x: x.cast("double")
    facts = df.where(spoken & (F.length(tx.strip(c)) >= least)).select(
        F.col(order).alias("o"),
        F.length(c).alias("n"),
        F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)).alias("domain"),
        F.sha2(tx.collapse(F.lower(c)), 256).alias("h"),
        zero(language_score).alias("ls"),
        zero(score).alias("s"),
        share(c.rlike(tx.EMAIL)).alias("email"),
        share(c.rlike(tx.IPV4)).alias("ip"),
        share(furniture).alias("furniture"),
    )
    head = stored(facts.orderBy("o").limit(limit), "audit")
    docs, last = head.agg(F.count("*"), F.max("o")).first()
    scanned = df if docs < limit else df.where(F.col(order) <= F.lit(last))
    scanned = scanned.agg(F.count("*").alias("rows_scanned"), F.count_if(~spoken).alias("language_rejected"))
    top = head.groupBy("domain").count().agg(F.max("count").alias("top"))
    at = lambda name, q: F.get(F.array_sort(F.collect_list(name)), F.least(F.count("*") - 1, F.floor(F.count("*") * q)).cast("int"))
    mean = lambda name: F.round(F.avg(name), 9)
    got = head.agg(
        F.count("*").alias("docs"),
        F.countDistinct("domain").alias("domains"),
        F.percentile("n", F.lit(0.5)).alias("median_chars"),
        at("n", 0.95).cast("long").alias("p95_chars"),
        mean("ls").alias("language_score_mean"),
        F.min("ls").alias("language_score_min"),
        F.percentile("s", F.lit(0.5)).alias("score_median"),
        at("s", 0.1).alias("score_p10"),
        (F.count("*") - F.countDistinct("h")).alias("duplicates"),
        mean("email").alias("email_rate"),
        mean("ip").alias("ip_rate"),
        mean("furniture").alias("furniture_rate"),
    )
    # Each of the three has one row.
    one = F.lit(1).alias("one")
    rows = got.select("*", one).join(F.broadcast(top.select("top", one)), "one").join(F.broadcast(scanned.select("*", one)), "one")
    return rows.select(*got.columns, F.round(F.col("top") / F.when(F.col("docs") > 0, F.col("docs")), 9).alias("top_domain_share"), "rows_scanned", "language_rejected")
