"""Text, policy, hash, sampling, statistics, source and stream functions on small cases."""

import ipaddress
import re
import unicodedata
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st_
from pyspark.sql import functions as F

from siltstone.functions import hashing as hs
from siltstone.functions import text as tx
from siltstone.operators import corpus as co
from siltstone.operators import pairs as pr
from siltstone.operators import policies as po
from siltstone.operators import sampling as sa
from siltstone.operators import stats as st
from siltstone.sources import files
from siltstone.streaming import ingest


def col(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return [r["x"] for r in df.select("i", make(F.col("c")).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "text, reason",
    [
        (None, "not_text"),
        ("short", "short"),
        ("  " + "abcdefghij" * 20 + " ", None),
        ("a" * 300, "dominant_character"),
        ("ab" * 150, "dominant_character"),
        ("abc" * 100, None),
        ("abcdefghij" * 25 + "�" * 3, "replacement_characters"),
        ("same line here\n" * 30, "repeated_lines"),
        ("\x00" * 300, "short"),
    ],
)
def test_clean_reason(spark, text, reason):
    assert col(spark, [text], tx.clean_reason) == [reason]


def test_strip_is_unicode(spark):
    values = [" \x1c\x1fa b  \x85", "\t\n", "", "  x"]
    assert col(spark, values, tx.strip) == [v.strip() for v in values]
    assert col(spark, values, tx.collapse) == [" ".join(v.split()) for v in values]


def redacted(text):
    text = re.sub(r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", "<EMAIL>", text)

    def one(m):
        try:
            ipaddress.IPv4Address(m[0])
        except ValueError:
            return m[0]
        return "<IP_ADDRESS>"

    return re.sub(r"(?<!\d)(?:\d{1,3}\.){3}\d{1,3}(?!\d)", one, text)


def test_redact(spark):
    values = ["at 10.0.0.1, 999.1.2.3.4 and 1.2.3.04", "me@x.org; éa.b@c.de. 255.255.255.255", "1.2.3.4.5.6.7.8", "", "no"]
    assert col(spark, values, tx.redact) == [redacted(v) for v in values]


def test_nfkc(spark):
    values = ["ﬁ ½ ①", "Å̊", None]
    assert col(spark, values, tx.nfkc) == [None if v is None else unicodedata.normalize("NFKC", v) for v in values]


@pytest.mark.parametrize(
    "host, allowed",
    [("libretexts.org", True), ("a.libretexts.org", True), ("evil-libretexts.org", False), ("libretexts.org.evil.com", False), ("cs.mit.edu", True), ("", False)],
)
def test_host_allowed(spark, host, allowed):
    assert col(spark, [host], lambda c: tx.host_allowed(c, po.MATH_HOSTS, po.MATH_SUFFIXES)) == [allowed]


WORDS = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i % 7)}" for i in range(200))


@pytest.mark.parametrize(
    "source, identifier, text, tokens, reason",
    [
        ("math", "https://evil.com/x", WORDS, 200, "math_provenance_not_allowlisted"),
        ("math", "https://mathoverflow.net./q", WORDS, 200, None),
        ("code", "x", "a", 1, None),
        ("web", "x", WORDS, 100, "short_or_low_prose"),
        ("web", "x", WORDS + " please write my essay", 200, "essay_homework_commercial"),
        ("dclm", "x", WORDS + " (PRNewswire)", 200, "press_release_wire"),
        ("web", "x", WORDS + " (PRNewswire)", 200, None),
        ("web", "x", (WORDS[:80] + ". ") * 30, 300, "repeated_prose"),
        ("narrative", "x", (WORDS[:80] + ". ") * 30, 300, None),
        ("web", "x", WORDS + "�" * 20, 200, "replacement_character_noise"),
    ],
)
def test_base_policy(spark, source, identifier, text, tokens, reason):
    df = spark.createDataFrame([(source, identifier, text, tokens)], "s string, i string, t string, n int")
    assert df.select(po.base_reason(F.col("s"), F.col("i"), F.col("t"), F.col("n")).alias("x")).first()["x"] == reason


def test_code_gate_fails_closed(spark):
    rows = [("Java", "permissive", 2), ("Python", "permissive", 2), ("Python", "permissive", 3), ("Python", None, 5), ("Python", "permissive", None)]
    df = spark.createDataFrame(rows, "l string, t string, s int")
    assert [r["x"] for r in df.select(po.code_gate(F.col("l"), F.col("t"), F.col("s")).alias("x")).collect()] == [True, False, True, False, False]


def slow_spans(ids, width):
    m, out = (1 << 64) - 1, set()
    for i in range(len(ids) - width + 1):
        h = 0
        for x in ids[i : i + width]:
            h = (h * 1_000_003 + x + 1) & m
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & m
        h = (h ^ h >> 27) * 0x94D049BB133111EB & m
        out.add(h ^ h >> 31)
    return out


@settings(max_examples=50, deadline=None)
@given(st_.lists(st_.integers(0, 65535), max_size=60))
def test_span_hashes(ids):
    got = hs.span_hashes(np.array(ids, dtype=np.uint64), 13)
    assert set(map(int, got)) == slow_spans(ids, 13)
    assert set(map(int, hs.span_hashes(np.array([7, *ids], dtype=np.uint64), 13))) >= set(map(int, got))


def test_bucket_and_holdout(spark):
    digests = [sha256(str(i).encode()).hexdigest() for i in range(300)]
    assert col(spark, digests, lambda c: hs.hash_bucket(c, 7)) == [int(d, 16) % 7 for d in digests]
    assert col(spark, digests, lambda c: hs.holdout(c, 10)) == [int(d[:16], 16) % 10 == 0 for d in digests]


def test_phrases_stop_at_twelve_words(spark):
    twelve, thirteen = " ".join("abcdefghijkl"), " ".join("nopqrstuvwxyz")
    docs = spark.createDataFrame([(1, f"x {twelve} y"), (2, f"x {thirteen} y"), (3, "four words are few")], "doc_id long, text string")
    questions = spark.createDataFrame([(twelve,), (thirteen,), ("four words are few",)], "text string")
    assert [r["doc_id"] for r in co.phrase_ids(docs, questions).collect()] == [1]


def test_contaminated_copy_is_not_a_duplicate(spark):
    marker = " ".join(f"mark{i}" for i in range(13))
    body = " ".join(f"text{i}" for i in range(60))
    docs = spark.createDataFrame([(0, f"{body} {marker}"), (1, f"{body} {marker}"), (2, body), (3, body)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, marker)], "item_id long, text string")
    got = {r["doc_id"]: r["status"] for r in co.funnel_status(docs, bench).collect()}
    assert got == {0: "contaminated", 1: "contaminated", 2: "accepted", 3: "duplicate"}


def test_full_width_and_ligature_copies_are_duplicates(spark):
    """Digests are of NFKC text: copies that only differ in compatibility characters are found."""
    body = " ".join(f"office{i} first" for i in range(60))
    wide = body.replace("first", "\uff46\uff49rst")
    docs = spark.createDataFrame([(0, body.replace("ffi", "\ufb03").replace("first", "\ufb01rst")), (1, body), (2, wide.upper()), (3, body + " other")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "nothing")], "item_id long, text string")
    got = {r["doc_id"]: r["status"] for r in co.funnel_status(docs, bench).collect()}
    assert got == {0: "accepted", 1: "duplicate", 2: "duplicate", 3: "accepted"}


@pytest.mark.parametrize("ord_sql", ["id * 3", "id * 1000003 % 7919 - 4000", "id % 7", "CAST(NULL AS LONG)"])
def test_prefix_sums(spark, ord_sql):
    """Dense, sparse, tied and null orders; every row once, sums before it of the rows that sort before."""
    df = spark.range(1000).selectExpr(f"{ord_sql} AS ord", "id % 5 AS v", "id", "id AS range")
    got = co.prefix_sums(df, "ord", F.col("v"), "s").collect()
    rows = sorted(((r["ord"] if r["ord"] is not None else 0, r["s"], r["v"]) for r in got), key=lambda r: (r[0], r[1], r[2] > 0, r[2]))
    at = 0
    for _, s, v in rows:
        assert s == at
        at += v
    assert sorted(r["id"] for r in got) == list(range(1000)) and got[0].asDict().keys() == {"ord", "v", "id", "range", "s"}


def test_pack_blocks_cuts_pieces(spark):
    docs = [(i * 37 % 101, [f"t{i}_{k}" for k in range(i % 9 * 7)]) for i in range(101)]
    df = spark.createDataFrame(docs, "o long, w array<string>")
    stream = [x for _, w in sorted(docs) for x in [*w, ""]]
    got = {}
    for r in co.pack_blocks(df, "o", F.col("w"), 50).collect():
        for k, x in enumerate(r["tokens"]):
            got[r["block_no"] * 50 + r["slot"] + k] = x
    assert [got[k] for k in range(len(got))] == stream[: len(stream) // 50 * 50] and len(got) == len(stream) // 50 * 50


def test_grant_is_sequential(spark):
    import random

    rng = random.Random(3)
    for cap in (1, 50, 400, 100_000):
        rows = [(k, rng.choice([1, 2, 3, 5, 40, 90, 300, 0, -4])) for k in range(200)]
        df = spark.createDataFrame(rows, "k long, n long").repartition(5)
        spent, want = 0, set()
        for k, n in rows:
            if n > 0 and spent + n <= cap:
                spent += n
                want.add(k)
        assert {r["k"] for r in co.grant(df, "k", "n", cap).where("granted").collect()} == want


@pytest.mark.parametrize("radius", [0, 2, 3, 7, 12, 14])
def test_near_values_against_all_pairs(spark, radius):
    import random

    rng = random.Random(radius)
    base = [rng.getrandbits(64) for _ in range(12)]
    values = base + [x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 16))) for x in base for _ in range(8)]
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(k, sign(v)) for k, v in enumerate(values)] + [(900, sign(values[0]))], "k long, v long")
    rows = [*enumerate(values), (900, values[0])]
    want = {(a, b): (x ^ y).bit_count() for a, x in rows for b, y in rows if a < b and (x ^ y).bit_count() <= radius}
    assert {(r["a"], r["b"]): r["d"] for r in co.hamming_pairs(df, "k", "v", radius).collect()} == want
    counts = {}
    for d in want.values():
        counts[d] = counts.get(d, 0) + 1
    assert {r["d"]: r["pairs"] for r in co.near_pair_counts(df, "v", radius).collect()} == {d: n for d, n in counts.items() if d}
    far = co.far_rows(df.where("k >= 50"), df.where("k < 50"), "v", radius).collect()
    assert {r["k"] for r in far} == {a for a, x in rows if a >= 50 and all((x ^ y).bit_count() > radius for b, y in rows if b < 50)}


def test_folds_are_balanced():
    slots = sa.fold_slots([("a", 17), ("b", 8), ("c", 3)], 5, 7)
    sizes = [sum(high - low + 1 for _, f, low, high in slots if f == k) for k in range(5)]
    assert sum(sizes) == 28 and max(sizes) - min(sizes) <= 1
    for name, n in (("a", 17), ("b", 8), ("c", 3)):
        own = sorted((low, high) for s, _, low, high in slots if s == name)
        assert [x for low, high in own for x in range(low, high + 1)] == list(range(1, n + 1))
        each = [sum(high - low + 1 for s, f, low, high in slots if s == name and f == k) for k in range(5)]
        assert max(each) - min(each) <= 1
    assert len(sa.fold_slots([("a", 10**15)], 5, 7)) == 5


def test_quotas_sum(spark):
    w = spark.createDataFrame([("a", 0.425), ("b", 0.425), ("c", 0.03), ("d", 0.12)], "k string, w double")
    got = {r["k"]: r["quota"] for r in sa.quotas(w, "k", "w", 96_901).collect()}
    assert sum(got.values()) == 96_901 and all(abs(got[k] - w_ * 96_901) < 1 for k, w_ in (("a", 0.425), ("b", 0.425), ("c", 0.03), ("d", 0.12)))


def test_greedy_match(spark):
    df = spark.createDataFrame([("g", i) for i in range(6)], "g string, a long")
    got = [(r["a"], r["b"]) for r in sa.greedy_match(df, df.withColumnRenamed("a", "b"), "g", "a", "b", 4).orderBy("a").collect()]
    free, want = list(range(6)), []
    for a in range(4):
        b = min(free, key=lambda v: sha256(f"{a}|{v}".encode()).hexdigest())
        free.remove(b)
        want.append((a, b))
    assert got == want


def test_alignment_is_strict(spark):
    schema = "k int, h string, value int"
    a = spark.createDataFrame([(1, "x", 1), (2, "y", 0)], schema)
    assert st.align(a, a.orderBy(F.desc("k")), ["k"], ["h"]).count() == 2
    for bad in ([(1, "x", 1)], [(1, "x", 1), (2, "z", 0)], [(1, "x", 1), (2, "y", 0), (2, "y", 1)]):
        with pytest.raises(ValueError):
            st.align(a, spark.createDataFrame(bad, schema), ["k"], ["h"])


def test_bootstrap_of_equal_models(spark):
    df = spark.createDataFrame([("t", 1, 1)] * 50, "t string, a int, b int")
    r = st.paired_bootstrap(df, "t", "a", "b", draws=100).first()
    assert (r["mean"], r["low"], r["high"], r["n"]) == (0.0, 0.0, 0.0, 50)


def test_bootstrap_covers_the_mean(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(int(c), float(rng.normal(c % 3, 1))) for c in range(30) for _ in range(5)], "c int, v double")
    r = st.cluster_bootstrap(df, "c", "v").first()
    assert r["clusters"] == 30 and r["low"] < r["mean"] < r["high"]


def test_auroc_and_frontier(spark):
    df = spark.createDataFrame([("t", 1, False), ("t", 2, True), ("t", 2, False), ("t", 3, True)], "t string, s int, p boolean")
    assert st.auroc(df, "s", "p", ["t"]).first()["auroc"] == pytest.approx(3.5 / 4)
    pts = spark.createDataFrame([(1, 1.0, 1.0), (2, 1.0, 2.0), (3, 2.0, 2.0), (4, 3.0, 5.0), (5, 3.0, 5.0)], "k int, c double, s double")
    assert sorted(r["k"] for r in st.frontier(pts, "k", "c", "s").collect()) == [2, 4, 5]


def test_row_resume(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(1000).coalesce(1).write.option("parquet.block.size", 1024).parquet(path)
    assert sorted(r["id"] for r in files.rows_after(spark, path, 637).collect()) == list(range(637, 1000))
    groups = files.row_groups(spark, path).collect()
    assert sum(r["rows"] for r in groups) == 1000
    if len(groups) > 1:
        assert files.rows_after(spark, path, 637).rdd.getNumPartitions() == sum(r["first"] + r["rows"] > 637 for r in groups)
    assert files.rows_after(spark, path, 1000).count() == 0


def test_row_groups_before_the_cursor_are_not_read(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    (tmp_path / "p").mkdir()
    for k in range(2):
        pq.write_table(pa.table({"a": [None if i % 7 == 0 else f"x{i}" for i in range(1000)], "i": range(1000)}), tmp_path / "p" / f"{k}.parquet", row_group_size=100)
    got = files.rows_after(spark, str(tmp_path / "p"), 637)
    assert got.rdd.getNumPartitions() == 8
    want = [(None if i % 7 == 0 else f"x{i}", i, i) for i in range(637, 1000)] * 2
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == sorted(want, key=lambda r: r[1])


def test_admission(spark):
    schema = "name string, length long, sha256 string"
    have = spark.createDataFrame([("a", 3, "x"), ("b", 2, "x"), ("c", 4, "x"), ("d", 3, "y"), ("f", 1, "z")], schema)
    want = spark.createDataFrame([(n, 3, "x") for n in "abcde"], schema)
    got = {r["name"]: r["status"] for r in files.admission(have, want).collect()}
    assert got == {"a": "complete", "b": "partial", "c": "wrong_size", "d": "wrong_digest", "e": "missing"}


def test_stop_between_batches(spark, tmp_path):
    path, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    spark.range(60).repartition(6).write.parquet(path)
    source = ingest.stream_files(spark, path, spark.range(1).schema)
    assert ingest.ingest_some(source, out, mark, 2) >= 2
    ingest.ingest(source, out, mark)
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == list(range(60))
    assert ingest.ingest_some(source, out, mark, 2) == 0


def test_places_and_turns(spark):
    rows = [(s, i % 5) for i in range(40) for s in ("a", "b", None)] + [("c", 1)]
    df = spark.createDataFrame(rows, "s string, o int")
    got = co.places(df, "s", "o", "place").collect()
    for s in ("a", "b", "c", None):
        own = sorted((r["place"], r["o"]) for r in got if r["s"] == s)
        assert [p for p, _ in own] == list(range(len(own))) and [o for _, o in own] == sorted(o for _, o in own)
    turns = sorted((r["pos"], r["s"]) for r in sa.take_turns(df.where("s IS NOT NULL"), "s", "o", 16, "pos").collect())
    assert [s for _, s in turns] == ["a"] * 16 + ["b"] * 16 + ["c"] + (["a"] * 16 + ["b"] * 16) + ["a"] * 8 + ["b"] * 8
    assert [p for p, _ in turns] == list(range(81))
    assert co.places(df.limit(0), "s", "o", "place").count() == 0


def test_audit_of_no_rows_and_of_the_first_ones(spark):
    df = spark.createDataFrame([(i, ("word " * 50 + str(i // 2)) if i != 3 else None, "en" if i != 5 else None) for i in range(9)], "i long, text string, lang string")
    run = lambda d, **k: co.corpus_audit(d, "i", "text", F.lit("http://X.org/a"), F.col("lang"), F.lit(0.95), F.lit(None), **k).first()
    got = run(df, limit=4)
    assert (got["docs"], got["rows_scanned"], got["language_rejected"], got["duplicates"], got["domains"], got["top_domain_share"]) == (4, 5, 0, 1, 1, 1.0)
    got = run(df)
    assert (got["docs"], got["rows_scanned"], got["language_rejected"], got["score_median"]) == (7, 9, 1, 0.0)
    none = run(df.where("i < 0"))
    assert (none["docs"], none["rows_scanned"], none["p95_chars"], none["top_domain_share"]) == (0, 0, None, None)


def test_crops_actions_and_gradient_bits(spark):
    df = spark.createDataFrame([(0,), (5,), (15,), (16,), (None,)], "p int")
    got = [r["b"] and tuple(round(x, 6) for x in r["b"]) for r in df.select(pr.crop_box(F.col("p"), 4, 0.5).alias("b")).collect()]
    assert got == [(0.0, 0.0, 0.375, 0.375), (0.125, 0.125, 0.625, 0.625), (0.625, 0.625, 1.0, 1.0), None, None]
    rows = [([5.0, 1.0, 0.0], 1.0), ([5.0, 1.0, 0.0], 0.1), ([1.0, 1.0, 1.0], 1.0), ([0.0, 0.0, 9.0], 1.0), ([0.0, 9.0, 0.0], None)]
    acts = spark.createDataFrame(rows, "l array<double>, g double").select(pr.evidence_action(F.col("l"), F.col("g"), 0.5, 0.6).alias("a")).collect()
    assert [r["a"] for r in acts] == [0, 2, 2, 2, 2]
    grey = spark.createDataFrame([([9 - i for i in range(9)] * 8,), (list(range(9)) * 8,)], "px array<int>")
    assert [r["h"] for r in grey.select(pr.difference_hash(F.col("px")).alias("h")).collect()] == [-1, 0]


def test_model_files(spark):
    names = {"a": ["x.safetensors", "pytorch_model.bin", "config.json", "sub/y.safetensors", "notes"], "b": ["pytorch_model-1-of-2.bin", "merges.txt"], "c": ["config.json"]}
    df = spark.createDataFrame([(r, n) for r, ns in names.items() for n in ns], "repo string, name string")
    got = sorted(map(tuple, files.model_files(df, "repo", "name").collect()))
    assert got == [("a", "config.json"), ("a", "x.safetensors"), ("b", "merges.txt"), ("b", "pytorch_model-1-of-2.bin")]


def test_csv_map_rejects_repeats(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text("a,b\n1,x\n1,y\n")
    with pytest.raises(ValueError):
        files.read_csv_map(spark, str(path), "a", "b")
    with pytest.raises(ValueError):
        files.read_csv_map(spark, str(path), "a", "missing")


def test_blobs_and_archives(spark, tmp_path):
    import gzip
    import io
    import tarfile

    rows = [(1, gzip.compress("é".encode("latin-1")), "latin-1"), (2, gzip.compress(b"a\xff"), "utf-8"), (3, b"broken", "utf-8"), (4, None, None), (5, gzip.compress(b"x"), "nope")]
    df = spark.createDataFrame([(i, None if b is None else bytearray(b), c) for i, b, c in rows], "i int, b binary, c string")
    assert {r["i"]: r["text"] for r in files.fetch_blobs(df, "b", "c", ["i"]).collect()} == {1: "é", 2: "a", 5: "x"}
    with tarfile.open(tmp_path / "a.tar", "w") as tar:
        info = tarfile.TarInfo("d/x.txt")
        info.size = 3
        tar.addfile(info, io.BytesIO(b"abc"))
    got = files.tar_members(spark.read.format("binaryFile").load(str(tmp_path / "a.tar"))).first()
    assert (got["member"], got["length"], got["sha256"]) == ("d/x.txt", 3, sha256(b"abc").hexdigest())


def test_receipt_and_unchanged(spark, tmp_path):
    path = tmp_path / "r.json"
    files.write_receipt(spark, str(path), {"rows": 3})
    files.write_receipt(spark, str(path), {"rows": 4})
    assert path.read_text() == '{"rows": 4}' and not (tmp_path / "r.json.part").exists()
    with pytest.raises(ValueError):
        files.assert_unchanged(spark.range(3).toDF("a"), spark.range(4).toDF("a"))


def test_stream_dedup_across_restarts(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    rows = lambda *x: spark.createDataFrame(list(x), "doc_id long, text string").coalesce(1).write.mode("append").parquet(src)
    rows((1, "a  b"), (2, "A b"))
    schema = spark.read.parquet(src).schema
    ingest.ingest_distinct(ingest.stream_files(spark, src, schema), out, mark)
    rows((3, "a b"), (4, "c"))
    ingest.ingest_distinct(ingest.stream_files(spark, src, schema), out, mark)
    assert sorted(r["doc_id"] for r in spark.read.parquet(out).collect()) == [1, 4]


def test_shared_spans(spark):
    """Against all spans: shared at the ends, one word short, in another order, on one side only, texts too short or missing."""
    rng = np.random.default_rng(5)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    a, b, rep = word(32), word(31), ["x"] * 50
    texts = [word(9) + a + word(3), a, word(40) + a, word(5) + b + word(5), b + word(30), a[::-1], rep, rep[:31], rep[:33], word(200), [], a[:31]]
    rows = [(k, k % 3 == 0, None if k == 10 else ", ".join(x).upper()) for k, x in enumerate(texts)]
    grams = {k: {tuple(x[i : i + 32]) for i in range(len(x) - 31)} for k, x in enumerate(texts)}
    want = {k for k, old, _ in rows if any(grams[k] & grams[j] for j, other, _ in rows if other != old)}
    got = [r[0] for r in co.shared_spans(spark.createDataFrame(rows, "doc_id long, old boolean, text string"), "old").collect()]
    assert sorted(got) == sorted(want) and {0, 1, 2, 6, 8} == want


def test_older_digests_come_from_few_folders(spark, tmp_path, monkeypatch):
    """First rows over many batches and a restart, with merged digests; a batch reads few folders; repeating one is harmless."""
    monkeypatch.setattr(ingest, "MERGE", 3)
    src, out, mark, schema = (*(str(tmp_path / x) for x in ("in", "out", "mark")), "doc_id long, text string")
    texts = [f"t{i * i % 7}" for i in range(23)]

    def run(ids):
        for i in ids:
            spark.createDataFrame([(i, texts[i])], schema).coalesce(1).write.mode("append").parquet(src)
        return ingest.ingest_distinct(ingest.stream_files(spark, src, spark.createDataFrame([], schema).schema), out, mark)

    first, second = run(range(12)), run(range(12, 23))
    assert [p["seen"] for p in first + second] == [1] * 23
    assert sum(p["accepted"] for p in first + second) == len(set(texts))
    assert sorted(r["text"] for r in spark.read.parquet(out).collect()) == sorted(set(texts))
    old = ingest._older(spark, out, 22)
    assert len(old.inputFiles()) <= 2 * 3 and {r["digest"] for r in old.collect()} == {sha256(x.encode()).hexdigest() for x in texts[:22]}


def test_bpe_encode(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from siltstone.functions.tokens import bpe_encode

    path = public_tokenizers.path("byte_bpe_50k.json")
    model, values = Tokenizer.from_file(path), ["Hello, wörld", "", None, "a\nb  c"]
    want = [None if v is None else model.encode(v, add_special_tokens=False).ids + [0] for v in values]
    assert col(spark, values, lambda c: bpe_encode(c, path)) == want


def test_bpe_encode_by_slices(spark):
    """Ids do not depend on the slices, no slice holds more than its bound, and a filter on the ids does not encode twice."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from siltstone.functions.tokens import bpe_encode, text_slices

    texts = ["x" * 5, None, "", "y" * 12, "z", "é" * 9]
    assert list(text_slices(texts, 10)) == [texts[:3], texts[3:4], texts[4:]]
    assert list(text_slices([], 10)) == []
    path = public_tokenizers.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    values = [f"word{i} of " * (20_000 if i % 3 else 1) for i in range(7)] + [None, ""]
    df = spark.createDataFrame([(v,) for v in values], "v string").coalesce(1).select(bpe_encode(F.col("v"), path).alias("ids")).where(F.size("ids") >= 1)
    assert df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    want = [model.encode(v, add_special_tokens=False).ids + [0] for v in values if v is not None]
    assert sorted(r["ids"] for r in df.collect()) == sorted(want)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_kept_words_change_no_ids(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    from siltstone.functions.tokens import Words

    path = public_tokenizers.path(name)
    model, words = Tokenizer.from_file(path), Words(path)
    added = [t.content for t in model.get_added_tokens_decoder().values()][:3]
    space = "a  b\u00a0 c \u3000d\x1c e\x85 f\t g \n h  "
    texts = ["", " ", " x", "x ", "it's we'll  don 't", space, "1 2 33,4 ... !? é ñ\u0301 \u6f22\u5b57 \U0001f600 x", *(f"a {t} b{t}c" for t in added)]
    texts += ["".join(np.random.default_rng(k).choice(list(" \n\ta'b1.é\x1c\u00a0s"), 60)) for k in range(200)]
    for _ in range(2):
        assert [x.tolist() for x in words.encode(texts)] == [model.encode(x, add_special_tokens=False).ids for x in texts]


def test_near_values_broadcast_no_expanded_side(spark):
    """A value stands for some hundred keys, which Spark's estimate does not see."""
    df = spark.range(40).select(F.col("id").alias("k"), F.xxhash64("id").alias("v"))
    for found in (co.near_values(df, df, 14), co.far_rows(df.where("k >= 9"), df.where("k < 9"), "v", 14)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        join = next(x for x in plan.splitlines() if "Join" in x and "part#" in x)
        assert "SortMergeJoin" in join, plan


def test_least_of_pool(spark, monkeypatch):
    """Against all pairs: groups of unequal size, more rows than a piece holds, a key in two groups, null keys and groups."""
    from hashlib import sha256

    monkeypatch.setattr(sa, "POOL_KEYS", 7)
    monkeypatch.setattr(sa, "POOL_ROWS", 11)
    left = [(i, "a" if i % 10 else "b") for i in range(60)] + [(5, "b"), (None, "a"), (61, None), (62, "none")]
    right = [(i, "a" if i % 4 else "b") for i in range(90)] + [(91, None)]
    rows = spark.createDataFrame(left, "c long, g string")
    pool = spark.createDataFrame(right, "s int, h string")
    want: dict = {}
    for c, g in left:
        for s, h in right:
            if g is not None and g == h:
                text = "|".join(["s1", *(str(x) for x in (c, s) if x is not None)])
                want[c] = min(want.get(c, ("z", 0)), (sha256(text.encode()).hexdigest(), s))
    got = sa.least_of_pool(rows, pool, "c", "g", "s", "h", "s1")
    assert got.schema.simpleString() == "struct<c:bigint,s:int>"
    assert {r["c"]: r["s"] for r in got.collect()} == {c: s for c, (_, s) in want.items()}
    assert sa.least_of_pool(rows.limit(0), pool, "c", "g", "s", "h", "s1").count() == 0


def test_string_leaves_of_any_schema(spark):
    df = spark.sql("SELECT named_struct('a', 'x', 'n', 1, 'l', array(named_struct('b', 'y', 'm', map('k', array('z', NULL)))), 'e', CAST(NULL AS STRING)) AS v UNION ALL SELECT NULL")
    got = [r[0] for r in df.select(pr.string_leaves(F.col("v"), df.schema["v"].dataType).alias("s")).collect()]
    assert sorted(got, key=len) == [[], ["x", "y", "z"]]


def test_deranged_donors(spark):
    rows = [("a", i, i // 3, i) for i in range(9)] + [("b", i, i, i // 2) for i in range(5)] + [(None, i, i, i) for i in range(2)]
    df = spark.createDataFrame(rows, "s string, i long, cluster long, image long")
    got = {(r["s"], r["i"]): r["donor"] for r in pr.deranged_donors(df, ["s"], "i", "cluster", "image").collect()}
    assert got == {("a", i): (i + 3) % 9 for i in range(9)} | {("b", i): (i + 2) % 5 for i in range(5)} | {(None, i): 1 - i for i in range(2)}
    with pytest.raises(ValueError):
        pr.deranged_donors(spark.createDataFrame([("a", 0, 1, 0), ("a", 1, 1, 1)], df.schema), ["s"], "i", "cluster", "image")


def test_metadata_reasons_in_order(spark):
    rows = [
        ("validation", "l", "a", "u", "0", "t", "wrong_subset"), (None, "l", "a", "u", "0", "t", "wrong_subset"), ("train", "m", "a", "u", "0", "t", "license_rejection"),
        ("train", "l", None, "u", "x", "t", "missing_attribution"), ("train", "l", "a", "", "0", "t", "missing_attribution"), ("train", "l", "a", "u", "x", "t", "invalid_rotation"),
        ("train", "l", "a", "u", "-90.0", "t", "nonzero_rotation"), ("train", "l", "a", "u", None, "My DOLLS", "secondary_media_title"), ("train", "l", "a", "u", "0.0", "dollshouse", "pass"), ("train", "l", "a", "u", "", None, "pass"),
    ]
    df = spark.createDataFrame(rows, "s string, l string, a string, u string, r string, t string, want string")
    c = [F.col(x) for x in "slaurt"]
    assert all(r["got"] == r["want"] for r in df.select("want", pr.metadata_reason(*c, "train", "l").alias("got")).collect())


def test_evidence_tier_at_other_letters(spark, duck):
    """Words beside letters that are not ASCII: the query must agree with its SQL."""
    from siltstone.plans.registry import ORACLES
    from siltstone.plans.quality import f16

    texts = ["éle x", "laé", "ofñ the", "DER_", "le", "of", "élan of", "", None, "x-la.", "o\u0301f of9 lé of"]
    rows = [(i, 0, "user", x) for i, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    con = duck.cursor()
    con.execute("CREATE TEMP TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    want = {r[0]: r[1:] for r in con.execute(ORACLES["f16_evidence_tier"]).fetchall()}
    assert {r["conv_id"]: (r["passed"], r["tier"]) for r in f16(lambda name: df, spark).collect()} == want
