"""Corpus build: projections, joins, dedup, holdouts and packing over documents and benchmark."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import hashing as hs
from siltstone.functions import text as tx
from siltstone.functions.tokens import bpe_encode
from siltstone.operators import corpus as co
from siltstone.plans.base import query

CLEAN = r"""
cleaned AS (SELECT doc_id, text, regexp_replace(replace(text, chr(0), ''), '^\s+|\s+$', '', 'g') AS t FROM documents),
feats AS (SELECT doc_id, text, t, left(regexp_replace(t, '\s+', '', 'g'), 100000) AS s,
    list_filter(list_transform(string_split_regex(t, '\r\n|\n|\r'), lambda x: trim(x)), lambda x: x <> '') AS ls FROM cleaned),
judged AS (SELECT doc_id, t, CASE WHEN text IS NULL THEN 'not_text' WHEN length(t) < 200 THEN 'short'
    WHEN length(t) - length(replace(t, chr(65533), '')) > greatest(2, length(t) // 10000) THEN 'replacement_characters'
    WHEN s = '' THEN 'empty'
    WHEN list_max(list_transform(list_distinct(string_split(s, '')), lambda x: length(s) - length(replace(s, x, '')))) > 0.45 * length(s) THEN 'dominant_character'
    WHEN len(ls) >= 20 AND len(list_distinct(ls)) < 0.2 * len(ls) THEN 'repeated_lines' END AS why FROM feats)
"""
WORDS = "regexp_extract_all(lower({0}), '[a-z0-9]+')"
GRAMS = "list_transform(range(1, len(w) - {0} + 2), lambda i: array_to_string(w[i:i + {0} - 1], ' '))"
DIGEST = r"sha256(trim(regexp_replace(lower({0}), '\s+', ' ', 'g')))"

FUNNEL = f"""WITH {CLEAN},
bench AS (SELECT DISTINCT unnest({GRAMS.format(13)}) AS gram FROM (SELECT {WORDS.format("text")} AS w FROM benchmark)),
grams AS (SELECT doc_id, unnest({GRAMS.format(13)}) AS gram FROM (SELECT doc_id, {WORDS.format("t")} AS w FROM judged WHERE why IS NULL)),
hit AS (SELECT DISTINCT doc_id FROM grams SEMI JOIN bench USING (gram)),
facts AS (SELECT doc_id, {DIGEST.format("t")} AS digest, doc_id IN (SELECT doc_id FROM hit) AS hit FROM judged WHERE why IS NULL),
status AS (SELECT doc_id, CASE WHEN min(CASE WHEN NOT hit THEN doc_id END) OVER (PARTITION BY digest) < doc_id THEN 'duplicate'
    WHEN hit THEN 'contaminated' ELSE 'accepted' END AS status FROM facts
    UNION ALL SELECT doc_id, 'reject_' || why FROM judged WHERE why IS NOT NULL)
"""


@query("funnel", FUNNEL + "SELECT status, count(*) AS docs FROM status GROUP BY status")
def funnel(t, spark):
    """A1: the corpus build's status counts."""
    return co.funnel_status(t("documents"), t("benchmark")).groupBy("status").agg(F.count("*").alias("docs"))


@query("w1_funnel_status", FUNNEL + "SELECT doc_id, status FROM status")
def w1(t, spark):
    return co.funnel_status(t("documents"), t("benchmark")).select("doc_id", "status")


@query("p1_clean_text", f"WITH {CLEAN} SELECT doc_id, why, CASE WHEN why IS NULL THEN sha256(t) END AS clean_sha256 FROM judged")
def p1(t, spark):
    why = tx.clean_reason(F.col("text"))
    return t("documents").select("doc_id", why.alias("why"), F.when(why.isNull(), F.sha2(tx.stripped_text(F.col("text")), 256)).alias("clean_sha256"))


@query("p2_redact_email", r"SELECT doc_id, sha256(regexp_replace(text, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b', '<EMAIL>', 'g')) AS redacted_sha256 FROM documents")
def p2_email(t, spark):
    return t("documents").select("doc_id", F.sha2(tx.redact_email(F.col("text")), 256).alias("redacted_sha256"))


ADDRESS = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"


@query("p2_redact", rf"""WITH e AS (SELECT doc_id, regexp_replace(text, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{{2,}}\b', '<EMAIL>', 'g') AS t FROM documents),
u AS (SELECT doc_id, regexp_extract_all(t, '[0-9.]+|[^0-9.]+') AS runs FROM e), v AS (SELECT doc_id, list_transform(runs, lambda r: [string_split_regex(r, '{ADDRESS}'), regexp_extract_all(r, '{ADDRESS}')]) AS cut FROM u)
SELECT doc_id, sha256(array_to_string(list_transform(cut, lambda c: array_to_string(list_transform(c[1], lambda p, i: p || coalesce(CASE WHEN regexp_matches(c[2][i], '{tx.OCTETS}') THEN '<IP_ADDRESS>' ELSE c[2][i] END, '')), '')), '')) AS redacted_sha256 FROM v""")
def p2(t, spark):
    """E-mail addresses and valid IPv4 addresses."""
    return t("documents").select("doc_id", F.sha2(tx.redact(F.col("text")), 256).alias("redacted_sha256"))


@query("p3_normalized_text", r"SELECT doc_id, length(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS n_chars_norm FROM documents")
def p3(t, spark):
    return t("documents").select("doc_id", F.length(tx.normalized(F.col("text"))).cast("long").alias("n_chars_norm"))


@query("p4_doc_digest", f"SELECT doc_id, {DIGEST.format('text')} AS digest FROM documents")
def p4(t, spark):
    return t("documents").select("doc_id", hs.text_digest(tx.normalized(F.col("text"))).alias("digest"))


@query("p5_word_tokens", f"SELECT doc_id, len(w) AS n_words, len(list_distinct(w)) AS n_distinct, sha256(array_to_string(w, ' ')) AS words_sha256 FROM (SELECT doc_id, {WORDS.format('text')} AS w FROM documents)")
def p5(t, spark):
    w = F.col("w")
    rows = t("documents").select("doc_id", tx.word_tokens(F.col("text")).alias("w"))
    return rows.select("doc_id", F.size(w).cast("long").alias("n_words"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"), F.sha2(F.array_join(w, " "), 256).alias("words_sha256"))


@query("p6_shingles", f"WITH g AS (SELECT doc_id, {GRAMS.format(13)} AS g FROM (SELECT doc_id, {WORDS.format('text')} AS w FROM documents)) SELECT doc_id, len(g) AS n_grams, len(list_distinct(g)) AS n_distinct FROM g")
def p6(t, spark):
    rows = t("documents").select("doc_id", tx.shingles(tx.word_tokens(F.col("text")), 13).alias("g"))
    return rows.select("doc_id", F.size("g").cast("long").alias("n_grams"), F.size(F.array_distinct("g")).cast("long").alias("n_distinct"))


@query("a3_benchmark_ngrams", f"SELECT count(*) AS windows, count(DISTINCT gram) AS distinct_grams, count(DISTINCT item_id) AS items FROM (SELECT item_id, unnest({GRAMS.format(13)}) AS gram FROM (SELECT item_id, {WORDS.format('text')} AS w FROM benchmark))")
def a3(t, spark):
    rows = t("benchmark").select("item_id", F.explode(tx.shingles(tx.word_tokens(F.col("text")), 13)).alias("gram"))
    return rows.agg(F.count("*").alias("windows"), F.countDistinct("gram").alias("distinct_grams"), F.countDistinct("item_id").alias("items"))


@query("p7_j1_contamination", f"""WITH b AS (SELECT DISTINCT unnest({GRAMS.format(13)}) AS gram FROM (SELECT {WORDS.format("text")} AS w FROM benchmark)),
g AS (SELECT doc_id, unnest({GRAMS.format(13)}) AS gram FROM (SELECT doc_id, {WORDS.format("text")} AS w FROM documents))
SELECT DISTINCT doc_id FROM g SEMI JOIN b USING (gram)""")
def j1(t, spark):
    return co.contaminated_ids(t("documents"), t("benchmark"))


QUESTIONS = "SELECT item_id, array_to_string(w[1:5 + item_id % 8], ' ') AS text FROM (SELECT item_id, {0} AS w FROM benchmark)".format(WORDS.format("text"))


@query("j2_short_questions", f"""WITH q AS ({QUESTIONS}), d AS (SELECT doc_id, ' ' || array_to_string({WORDS.format("text")}, ' ') || ' ' AS body FROM documents)
SELECT DISTINCT doc_id FROM d, q WHERE contains(body, ' ' || q.text || ' ') AND len(string_split(q.text, ' ')) BETWEEN 5 AND 12""")
def j2(t, spark):
    """Each item's first 5 to 12 words stand in for a table of short questions."""
    w = tx.word_tokens(F.col("text"))
    q = t("benchmark").select("item_id", F.array_join(F.slice(w, F.lit(1), (F.col("item_id") % 8 + 5).cast("int")), " ").alias("text"))
    return co.phrase_ids(t("documents"), q)


OLD = "doc_id % 3 = 0"


def each_side(rows, judge):
    """judge(rows, corpus) both ways between the third of the documents that stands in for an older corpus and the rest, so
    that every row is judged."""
    old, new = rows.where(OLD), rows.where(~F.expr(OLD))
    return judge(new, old).unionByName(judge(old, new))


@query("j3_historical_dedup", f"WITH h AS (SELECT doc_id, {OLD} AS old, {DIGEST.format('text')} AS digest FROM documents) SELECT doc_id FROM h WHERE NOT EXISTS (SELECT 1 FROM h AS o WHERE o.digest = h.digest AND o.old <> h.old)")
def j3(t, spark):
    """Documents whose digest the other corpus does not have."""
    rows = t("documents").select("doc_id", hs.text_digest(tx.normalized(F.col("text"))).alias("digest"))
    return each_side(rows, lambda a, b: a.join(b.select("digest").distinct(), "digest", "left_anti").select("doc_id"))


BOTH = f"gram IN (SELECT gram FROM g GROUP BY gram HAVING count(DISTINCT {OLD}) = 2)"


@query("j4_heldout_spans", f"""WITH g AS (SELECT doc_id, unnest({GRAMS.format(32)}) AS gram FROM (SELECT doc_id, {WORDS.format("text")} AS w FROM documents))
SELECT DISTINCT doc_id FROM g WHERE {BOTH}""")
def j4(t, spark):
    """Documents that share 32 words in a row with the other corpus."""
    return co.shared_spans(t("documents").withColumn("old", F.expr(OLD)), "old")


def word_ids(t):
    """Tokens as whole numbers: the first seven hex digits of each word's md5."""
    ids = F.transform(tx.word_tokens(F.col("text")), lambda w: F.conv(F.substring(F.md5(w), 1, 7), 16, 10).cast("long"))
    return t("documents").select("doc_id", ids.alias("ids"))


@query("p9_bpe_tokens", None)
def p9(t, spark):
    """Subword ids with an end id; longer documents drop. The vocabulary file's path is a parameter."""
    import public_tokenizers

    rows = t("documents").select("doc_id", bpe_encode(F.col("text"), public_tokenizers.path("byte_bpe_50k.json")).alias("ids"))
    return rows.where(F.size("ids") <= 262_144).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"))


#: distinct fingerprints of 13 token ids in a row, modulo 2^64; a product of two 64-bit numbers fits UHUGEINT
MIX = "((xor({0}, {0} >> {1})::UHUGEINT * {2}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"
POLY = "list_reduce(list_prepend(0::HUGEINT, list_transform(ids[i:i + 12], lambda x: x::HUGEINT)), lambda a, x: (a * 1000003 + x + 1) % 18446744073709551616::HUGEINT)::UBIGINT"
SPANS = f"""ids AS (SELECT doc_id, list_transform({WORDS.format('text')}, lambda w: ('0x' || left(md5(w), 7))::BIGINT) AS ids FROM documents),
s0 AS (SELECT doc_id, list_transform(range(1, len(ids) - 11), lambda i: {POLY}) AS h FROM ids), s1 AS (SELECT doc_id, list_transform(h, lambda x: {MIX.format("x", 30, hs.SPAN_MIX_A)}) AS h FROM s0),
s2 AS (SELECT doc_id, list_transform(h, lambda x: {MIX.format("x", 27, hs.SPAN_MIX_B)}) AS h FROM s1), spans AS (SELECT doc_id, list_sort(list_distinct(list_transform(h, lambda x: xor(x, x >> 31)))) AS h FROM s2)"""


@query("p10_span_fingerprints", f"WITH {SPANS} SELECT doc_id, len(h) AS n_spans, sha256(array_to_string(list_transform(h, lambda x: lpad(to_hex(x), 16, '0')), ',')) AS spans_sha256 FROM spans")
def p10(t, spark):
    """Spans of 13 token ids, hashed modulo 2^64."""
    rows = word_ids(t).select("doc_id", hs.span_fingerprints(F.col("ids")).alias("s"))
    return rows.select("doc_id", F.size("s").cast("long").alias("n_spans"), F.sha2(F.array_join(F.transform("s", lambda x: F.lpad(F.hex(x), 16, "0")), ","), 256).alias("spans_sha256"))


@query("p11_sampled_spans", f"WITH {SPANS} SELECT doc_id, len(list_filter(h, lambda x: x % 1024 = 0)) AS n_sampled FROM spans")
def p11(t, spark):
    return word_ids(t).select("doc_id", F.size(hs.span_fingerprints(F.col("ids"), 13, 1024)).cast("long").alias("n_sampled"))


@query("j5_near_copies", f"""WITH {SPANS}, e AS (SELECT doc_id, {OLD} AS old, unnest(list_filter(h, lambda x: x % 4 = 0)) AS span FROM spans), k AS (SELECT span, bool_or(old) AS in_old, bool_or(NOT old) AS in_new FROM e GROUP BY span),
n AS (SELECT doc_id, count(*) AS sampled, count(*) FILTER (CASE WHEN old THEN in_new ELSE in_old END) AS found FROM e JOIN k USING (span) GROUP BY doc_id) SELECT *, found >= 2 AND 2 * found >= sampled AS near_copy FROM n""")
def j5(t, spark):
    """Sampled spans that the other corpus holds."""
    return each_side(word_ids(t), lambda a, b: co.near_copies(a, b, "ids"))


@query("j6_span_hits", f"""WITH g AS (SELECT DISTINCT doc_id, unnest({GRAMS.format(13)}) AS gram FROM (SELECT doc_id, {WORDS.format("text")} AS w FROM documents))
SELECT doc_id, count(*) AS hits FROM g WHERE {BOTH} GROUP BY doc_id""")
def j6(t, spark):
    """How many of its distinct 13-grams the other corpus holds."""
    grams = t("documents").select("doc_id", F.explode(F.array_distinct(tx.shingles(tx.word_tokens(F.col("text")), 13))).alias("gram"))
    return each_side(grams, lambda a, b: a.join(b.select("gram").distinct(), "gram", "left_semi").groupBy("doc_id").agg(F.count("*").alias("hits")))


@query("f19_holdout", f"SELECT doc_id, ('0x' || substr(d, 1, 16))::UBIGINT % 1000 = 0 AS holdout_1000, ('0x' || substr(d, 1, 16))::UBIGINT % 10 = 0 AS holdout_10 FROM (SELECT doc_id, {DIGEST.format('text')} AS d FROM documents)")
def f19(t, spark):
    rows = t("documents").select("doc_id", hs.text_digest(tx.normalized(F.col("text"))).alias("d"))
    return rows.select("doc_id", hs.holdout(F.col("d")).alias("holdout_1000"), hs.holdout(F.col("d"), 10).alias("holdout_10"))


@query("p22_stable_hash", "SELECT doc_id, sha256('20260101|' || source || '|' || doc_id) AS piped, sha256('20260101' || chr(31) || source || chr(31) || doc_id) AS unit FROM documents")
def p22(t, spark):
    parts = (F.lit("20260101"), F.col("source"), F.col("doc_id"))
    return t("documents").select("doc_id", hs.stable_hash(*parts).alias("piped"), hs.stable_hash(*parts, sep="\x1f").alias("unit"))


@query("f20_hash_bucket", "SELECT doc_id, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(sha256('split|' || doc_id), ''), lambda x: (instr('0123456789abcdef', x) - 1)::BIGINT)), lambda a, d: (a * 16 + d) % 10) AS bucket FROM documents")
def f20(t, spark):
    return t("documents").select("doc_id", hs.hash_bucket(hs.stable_hash(F.lit("split"), F.col("doc_id")), 10).alias("bucket"))


N_WORDS = f"len({WORDS.format('text')})"


@query("w9_pack_ranges", f"""WITH d AS (SELECT doc_id, {N_WORDS} + 1 AS n FROM documents), r AS (SELECT doc_id, n, sum(n) OVER (ORDER BY doc_id) - n AS start FROM d)
SELECT doc_id AS ord, start::BIGINT AS start, (start + n)::BIGINT AS stop, (start // 2049)::BIGINT AS first_block, ((start + n - 1) // 2049)::BIGINT AS last_block, (start // (2049 * 8))::BIGINT AS first_shard FROM r""")
def w9(t, spark):
    return co.block_ranges(t("documents"), "doc_id", F.size(tx.word_tokens(F.col("text"))))


@query("s12_pack_blocks", f"""WITH d AS (SELECT doc_id, list_append({WORDS.format("text")}, '') AS w FROM documents), f AS (SELECT doc_id, unnest(w) AS tok, generate_subscripts(w, 1) AS i FROM d),
p AS (SELECT tok, row_number() OVER (ORDER BY doc_id, i) - 1 AS pos, count(*) OVER () AS total FROM f)
SELECT pos // 2049 AS block_no, count(*) AS n_tokens, sha256(string_agg(tok, ',' ORDER BY pos)) AS block_sha256 FROM p WHERE pos < total // 2049 * 2049 GROUP BY 1""")
def s12(t, spark):
    pieces = co.pack_blocks(t("documents"), "doc_id", tx.word_tokens(F.col("text")))
    body = F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("slot", "tokens"))), lambda x: x["tokens"])), ",")
    return pieces.groupBy("block_no").agg(F.sum(F.size("tokens")).cast("long").alias("n_tokens"), F.sha2(body, 256).alias("block_sha256"))


@query("w10_token_cut", f"WITH r AS (SELECT doc_id, sum({N_WORDS} + 1) OVER (ORDER BY doc_id) AS upto, {N_WORDS} + 1 AS n FROM documents) SELECT doc_id, n FROM r WHERE upto - n < 100000")
def w10(t, spark):
    rows = t("documents").select("doc_id", (F.size(tx.word_tokens(F.col("text"))) + 1).cast("long").alias("n"))
    return co.prefix_sums(rows, "doc_id", F.col("n"), "before").where("before < 100000").select("doc_id", "n")


@query("w11_char_budget", "WITH r AS (SELECT doc_id, length(text) AS n, sum(length(text)) OVER (ORDER BY doc_id) AS upto FROM documents) SELECT doc_id, n FROM r WHERE upto - n < 500000")
def w11(t, spark):
    """The prefix of rows up to and with the one that crosses the budget."""
    rows = t("documents").select("doc_id", F.length("text").cast("long").alias("n"))
    return co.prefix_sums(rows, "doc_id", F.col("n"), "before").where("before < 500000").select("doc_id", "n")


@query("w12_boundary_recovery", f"""WITH d AS (SELECT doc_id, {N_WORDS} + 1 AS n FROM documents), r AS (SELECT doc_id, n, sum(n) OVER (ORDER BY doc_id) AS upto, sum(n) OVER () AS total FROM d)
SELECT doc_id, (upto - n)::BIGINT AS start, n FROM r WHERE upto <= total // 2049 * 2049""")
def w12(t, spark):
    """Documents that lie whole inside the kept blocks."""
    rows = co.block_ranges(t("documents"), "doc_id", F.size(tx.word_tokens(F.col("text"))))
    kept = (rows.agg(F.max("stop")).first()[0] or 0) // 2049 * 2049
    return rows.where(F.col("stop") <= kept).select(F.col("ord").alias("doc_id"), "start", (F.col("stop") - F.col("start")).alias("n"))


@query("w13_block_lookup", f"""WITH n AS (SELECT source, sum({N_WORDS} + 1) // 2049 AS blocks FROM documents GROUP BY source), c AS (SELECT source, blocks, sum(blocks) OVER (ORDER BY source) - blocks AS first FROM n)
SELECT (first + i)::BIGINT AS block, source, i AS local FROM (SELECT source, first, unnest(range(0, blocks::BIGINT)) AS i FROM c)""")
def w13(t, spark):
    """Global block number to (shard, local block); a shard is a source here."""
    from pyspark.sql import Window

    n = t("documents").groupBy("source").agg(F.floor(F.sum(F.size(tx.word_tokens(F.col("text"))) + 1) / 2049).alias("blocks"))
    c = n.withColumn("first", F.sum("blocks").over(Window.orderBy("source")) - F.col("blocks")).where("blocks > 0")
    return c.select("first", "source", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("local")).select((F.col("first") + F.col("local")).alias("block"), "source", F.col("local").cast("long").alias("local"))


BITS = "list_reduce(list_prepend(0::BIGINT, list_transform(embedding[1:62], lambda x: CASE WHEN x > 0 THEN 1::BIGINT ELSE 0::BIGINT END)), lambda a, b: a * 2 + b)"


def sign_bits(t):
    """62 signs of an embedding as a number, in place of an image hash."""
    return t("embeddings").select("vec_id", "label", F.aggregate(F.slice("embedding", 1, 62), F.lit(0).cast("long"), lambda a, x: a * 2 + F.when(x > 0, 1).otherwise(0)).alias("bits"))


@query("j10_hamming_pairs", f"WITH b AS (SELECT vec_id, {BITS} AS bits FROM embeddings) SELECT x.vec_id AS a, y.vec_id AS b, bit_count(xor(x.bits, y.bits))::BIGINT AS d FROM b x JOIN b y ON x.vec_id < y.vec_id WHERE bit_count(xor(x.bits, y.bits)) <= 12")
def j10(t, spark):
    return co.hamming_pairs(sign_bits(t), "vec_id", "bits", 12)


@query("j20_near_pair_count", f"WITH b AS (SELECT vec_id, {BITS} AS bits FROM embeddings) SELECT bit_count(xor(x.bits, y.bits))::BIGINT AS d, count(*) AS pairs FROM b x JOIN b y ON x.vec_id < y.vec_id WHERE bit_count(xor(x.bits, y.bits)) BETWEEN 1 AND 12 GROUP BY 1")
def j20(t, spark):
    return co.near_pair_counts(sign_bits(t), "bits", 12)


@query("j11_hamming_anti", f"WITH b AS (SELECT vec_id, {BITS} AS bits FROM embeddings) SELECT vec_id FROM b x WHERE NOT EXISTS (SELECT 1 FROM b y WHERE y.vec_id % 2 <> x.vec_id % 2 AND bit_count(xor(x.bits, y.bits)) <= 14)")
def j11(t, spark):
    """Rows farther than 14 bits from every row of the other set: even ids and odd ones."""
    rows = sign_bits(t)
    even, odd = rows.where("vec_id % 2 = 0"), rows.where("vec_id % 2 = 1")
    return co.far_rows(odd, even, "bits", 14).select("vec_id").unionByName(co.far_rows(even, odd, "bits", 14).select("vec_id"))
