"""Audits: rates, distributions, duplicates, top-k, cell statistics, conversation checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.functions import text as tx
from siltstone.operators import policies as po
from siltstone.operators import corpus as co
from siltstone.plans.base import query

C = F.col
NORM = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"
AUDIT_URL = "'https://Host' || (doc_id % 40) || '.example.com/p?q=' || doc_id"


@query("a4_corpus_audit", f"""WITH s AS (SELECT *, length(text) AS n, coalesce({{scored}}, 0) AS ls, n_chars % 6 AS sc, lower(regexp_extract({AUDIT_URL}, '^[a-z]+://([^/?#]*)', 1)) AS domain FROM documents),
j AS (SELECT *, coalesce(lang = 'en' AND ls >= 0.9, FALSE) AS spoken FROM s), k AS (SELECT * FROM j WHERE spoken AND length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 200 ORDER BY doc_id LIMIT 20000),
b AS (SELECT CASE WHEN count(*) < 20000 THEN (SELECT max(doc_id) FROM documents) ELSE max(doc_id) END AS last FROM k)
SELECT count(*) AS docs, count(DISTINCT domain) AS domains, quantile_cont(n, 0.5)::DOUBLE AS median_chars, list_sort(list(n))[least(count(*) - 1, floor(count(*) * 0.95)::BIGINT) + 1] AS p95_chars,
round(avg(ls), 9) AS language_score_mean, min(ls) AS language_score_min, quantile_cont(sc::DOUBLE, 0.5) AS score_median, list_sort(list(sc::DOUBLE))[least(count(*) - 1, floor(count(*) * 0.1)::BIGINT) + 1] AS score_p10,
count(*) - count(DISTINCT {NORM}) AS duplicates, round(avg(regexp_matches(text, '(?i)\\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{{2,}}\\b')::INT), 9) AS email_rate,
round(avg(regexp_matches(text, '(^|[^0-9])(?:\\d{{1,3}}\\.){{3}}\\d{{1,3}}([^0-9]|$)')::INT), 9) AS ip_rate, round(avg(regexp_matches(lower(text), '{"|".join(co.FURNITURE)}')::INT), 9) AS furniture_rate,
round((SELECT max(c) FROM (SELECT count(*) AS c FROM k GROUP BY domain)) / count(*), 9) AS top_domain_share, (SELECT count(*) FROM j, b WHERE doc_id <= last) AS rows_scanned, (SELECT count(*) FROM j, b WHERE doc_id <= last AND NOT spoken) AS language_rejected FROM k""".replace("{scored}", "CASE WHEN doc_id % 7 <> 0 THEN (85 + doc_id % 20) / 100 END"))
def a4(t, spark):
    """URLs and scores are derived from doc_id, since documents have none."""
    i = C("doc_id")
    url = F.concat(F.lit("https://Host"), (i % 40).cast("string"), F.lit(".example.com/p?q="), i.cast("string"))
    return co.corpus_audit(t("documents"), "doc_id", "text", url, C("lang"), F.when(i % 7 != 0, (F.lit(85) + i % 20) / 100), C("n_chars") % 6)


@query("a5_floor_quantile", "WITH r AS (SELECT source, length(text) AS n, row_number() OVER (PARTITION BY source ORDER BY length(text)) - 1 AS i, count(*) OVER (PARTITION BY source) AS c FROM documents) SELECT source, n AS p95 FROM r WHERE i = least(c - 1, floor(c * 0.95)::BIGINT)")
def a5(t, spark):
    """sorted[min(n - 1, int(n * q))], from counts for each length."""
    at = t("documents").groupBy("source", F.length("text").cast("long").alias("n")).count()
    w = Window.partitionBy("source")
    placed = at.withColumns({"upto": F.sum("count").over(w.orderBy("n")), "c": F.sum("count").over(w)})
    want = F.least(C("c") - 1, F.floor(C("c") * 0.95))
    return placed.where((C("upto") > want) & (C("upto") - C("count") <= want)).select("source", C("n").alias("p95"))


@query("a6_distribution", "SELECT lang, min(n_chars)::DOUBLE AS lo, round(quantile_cont(n_chars, 0.01), 6) AS p01, quantile_cont(n_chars, 0.5) AS p50, round(quantile_cont(n_chars, 0.95), 6) AS p95, round(quantile_cont(n_chars, 0.99), 6) AS p99, max(n_chars)::DOUBLE AS hi, round(avg(n_chars), 6) AS mean FROM documents GROUP BY lang")
def a6(t, spark):
    p = F.percentile("n_chars", F.array(*(F.lit(x) for x in (0.01, 0.5, 0.95, 0.99))))
    got = t("documents").groupBy("lang").agg(p.alias("p"), F.min("n_chars").cast("double").alias("lo"), F.max("n_chars").cast("double").alias("hi"), F.round(F.avg("n_chars"), 6).alias("mean"))
    return got.select("lang", "lo", *(F.round(C("p")[i], 6).alias(n) for i, n in enumerate(("p01", "p50", "p95", "p99"))), "hi", "mean")


@query("a7_distinct_counts", f"SELECT source, count(*) AS docs, count(DISTINCT {NORM}) AS distinct_texts, count(*) - count(DISTINCT {NORM}) AS duplicates FROM documents GROUP BY source")
def a7(t, spark):
    rows = t("documents").select("source", F.sha2(tx.normalized(C("text")), 256).alias("h"))
    return rows.groupBy("source").agg(F.count("*").alias("docs"), F.countDistinct("h").alias("distinct_texts"), (F.count("*") - F.countDistinct("h")).alias("duplicates"))


@query("a8_top_words", "SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents) GROUP BY w ORDER BY n DESC, w LIMIT 25")
def a8(t, spark):
    """The 25 most common words; ties by the word."""
    return t("documents").select(F.explode(tx.word_tokens(C("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(25)


@query("a9_cell_stats", """WITH c AS (SELECT p_brand, p_type, p_size % 5 AS attr, count(*) AS n FROM part GROUP BY ALL)
SELECT p_brand, p_type, count(*) AS attributes, sum((n >= 2)::INT)::BIGINT AS repeated, ((sum(n) * sum(n) - sum(n * n)) // 2)::BIGINT AS cross_pairs FROM c GROUP BY 1, 2 HAVING count(*) >= 2""")
def a9(t, spark):
    """Pairs of different attributes in a cell: half of (sum squared less sum of squares)."""
    cells = t("part").groupBy("p_brand", "p_type", (C("p_size") % 5).alias("attr")).agg(F.count("*").alias("n"))
    got = cells.groupBy("p_brand", "p_type").agg(F.count("*").alias("attributes"), F.sum((C("n") >= 2).cast("long")).alias("repeated"), F.sum("n").alias("s"), F.sum(C("n") * C("n")).alias("q"))
    return got.where("attributes >= 2").select("p_brand", "p_type", "attributes", "repeated", F.floor((C("s") * C("s") - C("q")) / 2).alias("cross_pairs"))


@query("a10_conflicts", "SELECT l_partkey, count(DISTINCT l_returnflag) AS flags FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_returnflag) > 1")
def a10(t, spark):
    return t("lineitem").groupBy("l_partkey").agg(F.countDistinct("l_returnflag").alias("flags")).where("flags > 1")


@query("a11_collect_ordered", "SELECT conv_id, sha256(string_agg(text, '|' ORDER BY turn)) AS texts_sha256 FROM conversations WHERE role <> 'system' GROUP BY conv_id")
def a11(t, spark):
    rows = t("conversations").where("role <> 'system'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("x"))
    return rows.select("conv_id", F.sha2(F.array_join(F.transform("x", lambda s: s["text"]), "|"), 256).alias("texts_sha256"))


@query("a12_source_totals", "WITH a AS (SELECT source, sum(n_chars)::BIGINT AS actual, count(*) * 2000 AS requested FROM documents GROUP BY source) SELECT source, requested, actual, actual >= requested AS met FROM a")
def a12(t, spark):
    got = t("documents").groupBy("source").agg((F.count("*") * 2000).alias("requested"), F.sum("n_chars").alias("actual"))
    return got.withColumn("met", C("actual") >= C("requested"))


@query("a15_confusion", """WITH p AS (SELECT quality, CASE WHEN n_chars >= 300 AND length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) < 5 THEN 1 ELSE 0 END AS pred FROM documents JOIN labels USING (doc_id))
SELECT quality AS target, sum((pred = 0)::INT)::BIGINT AS predicted_0, sum((pred = 1)::INT)::BIGINT AS predicted_1 FROM p GROUP BY quality""")
def a15(t, spark):
    """Confusion matrix of a simple quality rule against the labels."""
    pred = ((C("n_chars") >= 300) & (F.length(F.regexp_replace("text", r"[^#*$%&|<>]", "")) < 5)).cast("int")
    rows = t("documents").join(t("labels"), "doc_id").select(C("quality").alias("target"), pred.alias("pred"))
    got = rows.groupBy("target").pivot("pred", [0, 1]).count()
    return got.select("target", F.coalesce(C("0"), F.lit(0)).alias("predicted_0"), F.coalesce(C("1"), F.lit(0)).alias("predicted_1"))


@query("a15_accuracy", "WITH p AS (SELECT quality, (n_chars >= 300)::INT AS pred FROM documents JOIN labels USING (doc_id)) SELECT round(avg((quality = pred)::INT), 9) AS accuracy, round(greatest(avg(quality), 1 - avg(quality)), 9) AS majority, count(*) AS n FROM p")
def a15b(t, spark):
    rows = t("documents").join(t("labels"), "doc_id").select("quality", (C("n_chars") >= 300).cast("int").alias("pred"))
    share = F.avg("quality")
    return rows.agg(F.round(F.avg((C("quality") == C("pred")).cast("int")), 9).alias("accuracy"), F.round(F.greatest(share, 1 - share), 9).alias("majority"), F.count("*").alias("n"))


@query("a19_windows", """SELECT event_id // 500 AS win, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, round(count(*) FILTER (value > 0) / sum(1 / value) FILTER (value > 0), 6) AS harmonic, epoch_us(max(ts)) // 1000000 - epoch_us(min(ts)) // 1000000 AS seconds FROM events GROUP BY 1""")
def a19(t, spark):
    """Windows of 500 steps: sums, means, harmonic means and elapsed seconds."""
    whole = lambda c: F.unix_seconds(c.cast("timestamp"))
    positive = F.when(C("value") > 0, C("value"))
    return t("events").groupBy(F.floor(C("event_id") / 500).alias("win")).agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.count(positive) / F.sum(1 / positive), 6).alias("harmonic"), (whole(F.max("ts")) - whole(F.min("ts"))).alias("seconds")
    )


@query("a20_loss_windows", "SELECT event_id // 1000 AS win, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.9), 6) AS p90, max(event_id) - min(event_id) + 1 = count(*) AS contiguous FROM events GROUP BY 1")
def a20(t, spark):
    q = lambda p: F.round(F.percentile("value", p), 6)
    return t("events").groupBy(F.floor(C("event_id") / 1000).alias("win")).agg(F.round(F.avg("value"), 6).alias("mean"), q(0.1).alias("p10"), q(0.9).alias("p90"), (F.max("event_id") - F.min("event_id") + 1 == F.count("*")).alias("contiguous"))


@query("w15_contiguity", "SELECT user_id, sum((gap <= 0)::INT)::BIGINT AS not_rising, max(gap) AS widest FROM (SELECT user_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events) GROUP BY user_id")
def w15(t, spark):
    gap = C("event_id") - F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return t("events").select("user_id", gap.alias("gap")).groupBy("user_id").agg(F.coalesce(F.sum((C("gap") <= 0).cast("long")), F.lit(0)).alias("not_rising"), F.max("gap").alias("widest"))


@query("a29_group_constancy", "SELECT conv_id, count(DISTINCT role) AS roles, list_sort(list(DISTINCT role)) = ['assistant', 'user'] AS complete, count(DISTINCT CASE WHEN role = 'system' THEN text END) <= 1 AS constant_system FROM conversations GROUP BY conv_id")
def a29(t, spark):
    return t("conversations").groupBy("conv_id").agg(
        F.countDistinct("role").alias("roles"),
        (F.array_sort(F.collect_set("role")) == F.array(F.lit("assistant"), F.lit("user"))).alias("complete"),
        (F.countDistinct(F.when(C("role") == "system", C("text"))) <= 1).alias("constant_system"),
    )


@query("a30_histogram_l1", "WITH h AS (SELECT doc_id % 2 AS side, least(n_chars // 500, 20) AS bin, count(*) AS n FROM documents GROUP BY ALL) SELECT sum(abs(coalesce(a.n, 0) - coalesce(b.n, 0)))::BIGINT AS distance FROM (SELECT * FROM h WHERE side = 0) a FULL JOIN (SELECT * FROM h WHERE side = 1) b USING (bin)")
def a30(t, spark):
    h = t("documents").groupBy((C("doc_id") % 2).alias("side"), F.least(F.floor(C("n_chars") / 500), F.lit(20)).alias("bin")).agg(F.count("*").alias("n"))
    a, b = h.where("side = 0").select("bin", C("n").alias("x")), h.where("side = 1").select("bin", C("n").alias("y"))
    return a.join(b, "bin", "full_outer").agg(F.sum(F.abs(F.coalesce("x", F.lit(0)) - F.coalesce("y", F.lit(0)))).alias("distance"))


LOG = "'step ' || event_id || ' | mem=' || (user_id * 10) || 'MB | gpu=' || (event_id % 100) || '% | loss=' || (event_id % 37)"


@query("a31_log_summary", f"""WITH l AS (SELECT event_id, {LOG} AS line FROM events), p AS (SELECT event_id, regexp_extract(line, 'mem=(\\d+)MB', 1)::BIGINT AS mem, regexp_extract(line, 'gpu=(\\d+)%', 1)::BIGINT AS gpu, regexp_extract(line, 'loss=(\\d+)', 1)::DOUBLE AS loss FROM l)
SELECT quantile_cont(CASE WHEN event_id >= 100 THEN loss END, 0.5) AS steady_median, round(avg(CASE WHEN gpu >= 10 THEN gpu END), 6) AS active_gpu, max(mem) AS peak_mem FROM p""")
def a31(t, spark):
    """Log lines parsed by patterns: steady-state median, mean of active samples, peak."""
    i = C("event_id")
    line = F.concat(F.lit("step "), i.cast("string"), F.lit(" | mem="), (C("user_id") * 10).cast("string"), F.lit("MB | gpu="), (i % 100).cast("string"), F.lit("% | loss="), (i % 37).cast("string"))
    pick = lambda p, k: F.regexp_extract("line", p, 1).cast(k)
    rows = t("events").select(i, line.alias("line")).select("event_id", pick(r"mem=(\d+)MB", "long").alias("mem"), pick(r"gpu=(\d+)%", "long").alias("gpu"), pick(r"loss=(\d+)", "double").alias("loss"))
    return rows.agg(F.percentile(F.when(i >= 100, C("loss")), 0.5).alias("steady_median"), F.round(F.avg(F.when(C("gpu") >= 10, C("gpu"))), 6).alias("active_gpu"), F.max("mem").alias("peak_mem"))


@query("a32_review_coverage", "WITH r AS (SELECT source, doc_id % 3 <> 0 AS reviewed, doc_id % 4 <> 1 AS accepted FROM documents) SELECT source, count(*) AS n, sum(reviewed::INT)::BIGINT AS reviewed, round(avg(CASE WHEN reviewed THEN accepted::INT END), 9) AS acceptance FROM r GROUP BY source")
def a32(t, spark):
    docs = t("documents").select("doc_id", "source")
    decisions = docs.where("doc_id % 3 <> 0").select("doc_id", (C("doc_id") % 4 != 1).cast("int").alias("accepted"))
    return docs.join(decisions, "doc_id", "left").groupBy("source").agg(F.count("*").alias("n"), F.count("accepted").alias("reviewed"), F.round(F.avg("accepted"), 9).alias("acceptance"))


@query("a25_budget_ledger", """WITH RECURSIVE c AS (SELECT row_number() OVER (ORDER BY event_id) AS rn, user_id AS branch, round(value * 100)::BIGINT AS tokens FROM events),
g(rn, branch, tokens, spent, ok) AS (SELECT 0::BIGINT, NULL::BIGINT, 0::BIGINT, 0::BIGINT, false
    UNION ALL SELECT c.rn, c.branch::BIGINT, c.tokens, CASE WHEN c.tokens > 0 AND spent + c.tokens <= 5000000 THEN spent + c.tokens ELSE spent END, c.tokens > 0 AND spent + c.tokens <= 5000000 FROM g JOIN c ON c.rn = g.rn + 1)
SELECT branch, count(*) AS requests, sum(ok::INT)::BIGINT AS granted, sum(CASE WHEN ok THEN tokens ELSE 0 END)::BIGINT AS charged FROM g WHERE rn > 0 GROUP BY branch""")
def a25(t, spark):
    """One cap over all branches; a refused request adds nothing, so later ones that fit are granted."""
    rows = t("events").select(C("user_id").cast("long").alias("branch"), "event_id", F.round(C("value") * 100).cast("long").alias("tokens"))
    r = co.grant(rows, "event_id", "tokens", 5_000_000)
    return r.groupBy("branch").agg(F.count("*").alias("requests"), F.sum(C("granted").cast("long")).alias("granted"), F.sum(F.when(C("granted"), C("tokens")).otherwise(0)).alias("charged"))


@query("conversation_schema_audit", "WITH r AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) SELECT conv_id, count(*) AS turns, sum((role = before)::INT)::BIGINT AS repeated_roles, bool_or(text = '') AS empty_text, min(CASE WHEN before IS NULL THEN role END) AS first_role FROM r GROUP BY conv_id")
def conv_audit(t, spark):
    before = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    r = t("conversations").withColumn("before", before)
    return r.groupBy("conv_id").agg(
        F.count("*").alias("turns"), F.sum((C("role") == C("before")).cast("long")).alias("repeated_roles"), F.bool_or(C("text") == "").alias("empty_text"), F.min(F.when(C("before").isNull(), C("role"))).alias("first_role")
    )


@query("duplicate_prompts", f"WITH p AS (SELECT conv_id, sha256({NORM}) AS h FROM conversations WHERE turn = 0) SELECT h AS prompt, count(*) AS n FROM p GROUP BY h HAVING count(*) > 1")
def dup_prompts(t, spark):
    rows = t("conversations").where("turn = 0").select(F.sha2(tx.normalized(C("text")), 256).alias("prompt"))
    return rows.groupBy("prompt").agg(F.count("*").alias("n")).where("n > 1")


@query("caption_reason_counts", None)
def caption_counts(t, spark):
    """Caption reasons over all conversation texts, counted."""
    return t("conversations").select(po.caption_reason(C("text")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
