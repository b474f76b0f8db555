"""Evaluation statistics. Results of two models are derived from the documents and their labels: a task is a
language, an item a labelled document, and a model is right where a simple rule agrees with the label."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.operators import corpus as co
from siltstone.operators import pairs as pr
from siltstone.operators import stats as st
from siltstone.plans.base import query

C = F.col

EVAL = """ev AS (SELECT doc_id, lang AS task, quality AS target, sha256(source) AS prompt_hash, n_chars, source, ((n_chars >= 300)::INT = quality)::INT AS a, ((n_chars % 9 <> 0)::INT = quality)::INT AS b FROM documents JOIN labels USING (doc_id))"""


def results(t):
    right = lambda rule: (rule.cast("int") == C("quality")).cast("int")
    rows = t("documents").join(t("labels"), "doc_id")
    return rows.select("doc_id", C("lang").alias("task"), C("quality").alias("target"), F.sha2("source", 256).alias("prompt_hash"), "n_chars", "source", right(C("n_chars") >= 300).alias("a"), right(C("n_chars") % 9 != 0).alias("b"))


def aligned(t):
    ev = results(t)
    side = lambda m: ev.select("task", "doc_id", "prompt_hash", C(m).alias("value"))
    return st.align(side("a"), side("b"), ["task", "doc_id"], ["prompt_hash"])


@query("j14_strict_alignment", f"WITH {EVAL} SELECT task, doc_id, a AS left_value, b AS right_value FROM ev")
def j14(t, spark):
    return aligned(t).select("task", "doc_id", "left_value", "right_value")


@query("a13_task_comparison", f"WITH {EVAL} SELECT task, count(*) AS n, round(avg(a), 9) AS acc_a, round(avg(b), 9) AS acc_b, sum((b > a)::INT)::BIGINT AS wins, sum((b = a)::INT)::BIGINT AS ties, sum((b < a)::INT)::BIGINT AS losses, round(100 * (avg(b) - avg(a)), 6) AS diff_pp FROM ev GROUP BY task")
def a13(t, spark):
    l, r = C("left_value"), C("right_value")
    return aligned(t).groupBy("task").agg(
        F.count("*").alias("n"), F.round(F.avg(l), 9).alias("acc_a"), F.round(F.avg(r), 9).alias("acc_b"), F.count_if(r > l).alias("wins"), F.count_if(r == l).alias("ties"), F.count_if(r < l).alias("losses"), F.round(100 * (F.avg(r) - F.avg(l)), 6).alias("diff_pp")
    )


@query("a14_macro_pooled", f"""WITH {EVAL}, k AS (SELECT task, avg(b) - avg(a) AS d, count(*) AS n FROM ev GROUP BY task), x AS (SELECT 'all' AS left_out UNION ALL SELECT task FROM k)
SELECT left_out, round(avg(d), 9) AS macro, round(sum(d * n) / sum(n), 9) AS pooled FROM x JOIN k ON task <> left_out GROUP BY left_out""")
def a14(t, spark):
    """Macro and sample-weighted means over tasks, all and with each task left out, from task sums."""
    k = results(t).groupBy("task").agg((F.avg("b") - F.avg("a")).alias("d"), F.count("*").alias("n"))
    total = k.agg(F.sum("d").alias("sd"), F.sum(C("d") * C("n")).alias("sdn"), F.sum("n").alias("sn"), F.count("*").alias("k")).first()
    rows = k.select("task", "d", "n").unionByName(spark.createDataFrame([("all", 0.0, 0)], "task string, d double, n long"))
    kept = total["k"] - F.when(C("task") == "all", 0).otherwise(1)
    return rows.select(C("task").alias("left_out"), F.round((total["sd"] - C("d")) / kept, 9).alias("macro"), F.round((total["sdn"] - C("d") * C("n")) / (total["sn"] - C("n")), 9).alias("pooled"))


FAMILY = """fam AS (SELECT conv_id AS family, ['count', 'left', 'same'][conv_id % 3 + 1] AS task, cond, conv_id % 2 AS expected_base, (conv_id + 1) % 2 AS expected_edited, conv_id % 2 AS expected_invariant,
(conv_id * k % 3) % 2 AS base, (conv_id * k % 5) % 2 AS edited, (conv_id * k % 7) % 2 AS invariant FROM (SELECT DISTINCT conv_id FROM conversations), (SELECT unnest(['true', 'swapped', 'blank']) AS cond, unnest([1, 2, 4]) AS k))"""


def families(t, spark):
    conds = F.array(*(F.struct(F.lit(c).alias("cond"), F.lit(k).alias("k")) for c, k in (("true", 1), ("swapped", 2), ("blank", 4))))
    rows = t("conversations").select("conv_id").distinct().select("conv_id", F.inline(conds))
    i, k = C("conv_id"), C("k")
    task = F.get(F.array(F.lit("count"), F.lit("left"), F.lit("same")), (i % 3).cast("int"))
    return rows.select(
        i.alias("family"), task.alias("task"), "cond", (i % 2).alias("expected_base"), ((i + 1) % 2).alias("expected_edited"), (i % 2).alias("expected_invariant"), (i * k % 3 % 2).alias("base"), (i * k % 5 % 2).alias("edited"), (i * k % 7 % 2).alias("invariant")
    )


R = lambda v: f"({v} = expected_{v})"


VALID = "(CASE task WHEN 'left' THEN {0} = 1 ELSE {0} IN (0, 1) END)"
_pc = lambda *xs: f"round(100 * avg(({' + '.join(f'({x})::INT' for x in xs)}) / {len(xs)}.0), 9)"
_all = ("base", "edited", "invariant")


@query("a16_family_metrics", f"""WITH {FAMILY} SELECT cond, coalesce(task, 'all') AS task, count(*) AS families, {_pc(R("base") + " AND " + R("edited"))} AS joint, {_pc(R("base") + " AND " + R("invariant"))} AS base_invariant, {_pc(R("base"), R("edited"))} AS ordinary_primary, {_pc(*map(R, _all))} AS ordinary_all,
{", ".join(f"{_pc(R(v))} AS {v}_accuracy" for v in _all)}, {_pc(VALID.format("base"), VALID.format("edited"))} AS valid_primary, {_pc(*map(VALID.format, _all))} AS valid_all, {_pc("base = edited")} AS same_prediction,
{", ".join(f"count(*) FILTER ({v} = {a}) AS n_{v}_{a}" for v in _all for a in (0, 1))} FROM fam GROUP BY GROUPING SETS ((cond), (cond, task))""")
def a16(t, spark):
    """Overall and by task: grouping sets. One task admits a single answer, so validity is not whole."""
    f = families(t, spark).withColumn("candidates", F.when(C("task") == "left", F.array(F.lit(1).cast("long"))).otherwise(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))))
    return pr.family_metrics(f, "cond", "task", "candidates", (0, 1)).withColumn("task", F.coalesce("task", F.lit("all")))


@query("a17_conditional_failure", f"WITH {EVAL} SELECT task, count(*) FILTER (a = 1) AS reference_right, round(avg((b = 0)::INT) FILTER (a = 1), 9) AS failure_rate FROM ev GROUP BY task")
def a17(t, spark):
    return results(t).groupBy("task").agg(F.count_if(C("a") == 1).alias("reference_right"), F.round(F.avg(F.when(C("a") == 1, (C("b") == 0).cast("int"))), 9).alias("failure_rate"))


GROUPS = """g AS (SELECT o_orderkey AS grp, o_orderstatus AS field, o_orderkey % 3 <> 0 AS q0i0, o_custkey % 4 <> 0 AS q0i1, (o_orderkey + o_custkey) % 3 <> 1 AS q1i0, o_custkey % 5 <> 2 AS q1i1 FROM orders)"""


@query("a18_group_metrics", f"""WITH {GROUPS} SELECT field, count(*) AS n, round(avg(((q0i0 AND q0i1)::INT + (q1i0 AND q1i1)::INT) / 2.0), 9) AS q_acc, round(avg(((q0i0 AND q1i0)::INT + (q0i1 AND q1i1)::INT) / 2.0), 9) AS i_acc,
round(avg((q0i0::INT + q0i1::INT + q1i0::INT + q1i1::INT) / 4.0), 9) AS acc, round(avg((q0i0 AND q0i1 AND q1i0 AND q1i1)::INT), 9) AS g_acc FROM g GROUP BY field""")
def a18(t, spark):
    """2 x 2 groups: both answers of a question, both questions of an image, single answers, all four."""
    k, c = C("o_orderkey"), C("o_custkey")
    g = t("orders").select(C("o_orderstatus").alias("field"), (k % 3 != 0).alias("q0i0"), (c % 4 != 0).alias("q0i1"), ((k + c) % 3 != 1).alias("q1i0"), (c % 5 != 2).alias("q1i1"))
    i = lambda x: x.cast("int")
    a, b, d, e = C("q0i0"), C("q0i1"), C("q1i0"), C("q1i1")
    mean = lambda x: F.round(F.avg(x), 9)
    return g.groupBy("field").agg(F.count("*").alias("n"), mean((i(a & b) + i(d & e)) / 2).alias("q_acc"), mean((i(a & d) + i(b & e)) / 2).alias("i_acc"), mean((i(a) + i(b) + i(d) + i(e)) / 4).alias("acc"), mean(i(a & b & d & e)).alias("g_acc"))


@query("a21_complete_cases", """WITH s AS (SELECT c_nationkey % 8 AS recipe, c_custkey % 3 AS seed, c_mktsegment AS task, avg(c_acctbal) AS score FROM customer GROUP BY ALL), w AS (SELECT recipe, seed, avg(score) AS m FROM s GROUP BY 1, 2 HAVING count(*) = 5), r AS (SELECT recipe, avg(m) AS m FROM w GROUP BY 1 HAVING count(*) = 3)
SELECT recipe, round(m, 6) AS score, (rank() OVER (ORDER BY m DESC))::INT AS place FROM r""")
def a21(t, spark):
    """Sets with all five tasks, recipes with all three seeds, then a rank."""
    s = t("customer").groupBy((C("c_nationkey") % 8).alias("recipe"), (C("c_custkey") % 3).alias("seed"), C("c_mktsegment").alias("task")).agg(F.avg("c_acctbal").alias("score"))
    w = s.groupBy("recipe", "seed").agg(F.avg("score").alias("m"), F.map_from_entries(F.collect_list(F.struct("task", "score"))).alias("tasks")).where(F.size("tasks") == 5)
    r = w.groupBy("recipe").agg(F.avg("m").alias("m"), F.count("*").alias("seeds")).where("seeds = 3")
    return r.select("recipe", F.round("m", 6).alias("score"), F.rank().over(Window.orderBy(F.desc("m"))).alias("place"))


@query("a22_cluster_verification", f"WITH {EVAL} SELECT source, sum(a)::BIGINT AS hits, count(*) AS n, count(DISTINCT doc_id) = count(*) AS unique_items, sum(a) BETWEEN 0 AND count(*) AS in_bounds FROM ev GROUP BY source")
def a22(t, spark):
    return results(t).groupBy("source").agg(F.sum("a").alias("hits"), F.count("*").alias("n"), (F.countDistinct("doc_id") == F.count("*")).alias("unique_items"), F.sum("a").between(0, F.count("*")).alias("in_bounds"))


def pair_diffs(t):
    return results(t).select("task", "source", "doc_id", (C("b") - C("a")).cast("double").alias("d"))


@query("a23_interval_classes", f"WITH {EVAL}, m AS (SELECT source, avg(b - a) AS m, 1.96 * stddev_samp(b - a) / sqrt(count(*)) AS h FROM ev GROUP BY source) SELECT CASE WHEN m - h > 0 THEN 'win' WHEN m + h < 0 THEN 'loss' ELSE 'inconclusive' END AS verdict, count(*) AS n FROM m GROUP BY 1")
def a23(t, spark):
    m = pair_diffs(t).groupBy("source").agg(F.avg("d").alias("m"), (1.96 * F.stddev_samp("d") / F.sqrt(F.count("*"))).alias("h"))
    verdict = F.when(C("m") - C("h") > 0, "win").when(C("m") + C("h") < 0, "loss").otherwise("inconclusive")
    return m.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query("a24_compute_ratio", "SELECT p_partkey, round(6.0 * p_size * 1e6 * p_retailprice / (6.0 * 10 * 1e6 * 1000), 9) AS ratio FROM part")
def a24(t, spark):
    """Six times parameters times tokens, against a baseline."""
    return t("part").select("p_partkey", F.round(6.0 * C("p_size") * 1e6 * C("p_retailprice") / (6.0 * 10 * 1e6 * 1000), 9).alias("ratio"))


SIX = "six AS (SELECT l_orderkey AS pair, l_linenumber <= 2 AS affected, (l_partkey % 4 <> 0) AS ok FROM lineitem WHERE l_linenumber <= 6), p AS (SELECT pair, bool_and(ok) FILTER (affected) AS aff, bool_and(ok) FILTER (NOT affected) AS inv, count(*) AS n, sum(affected::INT) AS na FROM six GROUP BY pair HAVING count(*) = 6 AND sum(affected::INT) = 2)"


@query("a27_six_question", f"WITH {SIX} SELECT count(*) AS pairs, round(avg(aff::INT), 9) AS all_affected, round(avg(inv::INT), 9) AS all_invariant, round(avg((aff AND inv)::INT), 9) AS all_six FROM p")
def a27(t, spark):
    """Groups of two affected and four invariant questions, each all right or not."""
    six = t("lineitem").where("l_linenumber <= 6").select(C("l_orderkey").alias("pair"), (C("l_linenumber") <= 2).alias("affected"), (C("l_partkey") % 4 != 0).alias("ok"))
    p = six.groupBy("pair").agg(F.bool_and(F.when(C("affected"), C("ok"))).alias("aff"), F.bool_and(F.when(~C("affected"), C("ok"))).alias("inv"), F.count("*").alias("n"), F.count_if("affected").alias("na"))
    mean = lambda c: F.round(F.avg(c.cast("int")), 9)
    return p.where("n = 6 AND na = 2").agg(F.count("*").alias("pairs"), mean(C("aff")).alias("all_affected"), mean(C("inv")).alias("all_invariant"), mean(C("aff") & C("inv")).alias("all_six"))


@query("a28_bidirectional_flip", f"WITH {FAMILY}, j AS (SELECT x.family // 2 AS pair, {'x.base = x.expected_base'} AND y.edited = y.expected_edited AS flip FROM fam x JOIN fam y USING (family) WHERE x.cond = 'true' AND y.cond = 'swapped'), p AS (SELECT pair, bool_and(flip) AS both_ways FROM j GROUP BY pair) SELECT count(*) AS pairs, sum(both_ways::INT)::BIGINT AS strict_flips FROM p")
def a28(t, spark):
    f = families(t, spark)
    x = f.where("cond = 'true'").select("family", (C("base") == C("expected_base")).alias("x"))
    y = f.where("cond = 'swapped'").select("family", (C("edited") == C("expected_edited")).alias("y"))
    p = x.join(y, "family").groupBy(F.floor(C("family") / 2).alias("pair")).agg(F.bool_and(C("x") & C("y")).alias("both"))
    return p.agg(F.count("*").alias("pairs"), F.count_if("both").alias("strict_flips"))


@query("b1_point_estimates", f"WITH {EVAL} SELECT task, b - a AS diff, count(*) AS n FROM ev GROUP BY ALL")
def b1_points(t, spark):
    """The histogram of differences from which the intervals are drawn."""
    return results(t).groupBy("task", (C("b") - C("a")).alias("diff")).agg(F.count("*").alias("n"))


@query("b1_paired_bootstrap", None)
def b1(t, spark):
    return st.paired_bootstrap(results(t), "task", "a", "b")


@query("b2_macro_interval", None)
def b2(t, spark):
    """Interval of the macro mean: tasks are drawn inside and averaged with equal weight."""
    import numpy as np
    import pandas as pd

    hist = results(t).groupBy("task", (C("b") - C("a")).cast("double").alias("diff")).count()

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        rng, out = np.random.default_rng(42), 0.0
        tasks = sorted(pdf["task"].unique())
        for k in tasks:
            x = pdf[pdf["task"] == k].sort_values("diff")
            n = x["count"].to_numpy()
            out = out + rng.multinomial(n.sum(), n / n.sum(), size=10_000) @ x["diff"].to_numpy() / n.sum() / len(tasks)
        return pd.DataFrame({"tasks": [len(tasks)], "mean": [float(np.mean(out))], "low": [float(np.quantile(out, 0.025))], "high": [float(np.quantile(out, 0.975))]})

    return hist.groupBy().applyInPandas(draw, "tasks long, mean double, low double, high double")


@query("b3_cluster_bootstrap", None)
def b3(t, spark):
    return st.cluster_bootstrap(pair_diffs(t), "source", "d")


@query("b3_cluster_means", f"WITH {EVAL} SELECT source, round(avg(b - a), 9) AS mean, count(*) AS n FROM ev GROUP BY source")
def b3_means(t, spark):
    return pair_diffs(t).groupBy("source").agg(F.round(F.avg("d"), 9).alias("mean"), F.count("*").alias("n"))


@query("b4_crossed_bootstrap", None)
def b4(t, spark):
    return st.crossed_bootstrap(pair_diffs(t), "source", "task", "d")


@query("b5_paired_t", f"WITH {EVAL}, s AS (SELECT task, doc_id % 5 AS seed, avg(b) - avg(a) AS d FROM ev GROUP BY ALL) SELECT task, round(avg(d), 9) AS mean, round(avg(d) - 2.7764451051977987 * stddev_samp(d) / sqrt(5), 9) AS low, round(avg(d) + 2.7764451051977987 * stddev_samp(d) / sqrt(5), 9) AS high, count(*) AS n FROM s GROUP BY task HAVING count(*) = 5")
def b5(t, spark):
    s = results(t).groupBy("task", (C("doc_id") % 5).alias("seed")).agg((F.avg("b") - F.avg("a")).alias("d"))
    got = st.paired_t(s, ["task"], "d").where("n = 5")
    return got.select("task", *(F.round(x, 9).alias(x) for x in ("mean", "low", "high")), "n")


@query("b7_auroc", f"WITH {EVAL}, p AS (SELECT * FROM ev WHERE target = 1), n AS (SELECT * FROM ev WHERE target = 0) SELECT p.task, round(avg(CASE WHEN p.n_chars > n.n_chars THEN 1.0 WHEN p.n_chars = n.n_chars THEN 0.5 ELSE 0 END), 9) AS auroc FROM p JOIN n USING (task) GROUP BY p.task")
def b7(t, spark):
    got = st.auroc(results(t).select("task", "n_chars", (C("target") == 1).alias("pos")), "n_chars", "pos", ["task"])
    return got.select("task", F.round("auroc", 9).alias("auroc"))


@query("b6_auroc_bootstrap", None)
def b6(t, spark):
    """Stratified: positives and negatives are drawn apart, as counts of each distinct score."""
    import numpy as np
    import pandas as pd

    at = results(t).groupBy("task", "n_chars").agg(F.count_if(C("target") == 1).alias("p"), F.count_if(C("target") == 0).alias("n"))

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n_chars")
        p, n, rng, out = pdf["p"].to_numpy(), pdf["n"].to_numpy(), np.random.default_rng(42), []
        if p.sum() and n.sum():
            for _ in range(1000):
                a, b = rng.multinomial(p.sum(), p / p.sum()), rng.multinomial(n.sum(), n / n.sum())
                out.append(a @ (np.cumsum(b) - b / 2) / (p.sum() * n.sum()))
        low, high = (np.quantile(out, 0.025), np.quantile(out, 0.975)) if out else (None, None)
        return pd.DataFrame({"task": [pdf["task"].iloc[0]], "low": [low], "high": [high]})

    return at.groupBy("task").applyInPandas(draw, "task string, low double, high double")


@query("b8_wilson_precision", f"""WITH {EVAL}, k AS (SELECT task, target FROM ev QUALIFY row_number() OVER (PARTITION BY task ORDER BY n_chars DESC, doc_id) <= 20), s AS (SELECT task, sum(target)::DOUBLE AS h, count(*)::DOUBLE AS n FROM k GROUP BY task)
SELECT task, round(h / n, 9) AS precision_at_k, round((h / n + 3.8414588206941254 / (2 * n)) / (1 + 3.8414588206941254 / n) - 1.959963984540054 / (1 + 3.8414588206941254 / n) * sqrt(h / n * (1 - h / n) / n + 3.8414588206941254 / (4 * n * n)), 9) AS low FROM s""")
def b8(t, spark):
    from siltstone.operators.sampling import stratified_first

    k = stratified_first(results(t), ["task"], [F.desc("n_chars"), C("doc_id")], 20)
    s = k.groupBy("task").agg(F.sum("target").cast("double").alias("h"), F.count("*").cast("double").alias("n"))
    return s.select("task", F.round(C("h") / C("n"), 9).alias("precision_at_k"), F.round(st.wilson(C("h"), C("n"))[0], 9).alias("low"))


@query("b9_group_mean_bootstrap", None)
def b9(t, spark):
    return st.paired_bootstrap(results(t).withColumn("zero", F.lit(0)), "source", "zero", "b", 2000)


@query("b10_pareto", "SELECT p_partkey, p_size, p_retailprice FROM part p WHERE NOT EXISTS (SELECT 1 FROM part q WHERE q.p_size <= p.p_size AND q.p_retailprice >= p.p_retailprice AND (q.p_size < p.p_size OR q.p_retailprice > p.p_retailprice))")
def b10(t, spark):
    return st.frontier(t("part").select("p_partkey", "p_size", "p_retailprice"), "p_partkey", "p_size", "p_retailprice")


@query("b11_above_chance", f"WITH {EVAL}, k AS (SELECT task, source, avg(a - 0.5) AS m FROM ev GROUP BY ALL) SELECT task, count(*) AS clusters, round(avg(m), 9) AS above_chance FROM k GROUP BY task")
def b11(t, spark):
    k = results(t).groupBy("task", "source").agg(F.avg(C("a") - 0.5).alias("m"))
    return k.groupBy("task").agg(F.count("*").alias("clusters"), F.round(F.avg("m"), 9).alias("above_chance"))


@query("b12_condition_difference", f"WITH {FAMILY}, d AS (SELECT x.task, (x.base = x.expected_base)::INT - (y.base = y.expected_base)::INT AS d FROM fam x JOIN fam y USING (family) WHERE x.cond = 'true' AND y.cond = 'blank') SELECT task, round(avg(d), 9) AS mean, count(*) AS n FROM d GROUP BY task")
def b12(t, spark):
    f = families(t, spark).select("family", "task", "cond", (C("base") == C("expected_base")).cast("int").alias("ok"))
    x, y = f.where("cond = 'true'").select("family", "task", C("ok").alias("x")), f.where("cond = 'blank'").select("family", C("ok").alias("y"))
    return x.join(y, "family").groupBy("task").agg(F.round(F.avg(C("x") - C("y")), 9).alias("mean"), F.count("*").alias("n"))


@query("b13_condition_interval", None)
def b13(t, spark):
    f = families(t, spark).select("family", "cond", (C("base") == C("expected_base")).cast("int").alias("ok"))
    d = f.where("cond = 'true'").select("family", C("ok").alias("x")).join(f.where("cond = 'blank'").select("family", C("ok").alias("y")), "family")
    return st.cluster_bootstrap(d.select("family", (C("x") - C("y")).cast("double").alias("d")), "family", "d")


@query("prior_exposure", f"WITH {EVAL} SELECT task, round(avg(a) FILTER (seen), 9) AS acc_seen, round(avg(a) FILTER (NOT seen), 9) AS acc_new FROM (SELECT ev.*, doc_id IN (SELECT min(doc_id) FROM documents GROUP BY source) AS seen FROM ev) GROUP BY task")
def prior(t, spark):
    """Accuracy on items that an older set holds, and on the others."""
    old = co.small(t("documents").groupBy("source").agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.lit(True).alias("seen")))
    rows = results(t).join(old, "doc_id", "left")
    return rows.groupBy("task").agg(F.round(F.avg(F.when(C("seen"), C("a"))), 9).alias("acc_seen"), F.round(F.avg(F.when(C("seen").isNull(), C("a"))), 9).alias("acc_new"))
