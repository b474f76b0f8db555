"""Pair datasets: dimension joins, exclusions, best rows, stratified choices, folds, matchings, mixtures, sets.

The star tables stand in for annotations: lineitem rows are boxes, part and supplier are dimensions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.functions.hashing import stable_hash
from siltstone.operators import corpus as co
from siltstone.operators import pairs as pr
from siltstone.operators import sampling as sa
from siltstone.plans.base import query

C = F.col


def h(*parts):
    return stable_hash(F.lit("s1"), *(C(p) for p in parts))


H = lambda *p: "sha256('s1|' || " + " || '|' || ".join(p) + ")"


@query("j7_dimension_lookup", "SELECT coalesce(p_brand, 'unmatched') AS brand, count(*) AS n FROM lineitem LEFT JOIN part ON CASE WHEN l_linenumber = 7 THEN -l_partkey ELSE l_partkey END = p_partkey GROUP BY 1")
def j7(t, spark):
    """The seventh lines of an order name a part that the dimension does not have."""
    dim = co.small(t("part").select("p_partkey", "p_brand"))
    fact = t("lineitem").select(F.when(C("l_linenumber") == 7, -C("l_partkey")).otherwise(C("l_partkey")).alias("p_partkey"))
    return fact.join(dim, "p_partkey", "left").groupBy(F.coalesce("p_brand", F.lit("unmatched")).alias("brand")).agg(F.count("*").alias("n"))


@query("j8_fact_metadata", "SELECT o_orderpriority, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY 1")
def j8(t, spark):
    orders = t("orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_orderpriority")
    return t("lineitem").join(orders, C("l_orderkey") == C("o_orderkey")).groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query("j9_exclusion", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def j9(t, spark):
    used = t("orders").where("o_totalprice > 300000").select(C("o_custkey").alias("c_custkey"))
    return t("customer").join(used, "c_custkey", "left_anti").select("c_custkey")


@query("j12_overlap", f"WITH d AS (SELECT doc_id, {H('text')} AS x FROM documents) SELECT count(DISTINCT a.x) AS shared FROM d a JOIN d b USING (x) WHERE a.doc_id % 2 = 0 AND b.doc_id % 2 = 1")
def j12(t, spark):
    d = t("documents").select("doc_id", h("text").alias("x"))
    return d.where("doc_id % 2 = 0").select("x").intersect(d.where("doc_id % 2 = 1").select("x")).agg(F.count("*").alias("shared"))


@query("j13_split_disjoint", "WITH s AS (SELECT l_partkey AS k, l_returnflag AS split FROM lineitem GROUP BY ALL) SELECT a.split AS split_a, b.split AS split_b, count(*) AS shared FROM s a JOIN s b ON a.k = b.k AND a.split < b.split GROUP BY 1, 2")
def j13(t, spark):
    s = t("lineitem").select(C("l_partkey").alias("k"), C("l_returnflag").alias("split")).distinct()
    a, b = s.withColumnRenamed("split", "split_a"), s.withColumnRenamed("split", "split_b")
    return a.join(b, "k").where("split_a < split_b").groupBy("split_a", "split_b").agg(F.count("*").alias("shared"))


@query("j15_decisions", "SELECT s_suppkey, s_nationkey FROM supplier WHERE s_suppkey % 3 <> 1")
def j15(t, spark):
    """Manifest and decisions must hold the same ids; accepted rows stay."""
    decisions = t("supplier").select(C("s_suppkey").alias("k"), F.when(C("s_suppkey") % 3 == 1, "reject").otherwise("accept").alias("decision"))
    both = t("supplier").join(decisions, C("s_suppkey") == C("k"), "full_outer")
    if both.where("s_suppkey IS NULL OR k IS NULL").limit(1).count():
        raise ValueError("manifest and decisions hold different ids")
    return both.where("decision = 'accept'").select("s_suppkey", "s_nationkey")


@query("j16_event_alignment", "SELECT a.step, a.n AS clicks, b.n AS views FROM (SELECT event_id // 200 AS step, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1) a JOIN (SELECT event_id // 200 AS step, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1) b USING (step)")
def j16(t, spark):
    tag = lambda k, n: t("events").where(C("event_type") == k).groupBy(F.floor(C("event_id") / 200).alias("step")).agg(F.count("*").alias(n))
    return tag("click", "clicks").join(tag("view", "views"), "step")


@query("j17_pair_by_rank", f"""WITH a AS (SELECT p_brand AS cls, p_partkey AS a_id, row_number() OVER (PARTITION BY p_brand ORDER BY {H("p_partkey")}) AS rn FROM part WHERE p_size % 2 = 0), b AS (SELECT p_brand AS cls, p_partkey AS b_id, row_number() OVER (PARTITION BY p_brand ORDER BY {H("p_partkey")}) AS rn FROM part WHERE p_size % 2 = 1)
SELECT cls, rn::INT AS rn, a_id, b_id FROM a JOIN b USING (cls, rn)""")
def j17(t, spark):
    side = lambda odd, name: t("part").where(C("p_size") % 2 == odd).select(C("p_brand").alias("cls"), C("p_partkey").alias(name))
    return sa.pair_by_rank(side(0, "a_id"), side(1, "b_id"), ["cls"], h("a_id"), h("b_id"))


@query("j18_greedy_match", """WITH RECURSIVE l AS (SELECT p_brand AS cls, p_partkey AS a, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part WHERE p_size % 2 = 0),
r AS (SELECT p_brand AS cls, list(p_partkey) AS free FROM part WHERE p_size % 2 = 1 GROUP BY 1),
m AS (SELECT cls, 0::BIGINT AS rn, NULL::BIGINT AS a_id, NULL::BIGINT AS b_id, free FROM r
UNION ALL SELECT cls, rn, a, pick, list_filter(free, lambda x: x <> pick) FROM (SELECT m.cls, l.rn, l.a, m.free, string_split(list_min(list_transform(m.free, lambda x: sha256(l.a || '|' || x) || '|' || x)), '|')[2]::BIGINT AS pick FROM m JOIN l ON l.cls = m.cls AND l.rn = m.rn + 1 WHERE m.rn < 20 AND len(m.free) > 0))
SELECT cls, a_id, b_id FROM m WHERE rn > 0""")
def j18(t, spark):
    side = lambda odd, name: t("part").where(C("p_size") % 2 == odd).select(C("p_brand").alias("cls"), C("p_partkey").alias(name))
    return sa.greedy_match(side(0, "a_id"), side(1, "b_id"), "cls", "a_id", "b_id", 20)


@query("j19_control", f"WITH x AS (SELECT c.c_custkey, s.s_suppkey, row_number() OVER (PARTITION BY c.c_custkey ORDER BY {H('c.c_custkey', 's.s_suppkey')}) AS r FROM customer c JOIN supplier s ON c.c_nationkey = s.s_nationkey WHERE s.s_suppkey % 7 <> 0) SELECT c_custkey, s_suppkey FROM x WHERE r = 1")
def j19(t, spark):
    """The row of least hash from the pool of the same class, excluded ids left out."""
    pool = t("supplier").where("s_suppkey % 7 <> 0").select("s_suppkey", "s_nationkey")
    return sa.least_of_pool(t("customer").select("c_custkey", "c_nationkey"), pool, "c_custkey", "c_nationkey", "s_suppkey", "s_nationkey", "s1")


BOX = "(SELECT l_orderkey, l_linenumber, l_partkey, l_discount * 2 AS x1, least(l_discount * 2 + l_tax * 5 + 0.01, 1.2) AS x2, l_tax * 4 AS y1, l_tax * 4 + l_quantity / 100 AS y2 FROM lineitem)"


def boxes(t):
    d, x, q = C("l_discount"), C("l_tax"), C("l_quantity")
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (d * 2).alias("x1"), F.least(d * 2 + x * 5 + 0.01, F.lit(1.2)).alias("x2"), (x * 4).alias("y1"), (x * 4 + q / 100).alias("y2"))


@query("p20_box_geometry", f"""SELECT l_orderkey, l_linenumber, printf('%.6f', x1) || ',' || printf('%.6f', y1) AS key, round((x2 - x1) * (y2 - y1), 9) AS area, floor(least((y1 + y2) / 2, 0.999999) * 14)::BIGINT * 14 + floor(least((x1 + x2) / 2, 0.999999) * 14)::BIGINT AS patch,
round(greatest(x1 - (x2 - x1) * 0.1, 0), 9) AS ex1, round(least(x2 + (x2 - x1) * 0.1, 1), 9) AS ex2 FROM {BOX} WHERE x1 >= 0 AND y1 >= 0 AND x2 <= 1 AND y2 <= 1 AND x1 < x2 AND y1 < y2""")
def p20(t, spark):
    """Valid boxes: key, area, centre patch of a 14 x 14 grid, expanded and clipped sides."""
    valid = boxes(t).where("x1 >= 0 AND y1 >= 0 AND x2 <= 1 AND y2 <= 1 AND x1 < x2 AND y1 < y2")
    w = C("x2") - C("x1")
    cell = lambda a, b: F.floor(F.least((C(a) + C(b)) / 2, F.lit(0.999999)) * 14)
    return valid.select(
        "l_orderkey", "l_linenumber", F.format_string("%.6f,%.6f", "x1", "y1").alias("key"), F.round(w * (C("y2") - C("y1")), 9).alias("area"), (cell("y1", "y2") * 14 + cell("x1", "x2")).alias("patch"),
        F.round(F.greatest(C("x1") - w * 0.1, F.lit(0.0)), 9).alias("ex1"), F.round(F.least(C("x2") + w * 0.1, F.lit(1.0)), 9).alias("ex2"),
    )


GRID = f"(SELECT l_orderkey, l_linenumber, floor(x1 * 14)::BIGINT AS cx, floor(y1 * 14)::BIGINT AS cy, (l_orderkey + l_linenumber) % 14 AS px, l_orderkey % 14 AS py, floor(least(x2, 0.999) * 14)::BIGINT AS dx, floor(least(y2, 0.999) * 14)::BIGINT AS dy FROM {BOX})"


def grid(t):
    f = lambda c: F.floor(c * 14)
    return boxes(t).select(
        "l_orderkey", "l_linenumber", f(C("x1")).alias("cx"), f(C("y1")).alias("cy"), ((C("l_orderkey") + C("l_linenumber")) % 14).alias("px"), (C("l_orderkey") % 14).alias("py"),
        f(F.least(C("x2"), F.lit(0.999))).alias("dx"), f(F.least(C("y2"), F.lit(0.999))).alias("dy"),
    )


@query("p26_grid_targets", f"SELECT l_orderkey, l_linenumber, greatest(abs(px - cx), abs(py - cy)) AS error, greatest(abs(px - cx), abs(py - cy)) <= 1 AS within_one, px BETWEEN cx AND dx AND py BETWEEN cy AND dy AS inside FROM {GRID}")
def p26(t, spark):
    error = F.greatest(F.abs(C("px") - C("cx")), F.abs(C("py") - C("cy")))
    inside = C("px").between(C("cx"), C("dx")) & C("py").between(C("cy"), C("dy"))
    return grid(t).select("l_orderkey", "l_linenumber", error.alias("error"), (error <= 1).alias("within_one"), inside.alias("inside"))


@query("a26_point_metrics", f"WITH g AS (SELECT *, l_orderkey % 4 = 0 AS stopped, greatest(abs(px - cx), abs(py - cy)) AS e FROM {GRID}) SELECT l_linenumber, count(*) AS n, round(avg((NOT stopped)::INT), 9) AS pointed, round(avg(CASE WHEN NOT stopped THEN (e = 0)::INT END), 9) AS exact, round(avg(CASE WHEN stopped THEN 14 ELSE e END), 9) AS mean_error FROM g GROUP BY 1")
def a26(t, spark):
    """Point or stop: a miss counts as an error of 14."""
    error = F.greatest(F.abs(C("px") - C("cx")), F.abs(C("py") - C("cy")))
    g = grid(t).select("l_linenumber", (C("l_orderkey") % 4 == 0).alias("stopped"), error.alias("e"))
    mean = lambda c: F.round(F.avg(c), 9)
    return g.groupBy("l_linenumber").agg(F.count("*").alias("n"), mean((~C("stopped")).cast("int")).alias("pointed"), mean(F.when(~C("stopped"), (C("e") == 0).cast("int"))).alias("exact"), mean(F.when(C("stopped"), 14).otherwise(C("e"))).alias("mean_error"))


@query("p27_patch_action", f"""WITH g AS (SELECT *, [px / 4, py / 4, l_linenumber / 2, 1.5]::DOUBLE[] AS logits, (l_orderkey % 10) / 10 AS gain FROM {GRID}), p AS (SELECT *, list_max(logits) AS top FROM g)
SELECT l_orderkey, l_linenumber, round(greatest(cx / 14 - 1 / 14, 0), 9) AS x1, round(greatest(cy / 14 - 1 / 14, 0), 9) AS y1, round(least((cx + 1) / 14 + 1 / 14, 1), 9) AS x2, round(least((cy + 1) / 14 + 1 / 14, 1), 9) AS y2,
CASE WHEN gain >= 0.3 AND 1 / list_sum(list_transform(logits, lambda x: exp(x - top))) >= 0.4 THEN list_position(logits, top)::INT - 1 ELSE 3 END AS action FROM p""")
def p27(t, spark):
    """A patch's crop, and which of three patches a router would look at, if any."""
    g = grid(t)
    box = pr.crop_box(C("cy") * 14 + C("cx"), 14)
    logits = F.array(C("px") / 4, C("py") / 4, C("l_linenumber") / 2, F.lit(1.5))
    rows = g.select("l_orderkey", "l_linenumber", box.alias("b"), pr.evidence_action(logits, (C("l_orderkey") % 10) / 10, 0.3, 0.4).alias("action"))
    return rows.select("l_orderkey", "l_linenumber", *(F.round(C("b")[k], 9).alias(k) for k in ("x1", "y1", "x2", "y2")), "action")


@query("p28_scene_query", "SELECT p_partkey, (p_size * 7) % 10 < (p_size * 3) % 10 AS left_of, list_count(list_filter([p_size % 3, (p_size + 1) % 3, (p_size * 2) % 3], lambda x: x = 1)) AS ones, p_size % 3 = (p_size * 2) % 3 AS same FROM part")
def p28(t, spark):
    """A scene is a map from object to position and colour; queries compare places, match colours and count."""
    s = C("p_size")
    obj = lambda n, x, c: F.struct(F.lit(n).alias("key"), F.struct(x.alias("x"), c.alias("c")).alias("value"))
    scene = F.map_from_entries(F.array(obj("a", s * 7 % 10, s % 3), obj("b", s * 3 % 10, (s + 1) % 3), obj("c", s, s * 2 % 3)))
    m = t("part").select("p_partkey", scene.alias("m"))
    at = lambda k: C("m")[k]
    return m.select("p_partkey", (at("a")["x"] < at("b")["x"]).alias("left_of"), F.size(F.filter(F.map_values("m"), lambda v: v["c"] == 1)).cast("long").alias("ones"), (at("a")["c"] == at("c")["c"]).alias("same"))


@query("p24_learning_rate", "SELECT step, round(CASE WHEN step < 172 THEN 4e-5 ELSE 4e-6 + 0.5 * (4e-5 - 4e-6) * (1 + cos(pi() * (step - 172) / (2000 - 1 - 172))) END, 15) AS rate FROM (SELECT unnest(range(2000)) AS step)")
def p24(t, spark):
    """Hold, then cosine, over 2000 steps."""
    cosine = F.lit(4e-6) + 0.5 * (4e-5 - 4e-6) * (1 + F.cos(F.lit(3.141592653589793) * (C("id") - 172) / (2000 - 1 - 172)))
    return spark.range(2000).select(C("id").alias("step"), F.round(F.when(C("id") < 172, F.lit(4e-5)).otherwise(cosine), 15).alias("rate"))


@query("p8_flatten_strings", "SELECT o_orderkey, concat_ws(' ' || chr(10) || ' ', o_orderstatus, 'x' || o_custkey, o_orderpriority, o_orderstatus || '!', 'm' || o_orderkey) AS flat FROM orders")
def p8(t, spark):
    """All string leaves of a nested value, in order, whatever its schema."""
    status = C("o_orderstatus")
    inner = F.struct(F.concat(F.lit("x"), C("o_custkey").cast("string")).alias("b"), C("o_custkey").alias("number"))
    nested = F.struct(status.alias("s"), F.array(inner).alias("a"), F.array(C("o_orderpriority"), F.concat(status, F.lit("!"))).alias("l"), F.create_map(F.lit("key"), F.concat(F.lit("m"), C("o_orderkey").cast("string"))).alias("m"))
    rows = t("orders").select("o_orderkey", nested.alias("v"))
    return rows.select("o_orderkey", F.array_join(pr.string_leaves(C("v"), rows.schema["v"].dataType), " \n ").alias("flat"))


LIMITS = {"min_width": 0.08, "max_width": 0.35, "min_height": 0.15, "min_area": 0.03, "min_bbox_height_to_width": 1.2}
POSTURE = "l_linenumber % 5 = 0 AND l_partkey % 3 = 0"


@query("f17_geometry_reasons", f"""WITH b AS (SELECT *, ['Man', 'Woman', 'Boy', 'Dog'][l_partkey % 4 + 1] AS cls, CASE WHEN l_linenumber = 3 THEN 'Sit' ELSE 'Stand' END AS attr, CASE WHEN {POSTURE} THEN 'A man Kneeling' WHEN l_partkey % 11 = 0 THEN 'a close-up' ELSE 'a street' END AS txt FROM {BOX})
SELECT CASE WHEN cls = 'Dog' THEN 'non_target_class' WHEN attr <> 'Stand' THEN 'non_standing_attribute' WHEN txt = 'A man Kneeling' THEN 'ambiguous_posture_term' WHEN txt = 'a close-up' THEN 'obvious_truncation_context_term'
WHEN x2 - x1 < 0.08 THEN 'small_width' WHEN x2 - x1 > 0.35 THEN 'excessive_width_closeup_risk' WHEN y2 - y1 < 0.15 THEN 'small_height' WHEN (x2 - x1) * (y2 - y1) < 0.03 THEN 'small_area' WHEN (y2 - y1) / (x2 - x1) < 1.2 THEN 'short_bbox_aspect' ELSE 'pass' END AS reason, count(*) AS n FROM b GROUP BY 1""")
def f17(t, spark):
    cls = F.get(F.array(*map(F.lit, ("Man", "Woman", "Boy", "Dog"))), (C("l_partkey") % 4).cast("int"))
    attr = F.when(C("l_linenumber") == 3, "Sit").otherwise("Stand")
    txt = F.when(F.expr(POSTURE), "A man Kneeling").when(C("l_partkey") % 11 == 0, "a close-up").otherwise("a street")
    reason = pr.geometry_reason(cls, attr, txt, C("x2") - C("x1"), C("y2") - C("y1"), ("Man", "Woman", "Boy"), "Stand", LIMITS)
    return boxes(t).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("f18_metadata_gate", """WITH m AS (SELECT o_orderstatus AS subset, o_orderpriority AS licence, CASE WHEN o_custkey % 10 = 0 THEN '' ELSE 'a' || o_custkey END AS author, CASE WHEN o_custkey % 17 = 0 THEN NULL ELSE 'https://x/' || o_orderkey END AS url,
['0.0', '', '90', 'left'][o_orderkey % 4 + 1] AS rotation, CASE WHEN o_custkey % 3 = 0 THEN 'Old Paintings of it' ELSE 'a screenplay' END AS title FROM orders)
SELECT CASE WHEN subset <> 'O' THEN 'wrong_subset' WHEN licence NOT LIKE '%HIGH' THEN 'license_rejection' WHEN author = '' OR url IS NULL THEN 'missing_attribution' WHEN rotation = 'left' THEN 'invalid_rotation' WHEN rotation = '90' THEN 'nonzero_rotation'
WHEN title LIKE 'Old%' THEN 'secondary_media_title' ELSE 'pass' END AS reason, count(*) AS n FROM m GROUP BY 1""")
def f18(t, spark):
    k, c = C("o_orderkey"), C("o_custkey")
    licence = F.when(C("o_orderpriority").endswith("HIGH"), "free").otherwise("other")
    author = F.when(c % 10 == 0, "").otherwise(F.concat(F.lit("a"), c.cast("string")))
    url = F.when(c % 17 != 0, F.concat(F.lit("https://x/"), k.cast("string")))
    rotation = F.get(F.array(*map(F.lit, ("0.0", "", "90", "left"))), (k % 4).cast("int"))
    title = F.when(c % 3 == 0, "Old Paintings of it").otherwise("a screenplay")
    reason = pr.metadata_reason(C("o_orderstatus"), licence, author, url, rotation, title, "O", "free")
    return t("orders").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("f22_metric_gate", "SELECT l_shipmode_like AS cell, avg_q >= 25.4 AND n >= 100 AND avg_d <= 0.051 AS passed FROM (SELECT l_suppkey % 20 AS l_shipmode_like, avg(l_quantity) AS avg_q, count(*) AS n, avg(l_discount) AS avg_d FROM lineitem GROUP BY 1)")
def f22(t, spark):
    m = t("lineitem").groupBy((C("l_suppkey") % 20).alias("cell")).agg(F.avg("l_quantity").alias("q"), F.count("*").alias("n"), F.avg("l_discount").alias("d"))
    return m.select("cell", ((C("q") >= 25.4) & (C("n") >= 100) & (C("d") <= 0.051)).alias("passed"))


@query("w2_best_row", "SELECT l_partkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) = 1")
def w2(t, spark):
    rows = t("lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return sa.best_row(rows, ["l_partkey"], F.struct(-C("l_extendedprice"), C("l_orderkey"), C("l_linenumber"))).select("l_partkey", "l_orderkey", "l_linenumber")


@query("w3_stratified_topk", f"SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY {H('doc_id')})::INT AS rank FROM documents QUALIFY rank <= 12")
def w3(t, spark):
    got = sa.stratified_first(t("documents").select("lang", "doc_id"), ["lang"], [h("doc_id")], 12)
    if got.groupBy("lang").count().where("count < 12").limit(1).count():
        raise ValueError("a stratum is below its quota")
    return got


@query("w4_bottom_k", f"SELECT doc_id FROM documents ORDER BY {H('doc_id')} LIMIT 100")
def w4(t, spark):
    return t("documents").select("doc_id").orderBy(h("doc_id")).limit(100)


@query("w5_priority_sample", "WITH d AS (SELECT doc_id, source, n_chars >= 500 AS accepted, sha256(text) AS x FROM documents) SELECT doc_id, source, accepted FROM d QUALIFY row_number() OVER (PARTITION BY source, accepted ORDER BY x, doc_id) <= CASE WHEN accepted THEN 40 ELSE 20 END")
def w5(t, spark):
    rows = t("documents").select("doc_id", "source", (C("n_chars") >= 500).alias("accepted"), F.sha2("text", 256).alias("x"))
    got = sa.stratified_first(rows, ["source", "accepted"], [C("x"), C("doc_id")], 40)
    return got.where(C("accepted") | (C("rank") <= 20)).select("doc_id", "source", "accepted")


@query("w6_ranked", f"SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, {H('c_custkey')})::INT AS place FROM customer")
def w6(t, spark):
    w = Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), h("c_custkey"))
    return t("customer").select("c_mktsegment", "c_custkey", F.row_number().over(w).alias("place"))


@query("w7_scarcest_class", f"WITH x AS (SELECT l_orderkey, l_linenumber, l_suppkey % 9 AS cls, count(*) OVER (PARTITION BY l_suppkey % 9) AS n FROM lineitem) SELECT l_orderkey, l_linenumber FROM x QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY n, cls, {H('l_orderkey', 'l_linenumber')}) = 1")
def w7(t, spark):
    """One target per image: scarcest class first, then least hash. Class counts are a join, not a window over classes."""
    rows = t("lineitem").select("l_orderkey", "l_linenumber", (C("l_suppkey") % 9).alias("cls"))
    n = co.small(rows.groupBy("cls").agg(F.count("*").alias("n")))
    got = rows.join(n, "cls")
    return sa.best_row(got, ["l_orderkey"], F.struct(C("n"), C("cls"), h("l_orderkey", "l_linenumber"))).select("l_orderkey", "l_linenumber")


@query("w8_preferred_size", f"SELECT l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY round(abs(ln(l_quantity) - ln(20)), 9), {H('l_orderkey', 'l_linenumber')}) = 1")
def w8(t, spark):
    off = F.round(F.abs(F.log("l_quantity") - F.log(F.lit(20.0))), 9)
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return sa.best_row(rows, ["l_orderkey"], F.struct(off, h("l_orderkey", "l_linenumber"))).select("l_orderkey", "l_linenumber")


@query("w14_folds", """WITH RECURSIVE st AS (SELECT p_brand AS name, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS k FROM part GROUP BY 1),
rec AS (SELECT 0::BIGINT AS k, ''::VARCHAR AS name, [0, 0, 0, 0, 0]::BIGINT[] AS loads, [0, 0, 0, 0, 0]::BIGINT[] AS caps
UNION ALL SELECT k, name, list_transform(range(1, 6), lambda i: loads[i] + caps[i]), caps FROM (SELECT k, name, loads, list_transform(range(5), lambda f: n // 5 + list_contains(list_transform(light[1:(n % 5)], lambda x: right(x, 1)::BIGINT), f)::BIGINT) AS caps
FROM (SELECT st.k, st.name, st.n, rec.loads, list_sort(list_transform(range(5), lambda f: lpad(rec.loads[f + 1]::VARCHAR, 18, '0') || sha256('7' || chr(31) || 'extra-fold' || chr(31) || st.name || chr(31) || f) || f)) AS light FROM rec JOIN st ON st.k = rec.k + 1))),
s AS (SELECT name, f, caps[f + 1] AS cap, sum(caps[f + 1]) OVER (PARTITION BY name ORDER BY sha256('7' || chr(31) || 'slot-order' || chr(31) || name || chr(31) || f)) AS high FROM (SELECT name, caps, unnest(range(5)) AS f FROM rec WHERE k > 0)),
p AS (SELECT p_partkey::VARCHAR AS pair_id, p_brand AS class_name, row_number() OVER (PARTITION BY p_brand ORDER BY sha256('7' || chr(31) || 'pair-rank' || chr(31) || p_brand || chr(31) || p_partkey)) AS r FROM part)
SELECT pair_id, class_name, f::INT AS fold FROM p JOIN s ON class_name = name AND r > high - cap AND r <= high""")
def w14(t, spark):
    return sa.assign_folds(t("part").select(C("p_partkey").cast("string").alias("pair_id"), C("p_brand").alias("class_name")), "pair_id", "class_name", 5, 7)


@query("w16_rotation", """WITH r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part), q AS (SELECT *, i // 2 AS cluster, p_partkey // 2 AS image FROM r WHERE n >= 4),
s AS (SELECT a.p_brand, (b.i - a.i + a.n) % a.n AS shift, bool_or(a.cluster = b.cluster OR a.image = b.image) AS bad FROM q a JOIN q b ON a.p_brand = b.p_brand AND a.i <> b.i GROUP BY ALL),
least_ AS (SELECT p_brand, min(shift) AS shift FROM s WHERE NOT bad GROUP BY 1)
SELECT a.p_partkey, b.p_partkey AS donor FROM q a JOIN least_ USING (p_brand) JOIN q b ON a.p_brand = b.p_brand AND b.i = (a.i + shift) % a.n""")
def w16(t, spark):
    """Rotated by the least shift at which no row's donor is of its own cluster (here two rows in order) or image."""
    w = Window.partitionBy("p_brand")
    rows = t("part").select("p_brand", "p_partkey", F.count("*").over(w).alias("n"), F.floor((F.row_number().over(w.orderBy("p_partkey")) - 1) / 2).alias("cluster"), F.floor(C("p_partkey") / 2).alias("image"))
    return pr.deranged_donors(rows.where("n >= 4"), ["p_brand"], "p_partkey", "cluster", "image").select("p_partkey", "donor")


@query("w17_best_under_gate", "SELECT l_suppkey % 10 AS grp, l_orderkey, l_linenumber FROM lineitem WHERE l_discount <= 0.05 QUALIFY row_number() OVER (PARTITION BY l_suppkey % 10 ORDER BY l_quantity DESC, l_tax DESC, l_orderkey, l_linenumber) = 1")
def w17(t, spark):
    rows = t("lineitem").where("l_discount <= 0.05").withColumn("grp", C("l_suppkey") % 10)
    best = F.max_by(F.struct("l_orderkey", "l_linenumber"), F.struct(C("l_quantity"), C("l_tax"), -C("l_orderkey"), -C("l_linenumber")))
    return rows.groupBy("grp").agg(best.alias("r")).select("grp", "r.*")


@query("w18_ranked_split", f"WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {H('doc_id')}) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT doc_id, lang, CASE WHEN i < floor(n * 0.7) THEN 'train' WHEN i < floor(n * 0.85) THEN 'dev' ELSE 'test' END AS split FROM r")
def w18(t, spark):
    return sa.ranked_split(t("documents").select("doc_id", "lang"), ["lang"], h("doc_id"), [("train", 0.7), ("dev", 0.15), ("test", 0.15)])


@query("w19_unique_hash_sample", "SELECT sha256(text) AS x, min(doc_id) AS doc_id FROM documents GROUP BY 1 ORDER BY 1 LIMIT 50")
def w19(t, spark):
    return t("documents").groupBy(F.sha2("text", 256).alias("x")).agg(F.min("doc_id").alias("doc_id")).orderBy("x").limit(50)


FAMILY = "coalesce(lower(list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/'), lambda x: x <> '')[1]), '')"


@query("w20_family_quota", f"SELECT page_id, {FAMILY} AS family FROM pages QUALIFY row_number() OVER (PARTITION BY {FAMILY} ORDER BY sha256(url), page_id) <= 10")
def w20(t, spark):
    from siltstone.functions.text import path_family

    rows = t("pages").select("page_id", path_family(C("url")).alias("family"), F.sha2("url", 256).alias("x"))
    return sa.stratified_first(rows, ["family"], [C("x"), C("page_id")], 10).select("page_id", "family")


@query("w21_complete_groups", "WITH g AS (SELECT l_orderkey, dense_rank() OVER (ORDER BY l_orderkey) AS place FROM lineitem GROUP BY l_orderkey HAVING count(*) = 4) SELECT l_orderkey, l_linenumber FROM lineitem JOIN g USING (l_orderkey) WHERE place <= 200")
def w21(t, spark):
    """The first 200 groups, by id, that have exactly four rows."""
    whole = t("lineitem").groupBy("l_orderkey").count().where("count = 4").select("l_orderkey").orderBy("l_orderkey").limit(200)
    return t("lineitem").select("l_orderkey", "l_linenumber").join(whole, "l_orderkey", "left_semi")


@query("w22_interleaved_heads", "WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256(text), doc_id) AS rn FROM documents) SELECT doc_id, source, (row_number() OVER (ORDER BY rn, source))::INT AS pos FROM r WHERE rn <= 40")
def w22(t, spark):
    """The first 40 of each source by hash, one source after the other."""
    rows = t("documents").select("doc_id", "source", F.sha2("text", 256).alias("x"))
    heads = sa.stratified_first(rows, ["source"], [C("x"), C("doc_id")], 40)
    return heads.select("doc_id", "source", F.row_number().over(Window.orderBy("rank", "source")).alias("pos"))


@query("s16_round_robin", """WITH s AS (SELECT source, (row_number() OVER (ORDER BY source) - 1) % 4 + 1 AS w FROM (SELECT DISTINCT source FROM documents)), o AS (SELECT *, sum(w) OVER (ORDER BY source) - w AS first FROM s),
r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS rn FROM documents) SELECT doc_id, source, rn // w AS cycle, (first + rn % w)::INT AS place FROM r JOIN o USING (source)""")
def s16(t, spark):
    """All sources of the table, with weights of 1 to 4 in the order of their names."""
    rows = t("documents").select("doc_id", "source")
    names = sorted(r[0] for r in rows.select("source").distinct().collect() if r[0] is not None)
    return sa.interleave(rows, "source", "doc_id", {n: i % 4 + 1 for i, n in enumerate(names)})


@query("m1_quotas", "WITH w AS (SELECT lang, count(*) / sum(count(*)) OVER () AS share FROM documents GROUP BY lang), q AS (SELECT lang, floor(share * 96900)::BIGINT AS base, share * 96900 - floor(share * 96900) AS rest FROM w) SELECT lang, base + (row_number() OVER (ORDER BY rest DESC, lang) <= 96900 - sum(base) OVER ())::INT::BIGINT AS quota FROM q")
def m1(t, spark):
    n = t("documents").groupBy("lang").count()
    total = n.agg(F.sum("count")).first()[0]
    return sa.quotas(n.select("lang", (C("count") / F.lit(total)).alias("share")), "lang", "share", 96_900)


U = "('0x' || substr(sha256('mix|' || doc_id), 1, 12))::BIGINT / 281474976710656.0::DOUBLE"


@query("m2_weighted_mixture", f"SELECT doc_id, CASE WHEN u < 0.425 THEN 'web' WHEN u < 0.85 THEN 'dclm' WHEN u < 0.88 THEN 'math' ELSE 'code' END AS component FROM (SELECT doc_id, {U} AS u FROM documents)")
def m2(t, spark):
    """Each row draws its component from its own hash."""
    u = F.conv(F.substring(stable_hash(F.lit("mix"), C("doc_id")), 1, 12), 16, 10).cast("long") / float(1 << 48)
    rows = t("documents").select("doc_id", u.alias("u"))
    return rows.select("doc_id", F.when(C("u") < 0.425, "web").when(C("u") < 0.85, "dclm").when(C("u") < 0.88, "math").otherwise("code").alias("component"))


@query("m3_sample_order", f"WITH r AS (SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY {H('doc_id')}) <= 60) SELECT doc_id, lang, (row_number() OVER (ORDER BY sha256('o|' || doc_id)))::INT AS pos FROM r")
def m3(t, spark):
    """Without replacement: least hashes per component, then one order by a second hash."""
    rows = sa.stratified_first(t("documents").select("doc_id", "lang"), ["lang"], [h("doc_id")], 60).drop("rank")
    return rows.withColumn("pos", F.row_number().over(Window.orderBy(stable_hash(F.lit("o"), C("doc_id")))))


@query("m4_composition", "WITH n AS (SELECT lang, sum(n_chars)::BIGINT AS have FROM documents GROUP BY lang) SELECT lang, have, (ceil(400000 * 1.1 / 2049) * 2049)::BIGINT AS wanted, greatest((ceil(400000 * 1.1 / 2049) * 2049)::BIGINT - have, 0) AS refill FROM n")
def m4(t, spark):
    wanted = F.lit(-(-int(400_000 * 1.1) // 2049) * 2049).cast("long")
    n = t("documents").groupBy("lang").agg(F.sum("n_chars").alias("have"))
    return n.select("lang", "have", wanted.alias("wanted"), F.greatest(wanted - C("have"), F.lit(0).cast("long")).alias("refill"))


@query("m5_hash_modulo_split", f"SELECT doc_id, (row_number() OVER (ORDER BY {H('doc_id')}) - 1) % 10 = 0 AS dev FROM documents")
def m5(t, spark):
    """Train or dev by place in the hash order. Places are prefix counts within the first hash byte, then over them."""
    rows = t("documents").select("doc_id", h("doc_id").alias("x")).withColumn("b", F.conv(F.substring("x", 1, 4), 16, 10).cast("long"))
    counts = rows.groupBy("b").count()
    base = counts.select("b", F.coalesce(F.sum("count").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    local = F.row_number().over(Window.partitionBy("b").orderBy("x")) - 1
    return rows.withColumn("i", local).join(base, "b").select("doc_id", ((C("base") + C("i")) % 10 == 0).alias("dev"))


@query("m6_repeat_passes", "SELECT vec_id, pass FROM embeddings, (SELECT unnest(range(3)) AS pass)")
def m6(t, spark):
    return t("embeddings").select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(2)).cast("array<bigint>")).alias("pass"))


@query("m7_validation_sample", f"SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY {H('doc_id')}) <= 12")
def m7(t, spark):
    return sa.stratified_first(t("documents").select("source", "doc_id"), ["source"], [h("doc_id")], 12).drop("rank")


@query("m8_spec_grid", "SELECT split, challenge, idx, sha256('s1|' || split || '|' || challenge || '|' || idx) AS spec FROM (SELECT unnest(['train', 'dev']) AS split), (SELECT unnest(['count', 'left', 'same']) AS challenge), (SELECT unnest(range(50)) AS idx)")
def m8(t, spark):
    each = lambda *xs: F.explode(F.array(*(F.lit(x) for x in xs)))
    specs = spark.range(50).withColumnRenamed("id", "idx").withColumn("split", each("train", "dev")).withColumn("challenge", each("count", "left", "same"))
    return specs.select("split", "challenge", "idx", h("split", "challenge", "idx").alias("spec"))


@query("m9_balanced_batches", "WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY sha256('e1|' || doc_id)) - 1 AS i FROM labels), c AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM labels GROUP BY quality)) SELECT doc_id, quality, i // 8 AS batch FROM r, c WHERE i < n // 8 * 8")
def m9(t, spark):
    """Half of each batch from either class; the smaller class sets the number of batches."""
    rows = t("labels").select("doc_id", "quality")
    least = rows.groupBy("quality").count().agg(F.min("count")).first()[0] or 0
    i = F.row_number().over(Window.partitionBy("quality").orderBy(stable_hash(F.lit("e1"), C("doc_id")))) - 1
    return rows.withColumn("i", i).where(C("i") < least // 8 * 8).select("doc_id", "quality", F.floor(C("i") / 8).alias("batch"))


@query("m10_group_shuffle", "SELECT conv_id, turn, (dense_rank() OVER (ORDER BY sha256('g|' || conv_id)))::INT AS place FROM conversations")
def m10(t, spark):
    """Groups shuffled as a whole; rows keep their order inside."""
    groups = t("conversations").select("conv_id").distinct().withColumn("x", stable_hash(F.lit("g"), C("conv_id")))
    placed = co.prefix_sums(groups, "x", F.lit(1), "before").select("conv_id", (C("before") + 1).cast("int").alias("place"))
    return t("conversations").select("conv_id", "turn").join(placed, "conv_id")


@query("u1_union", "SELECT pool, count(*) AS n FROM (SELECT 'documents' AS pool, text FROM documents UNION ALL SELECT 'benchmark', text FROM benchmark) GROUP BY pool")
def u1(t, spark):
    pools = [t(name).select(F.lit(name).alias("pool"), "text") for name in ("documents", "benchmark")]
    return pools[0].unionByName(pools[1]).groupBy("pool").agg(F.count("*").alias("n"))


@query("u2_set_union", "SELECT doc_id FROM documents UNION SELECT doc_id FROM labels")
def u2(t, spark):
    return t("documents").select("doc_id").union(t("labels").select("doc_id")).distinct()


@query("u3_set_equality", "SELECT (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT ALL SELECT doc_id FROM documents)) AS only_left, (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels)) AS only_right")
def u3(t, spark):
    a, b = t("labels").select("doc_id"), t("documents").select("doc_id")
    both = a.exceptAll(b).select(F.lit(True).alias("left")).union(b.exceptAll(a).select(F.lit(False)))
    return both.agg(F.count_if("left").alias("only_left"), F.count_if(~C("left")).alias("only_right"))


@query("u4_except", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def u4(t, spark):
    return t("documents").select("doc_id").subtract(t("labels").select("doc_id"))


@query("u5_sorted_unique", "SELECT DISTINCT n_chars // 10 AS v FROM documents ORDER BY v")
def u5(t, spark):
    return t("documents").select(F.floor(C("n_chars") / 10).alias("v")).distinct().orderBy("v")


@query("p21_difference_hash", """WITH g AS (SELECT vec_id, list_transform(range(72), lambda i: (vec_id * 31 + i * i * 17) % 251) AS px FROM embeddings),
b AS (SELECT vec_id, list_reduce(list_prepend(0::HUGEINT, list_transform(range(64), lambda k: (px[k // 8 * 9 + k % 8 + 1] > px[k // 8 * 9 + k % 8 + 2])::INT::HUGEINT)), lambda a, b: a * 2 + b) AS v FROM g)
SELECT vec_id, (CASE WHEN v >= 9223372036854775808 THEN v - 18446744073709551616 ELSE v END)::BIGINT AS dhash FROM b""")
def p21(t, spark):
    """Gradient bits of 8 rows of 9 grey values, which are made up: decoding images is left out."""
    px = F.transform(F.sequence(F.lit(0), F.lit(71)), lambda i: (C("vec_id") * 31 + i * i * 17) % 251)
    return t("embeddings").select("vec_id", px.alias("px")).select("vec_id", pr.difference_hash(C("px")).alias("dhash"))


@query("p23_pose_summary", """WITH k AS (SELECT vec_id, [embedding[1], embedding[2]] AS a, [embedding[3], embedding[4]] AS b, [embedding[5], embedding[6]] AS c FROM embeddings), v AS (SELECT vec_id, a[1] - b[1] AS ux, a[2] - b[2] AS uy, c[1] - b[1] AS wx, c[2] - b[2] AS wy FROM k)
SELECT vec_id, round(degrees(acos(greatest(-1, least(1, (ux::DOUBLE * wx + uy::DOUBLE * wy) / sqrt((ux::DOUBLE * ux + uy::DOUBLE * uy) * (wx::DOUBLE * wx + wy::DOUBLE * wy)))))), 2) AS angle, abs(uy) > abs(ux) AS upright FROM v""")
def p23(t, spark):
    """Angle at the middle of three key points, and whether the first limb is nearer to the vertical."""
    e = lambda i: C("embedding")[i]
    v = t("embeddings").select("vec_id", (e(0) - e(2)).alias("ux"), (e(1) - e(3)).alias("uy"), (e(4) - e(2)).alias("wx"), (e(5) - e(3)).alias("wy"))
    d = lambda n: C(n).cast("double")
    cosine = (d("ux") * d("wx") + d("uy") * d("wy")) / F.sqrt((d("ux") * d("ux") + d("uy") * d("uy")) * (d("wx") * d("wx") + d("wy") * d("wy")))
    return v.select("vec_id", F.round(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))), 2).alias("angle"), (F.abs("uy") > F.abs("ux")).alias("upright"))
