"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Each rule is a predicate over features of the text. On a bounded sample (`SAMPLE_ROWS` distinct texts, the lowest
hashes of a hash share of all rows) one job takes, for every text and rule, the rule's verdict and the nanoseconds that
its expression needs inside the task, given the text's words; of `REPEATS` readings the least counts, so that neither
planning nor compilation is charged to a rule. The order is greedy: next comes the rule that rejects most of the texts
that the rules before it leave, per second that it needs for those texts. Costs are rounded to powers of two, and ties
keep the order in which rules are declared. The verdict is one CASE that stops at the first rule that rejects a row.
The order changes only the time taken: a row is kept when no rule rejects it.

A word is a run of characters other than ASCII white space. Repeated windows are found inside the row: the
3-word windows are hashed; only where two hashes agree are the windows sorted and compared as text.

Edge cases: null text has no words and counts as empty, so it is rejected as too short; repeated rows each get
their own verdict; an empty table gives an empty result; only the columns named are read, so extra columns
cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.scratch import fresh
from siltstone.llm.common import stored

WORD = r"[^\x20\x09-\x0D]+"
MIN_WORDS, REPEAT_PERCENT, WINDOW_WORDS = 50, 50, 3
SAMPLE_ROWS, REPEATS = 500, 3


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and use it as often as needed."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def word_list(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(WORD))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def repeat_words(words: Column, width: int = WINDOW_WORDS) -> Column:
    """Words inside windows of `width` words that occur twice or more in the row."""
    n = F.size(words)

    def hashed(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(width))))

    def covered(w: Column, h: Column) -> Column:
        rows = F.transform(h, lambda x, i: F.struct(x.alias("h"), F.array_join(F.slice(w, i + 1, width), " ").alias("w"), i.alias("i")))

        def starts(s: Column) -> Column:
            same = lambda a, b: F.coalesce((a["h"] == b["h"]) & (a["w"] == b["w"]), F.lit(False))
            twice = F.filter(s, lambda x, j: same(x, F.get(s, j - 1)) | same(x, F.get(s, j + 1)))
            return F.array_sort(F.transform(twice, lambda x: x["i"]))

        ahead = lambda p: F.transform(p, lambda x, k: F.least(F.lit(width), F.coalesce(F.get(p, k + 1) - x, F.lit(width))))
        return let(F.sort_array(rows), lambda s: let(starts(s), lambda p: F.aggregate(ahead(p), F.lit(0), lambda a, x: a + x)))

    counted = let(hashed(words), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(words, h)))
    return F.when(n < width, F.lit(0)).otherwise(counted).cast("long")


def with_features(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    t = F.coalesce(F.col(text), F.lit(""))
    (words,) = fresh(df.columns, "words")
    return (
        df.withColumn(words, word_list(F.col(text)))
        .withColumn("n_words", F.size(words).cast("long"))
        .withColumn("word_chars", F.length(F.array_join(words, "")).cast("long"))
        .withColumn("n_symbols", F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long"))
        .withColumn("n_dup_lines", dup_lines(F.col(text)))
        .withColumn("n_repeat_words", repeat_words(F.col(words)))
        .drop(words)
    )


#: Rules by name: features (name -> Column) to a predicate that is true where the row is rejected.
RULES: dict[str, Callable[[dict[str, Column]], Column]] = {
    "short": lambda f: f["n_words"] < MIN_WORDS,
    "repetitive": lambda f: 100 * f["n_repeat_words"] > REPEAT_PERCENT * f["n_words"],
    "symbols": lambda f: 10 * f["n_symbols"] > f["n_words"],
    "repeated_lines": lambda f: 10 * f["n_dup_lines"] > 5 * f["n_lines"],
    "word_length": lambda f: (f["word_chars"] > 20 * f["n_words"]) | (f["word_chars"] < 2 * f["n_words"]),
}


def text_features(text: Column, words: Column) -> dict[str, Column]:
    """Every feature as an expression of its own over the text and its words, so that a rule costs only what it needs."""
    t = F.coalesce(text, F.lit(""))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_lines": line_count(text),
        "n_dup_lines": dup_lines(text),
        "n_repeat_words": repeat_words(words),
    }


def line_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(WORD))).cast("long")


def timings(df: DataFrame, text: str = "text", rules=RULES, rows: int = SAMPLE_ROWS, repeats: int = REPEATS) -> list[list[tuple[int, bool]]]:
    """For each sampled text, (nanoseconds, rejected) of every rule in turn; `rows` texts at most."""
    share = max(1, df.count() // (2 * rows))
    t, h = F.col(text), F.xxhash64(text)
    few = df.where(F.pmod(h, F.lit(share)) == 0).groupBy(h.alias("h")).agg(F.first(t).alias("t")).orderBy("h").limit(rows)
    now = F.expr("java_method('java.lang.System', 'nanoTime')")

    def read(words: Column) -> Column:
        features = text_features(F.col("t"), words)
        return F.array(*(F.struct(now.alias("began"), F.coalesce(rule(features), F.lit(False)).alias("hit"), now.alias("ended")) for rule in rules.values()))

    sample = stored(few.repartition(8, "h"), "rules")
    again = sample.select("h", "t", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("again")).select("h", "again", let(word_list(F.col("t")), read).alias("x"))
    one = again.select("h", "again", F.posexplode("x").alias("rule", "x")).groupBy("h", "rule").agg(F.min(F.col("x.ended").cast("long") - F.col("x.began").cast("long")).alias("ns"), F.max("x.hit").alias("hit"))
    found: dict[int, list] = {}
    for r in one.orderBy("h", "rule").collect():
        found.setdefault(r["h"], []).append((r["ns"], r["hit"]))
    return list(found.values())


def greedy(names: list[str], read: list[list[tuple[int, bool]]]) -> list[tuple[str, float, float]]:
    """(rule, seconds, share rejected) in the order chosen; both of the texts that the rules before leave."""
    left, out, todo = read, [], list(range(len(names)))
    while todo:
        facts = []
        for k in todo:
            seconds = sum(x[k][0] for x in left) / 1e9
            hits = sum(x[k][1] for x in left)
            cost = 2.0 ** round(math.log2(seconds)) if seconds > 0 else 1e-9
            facts.append((-hits / cost, k, seconds, hits / len(left) if left else 0.0))
        _, k, seconds, rejected = min(facts)
        out.append((names[k], seconds, rejected))
        todo.remove(k)
        left = [x for x in left if not x[k][1]]
    return out


def measure(df: DataFrame, text: str = "text", rules=RULES, rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """(rule, seconds, share rejected) by rejections per second, each given the rules before it."""
    return greedy(list(rules), timings(df, text, rules, rows))


def rejected_by(order: list[str], features: dict[str, Column], rules=RULES) -> Column:
    """The first rule of the order that rejects, null where none does; no later rule is evaluated."""
    out = None
    for name in order:
        out = F.when(rules[name](features), name) if out is None else out.when(rules[name](features), name)
    return F.lit(None).cast("string") if out is None else out


def quality_cascade(df: DataFrame, text: str = "text", rules=RULES, name: str = "kept", order: list[str] | None = None) -> DataFrame:
    """All columns of df and the boolean `name`."""
    order = order or [x[0] for x in measure(df, text, rules)]
    t = F.col(text)
    return df.withColumn(name, let(word_list(t), lambda w: rejected_by(order, text_features(t, w), rules).isNull()))


def quality_report(df: DataFrame, keep: list[str], text: str = "text", rules=RULES) -> DataFrame:
    """`keep` columns, the features, base_failed, kept, and rejected_by, the cascade's first rule that rejects. Features of
    the report are there for every row; the cascade itself computes only what is not among them (n_lines), where reached."""
    order = [x[0] for x in measure(df, text, rules)]
    out = with_features(df.select(*keep, text), text)
    features = {k: F.col(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")} | {"n_lines": line_count(F.col(text))}
    base = RULES["short"](features) | RULES["repetitive"](features)
    first = rejected_by(order, features, rules)
    named = out.select(*keep, *list(features)[:5], base.alias("base_failed"), first.alias("rejected_by"))
    return named.select(*keep, *list(features)[:5], "base_failed", (F.col("rejected_by").isNull() & ~F.col("base_failed")).alias("kept"), "rejected_by")
