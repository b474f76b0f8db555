"""Quotas, stratified choices, folds, pairs and matchings by stable hashes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.hashing import stable_hash
from siltstone.functions.scratch import fresh
from siltstone.functions.shipping import ship
from siltstone.operators.corpus import places, prefix_sums, small


def quotas(weights: DataFrame, name: str, weight: str, total: int) -> DataFrame:
    """Largest remainder: floors of weight * total, and one more for the largest remainders (ties by name)."""
    share = F.col(weight) * total
    rows = weights.withColumn("base", F.floor(share).cast("long")).withColumn("rest", share - F.floor(share))
    left = F.lit(total) - F.sum("base").over(Window.partitionBy(F.lit(0)))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("rest"), name))
    return rows.withColumn("extra", (rank <= left).cast("long")).select(name, (F.col("base") + F.col("extra")).alias("quota"))


def stratified_first(df: DataFrame, strata: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each stratum in the given order (a top-k window, which Spark limits before it shuffles)."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*strata).orderBy(*order))).where(F.col("rank") <= k)


def best_row(df: DataFrame, key: list[str], order: Column) -> DataFrame:
    """The row of the least order for each key, by a partial aggregate."""
    return df.groupBy(*key).agg(F.min_by(F.struct(*(F.col(c) for c in df.columns if c not in key)), order).alias("r")).select(*key, "r.*")


def ranked_split(df: DataFrame, strata: list[str], order: Column, cuts: list[tuple[str, float]]) -> DataFrame:
    """split by rank inside each stratum: shares in turn, the last name takes the rest."""
    w = Window.partitionBy(*strata)
    rank = F.row_number().over(w.orderBy(order)) - 1
    n = F.count("*").over(w)
    out, upto = None, 0.0
    for name, share in cuts[:-1]:
        upto += share
        test = F.col("__r") < F.floor(F.col("__n") * round(upto, 9))
        out = F.when(test, name) if out is None else out.when(test, name)
    return df.withColumns({"__r": rank, "__n": n}).withColumn("split", out.otherwise(cuts[-1][0])).drop("__r", "__n")


def pair_by_rank(left: DataFrame, right: DataFrame, on: list[str], order_left: Column, order_right: Column) -> DataFrame:
    """The i-th row of the left with the i-th of the right, within `on`."""
    a = left.withColumn("rn", F.row_number().over(Window.partitionBy(*on).orderBy(order_left)))
    b = right.withColumn("rn", F.row_number().over(Window.partitionBy(*on).orderBy(order_right)))
    return a.join(b, [*on, "rn"])


#: Keys and pool rows that meet in one row of a task.
POOL_KEYS, POOL_ROWS = 512, 4096


def least_of_pool(rows: DataFrame, pool: DataFrame, key: str, group: str, pool_id: str, pool_group: str, seed: str) -> DataFrame:
    """key, pool_id: for each key the pool's row of the same group for which the stable hash of seed, key and id is least.

    Every pair is hashed, but no pair is ever a row: pieces of a group's keys meet pieces of its pool as arrays, dealt evenly
    whatever the groups' sizes, and each piece gives one row per key."""

    def pieces(df: DataFrame, value: str, by: str, most: int, n: str, values: str, texts: str) -> DataFrame:
        largest = df.groupBy(by).count().agg(F.max("count")).first()[0] or 1
        cut = F.pmod(F.xxhash64(value), F.lit(-(-largest // most)))
        each = F.struct(F.col(value).alias("v"), F.col(value).cast("string").alias("t"))
        some = df.groupBy(F.col(by).alias("g"), cut.alias(n)).agg(F.collect_list(each).alias("s"))
        return some.select("g", n, F.col("s.v").alias(values), F.col("s.t").alias(texts))

    ship(rows.sparkSession)
    tasks = 8 * rows.sparkSession.sparkContext.defaultParallelism
    met = pieces(rows, key, group, POOL_KEYS, "a", "keys", "heads").join(pieces(pool, pool_id, pool_group, POOL_ROWS, "b", "ids", "tails"), "g")
    kinds = (rows.schema[key].dataType.simpleString(), pool.schema[pool_id].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        start = seed.encode()
        for whole in batches:
            for r in range(whole.num_rows):
                keys, ids, heads, tails = (whole.column(c)[r] for c in ("keys", "ids", "heads", "tails"))
                ends = [b"" if x is None else b"|" + x.encode() for x in tails.as_py()]
                best = []
                for x in heads.as_py():
                    head = start if x is None else start + b"|" + x.encode()
                    hashes = [sha256(head + end).digest() for end in ends]
                    least = min(hashes)
                    best.append((hashes.index(least), least))
                at = pa.array([j for j, _ in best], pa.int64())
                yield pa.RecordBatch.from_arrays([keys.values, ids.values.take(at), pa.array([h for _, h in best], pa.binary())], names=["k", "i", "h"])

    found = met.select("keys", "ids", "heads", "tails", "g", "a", "b").repartition(tasks, "g", "a", "b").drop("g", "a", "b").mapInArrow(run, f"k {kinds[0]}, i {kinds[1]}, h binary")
    return found.groupBy(F.col("k").alias(key)).agg(F.min_by("i", "h").alias(pool_id))


def fold_slots(sizes: list[tuple[str, int]], folds: int, seed: int) -> list[tuple[str, int, int, int]]:
    """(stratum, fold, first rank, last rank): equal shares per stratum; strata in falling size give remainders to the
    lightest folds. Work and result grow with strata and folds, not with rows."""
    from hashlib import sha256

    digest = lambda *p: sha256("\x1f".join(map(str, p)).encode()).hexdigest()
    loads, out = dict.fromkeys(range(folds), 0), []
    for name, n in sorted(sizes, key=lambda x: (-x[1], x[0])):
        share, rest = n // folds, n % folds
        light = sorted(loads, key=lambda f: (loads[f], digest(seed, "extra-fold", name, f)))[:rest]
        low = 1
        for f in sorted(loads, key=lambda f: digest(seed, "slot-order", name, f)):
            n = share + (f in light)
            if n:
                out.append((name, f, low, low + n - 1))
            low += n
            loads[f] += n
    return out


def assign_folds(df: DataFrame, key: str, stratum: str, folds: int, seed: int) -> DataFrame:
    """key, stratum, fold. The driver sees stratum sizes only; rows get their fold from their hash rank's slot range."""
    sizes = [(r[0], r[1]) for r in df.groupBy(stratum).count().collect()]
    table = df.sparkSession.createDataFrame(fold_slots(sizes, folds, seed), "s string, fold int, low long, high long")
    order = stable_hash(F.lit(seed), F.lit("pair-rank"), F.col(stratum), F.col(key), sep="\x1f")
    ranked = places(df.select(key, stratum, order.alias("x")), stratum, "x", "place").withColumn("rank", F.col("place") + 1)
    return ranked.join(small(table), F.col(stratum).eqNullSafe(F.col("s")) & F.col("rank").between(F.col("low"), F.col("high"))).select(key, stratum, "fold")


def greedy_match(left: DataFrame, right: DataFrame, group: str, left_id: str, right_id: str, cap: int) -> DataFrame:
    """Within a group: each left row in id order takes the unused right row of least hash, up to cap pairs.

    Groups are as small as the contrast that defines them; the step is sequential inside each."""
    from hashlib import sha256

    def match(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        free, out = sorted(b[right_id].tolist()), []
        for x in sorted(a[left_id].tolist()):
            if not free or len(out) >= cap:
                break
            y = min(free, key=lambda v: sha256(f"{x}|{v}".encode()).hexdigest())
            free.remove(y)
            out.append((a[group].iloc[0], x, y))
        return pd.DataFrame(out, columns=[group, left_id, right_id])

    schema = f"{group} {left.schema[group].dataType.simpleString()}, {left_id} long, {right_id} long"
    return left.groupBy(group).cogroup(right.groupBy(group)).applyInPandas(match, schema)


def interleave(df: DataFrame, source: str, order: str, weights: dict[str, int]) -> DataFrame:
    """Weighted round robin of the sources' rows: cycle, place in the cycle. The schedule names each source `weight` times;
    sources that it does not name have no turn."""
    names = list(weights)
    weight = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))
    offset = F.create_map(*(F.lit(x) for i, n in enumerate(names) for x in (n, sum(weights[m] for m in names[:i]))))
    (rn,) = fresh(df.columns, "rn")
    w = F.try_element_at(weight, F.col(source))
    placed = places(df.where(F.col(source).isin(names)), source, order, rn)
    place = (F.try_element_at(offset, F.col(source)) + F.col(rn) % w).cast("int")
    return placed.select(*df.columns, F.floor(F.col(rn) / w).alias("cycle"), place.alias("place"))


def take_turns(df: DataFrame, source: str, order: str, turn: int, name: str) -> DataFrame:
    """Each row's place from 0 where the sources, by name, give `turn` rows at a time until all are used up."""
    rn, key = fresh([*df.columns, name], "rn", "key")
    placed = places(df, source, order, rn).withColumn(key, F.struct(F.floor(F.col(rn) / turn), source, rn))
    return prefix_sums(placed, key, F.lit(1), name).select(*df.columns, name)
