"""Paired alignment, ranking statistics and resampled intervals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def align(left: DataFrame, right: DataFrame, key: list[str], checks: list[str]) -> DataFrame:
    """Strict one-to-one join: raises unless keys are unique, equal on both sides, and the check columns agree."""
    for df, side in ((left, "left"), (right, "right")):
        if df.groupBy(*key).count().where("count > 1").limit(1).count():
            raise ValueError(f"repeated keys on the {side}")
    a = left.select(*key, F.struct(*checks, "value").alias("l"))
    b = right.select(*key, F.struct(*checks, "value").alias("r"))
    both = a.join(b, key, "full_outer")
    wrong = F.col("l").isNull() | F.col("r").isNull()
    for c in checks:
        wrong = wrong | ~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    if both.where(wrong).limit(1).count():
        raise ValueError("the result sets do not align")
    return both.select(*key, *(F.col(f"l.{c}").alias(c) for c in checks), F.col("l.value").alias("left_value"), F.col("r.value").alias("right_value"))


def auroc(df: DataFrame, score: str, positive: str, by: list[str]) -> DataFrame:
    """Area under the curve with half credit for ties, from counts for each distinct score; groups of one class have none."""
    at = df.groupBy(*by, score).agg(F.sum(F.col(positive).cast("long")).alias("p"), F.sum((~F.col(positive)).cast("long")).alias("n"))
    w = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    below = at.withColumn("below", F.coalesce(F.sum("n").over(w), F.lit(0)))
    total = below.groupBy(*by).agg(F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)).alias("u"), F.sum("p").alias("np"), F.sum("n").alias("nn"))
    return total.where("np > 0 AND nn > 0").select(*by, (F.col("u") / (F.col("np") * F.col("nn"))).alias("auroc"))


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    p, zz = hits / n, z * z
    mid = (p + zz / (2 * n)) / (1 + zz / n)
    half = z / (1 + zz / n) * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))
    return mid - half, mid + half


#: Two-sided 95 % points of Student's t for 1 to 4 degrees of freedom.
T95 = {1: 12.706204736432095, 2: 4.302652729911275, 3: 3.182446305284263, 4: 2.7764451051977987}


def paired_t(df: DataFrame, by: list[str], value: str) -> DataFrame:
    table = F.create_map(*(F.lit(x) for kv in T95.items() for x in kv))
    got = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count("*").alias("n"))
    half = F.try_element_at(table, (F.col("n") - 1).cast("int")) * F.col("sd") / F.sqrt("n")
    return got.select(*by, "mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"), "n")


def frontier(df: DataFrame, key: str, cost: str, score: str) -> DataFrame:
    """Rows that no other row beats: at most its cost, at least its score, and one of them better.

    A row is beaten by a better score at a lower cost, or by a better score at its own cost; one window over the
    distinct costs, not a self-join."""
    at = df.groupBy(cost).agg(F.max(score).alias("top"))
    before = Window.orderBy(cost).rowsBetween(Window.unboundedPreceding, -1)
    best = at.withColumn("best", F.max("top").over(before))
    return df.join(best, cost).where((F.col(score) == F.col("top")) & (F.col("best").isNull() | (F.col("best") < F.col(score)))).select(key, cost, score)


def _interval(values: np.ndarray, level: float) -> tuple[float, float]:
    return float(np.quantile(values, (1 - level) / 2)), float(np.quantile(values, (1 + level) / 2))


def paired_bootstrap(pairs: DataFrame, by: str, left: str, right: str, draws: int = 10_000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """by, n, mean, low, high of the mean difference. Spark reduces each group to a histogram of differences; the
    draws are multinomial over it, so a group costs its distinct differences and not its rows."""
    hist = pairs.groupBy(by, (F.col(right) - F.col(left)).cast("double").alias("diff")).count()

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("diff")
        d, n = pdf["diff"].to_numpy(), pdf["count"].to_numpy()
        got = np.random.default_rng(seed).multinomial(n.sum(), n / n.sum(), size=draws) @ d / n.sum()
        low, high = _interval(got, level)
        return pd.DataFrame({by: [pdf[by].iloc[0]], "n": [int(n.sum())], "mean": [float(d @ n / n.sum())], "low": [low], "high": [high]})

    kind = pairs.schema[by].dataType.simpleString()
    return hist.groupBy(by).applyInPandas(draw, f"{by} {kind}, n long, mean double, low double, high double")


def cluster_bootstrap(df: DataFrame, cluster: str, value: str, draws: int = 2000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """clusters, mean, low, high of the mean of cluster means; clusters of equal mean are drawn together."""
    means = df.groupBy(cluster).agg(F.avg(value).alias("m")).groupBy("m").count()

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("m")
        m, n = pdf["m"].to_numpy(), pdf["count"].to_numpy()
        got = np.random.default_rng(seed).multinomial(n.sum(), n / n.sum(), size=draws) @ m / n.sum()
        low, high = _interval(got, level)
        return pd.DataFrame({"clusters": [int(n.sum())], "mean": [float(m @ n / n.sum())], "low": [low], "high": [high]})

    return means.groupBy().applyInPandas(draw, "clusters long, mean double, low double, high double")


def crossed_bootstrap(df: DataFrame, row: str, column: str, value: str, draws: int = 2000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """Rows and columns are both drawn with replacement; cells are the means by (row, column), absent cells left out."""
    cells = df.groupBy(F.col(row).alias("r"), F.col(column).alias("c")).agg(F.avg(value).alias("m"))

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = pdf.pivot(index="r", columns="c", values="m").sort_index().sort_index(axis=1).to_numpy()
        rng, have = np.random.default_rng(seed), ~np.isnan(grid)
        full, out = np.nan_to_num(grid), np.empty(draws)
        for k in range(draws):
            a = np.bincount(rng.integers(0, len(grid), len(grid)), minlength=len(grid))
            b = np.bincount(rng.integers(0, grid.shape[1], grid.shape[1]), minlength=grid.shape[1])
            out[k] = a @ full @ b / max(1, a @ have @ b)
        low, high = _interval(out, level)
        return pd.DataFrame({"rows": [len(grid)], "columns": [grid.shape[1]], "mean": [float(np.nanmean(grid))], "low": [low], "high": [high]})

    return cells.groupBy().applyInPandas(draw, "rows long, columns long, mean double, low double, high double")
