"""Resumable ingest: file-source streams with a checkpoint, and first-seen dedup across restarts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions import text as tx


def stream_files(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def ingest(source: DataFrame, target: str, checkpoint: str) -> int:
    """Append what is new since the checkpoint to a Parquet folder, exactly once per file, then stop. Rows written."""
    query = source.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(p["numInputRows"] for p in query.recentProgress)


def ingest_some(source: DataFrame, target: str, checkpoint: str, batches: int) -> int:
    """As ingest, but asked to stop once `batches` micro-batches are committed or nothing is new. What was under way at the
    stop is not committed, and the next run over the checkpoint takes it up. Micro-batches seen."""
    import time

    query = source.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).start()
    try:
        while True:
            done = sum(p["numInputRows"] > 0 for p in query.recentProgress)
            idle = query.recentProgress and not query.status["isDataAvailable"] and not query.status["isTriggerActive"]
            if query.exception():
                raise query.exception()
            if done >= batches or idle:
                return done
            time.sleep(0.05)
    finally:
        query.stop()


#: A batch of at most so many rows is sent to the tasks that read older digests.
SMALL_BATCH = 20_000
#: So many blocks of digests are merged into one of the next level.
MERGE = 16


def _digests(spark: SparkSession, target: str, level: int, first: int) -> str:
    """Path of the digests that the batches first .. first + MERGE^level - 1 accepted: of one batch its own folder, of more a
    merged folder beside the target, written if it is not there. Batches behind a later one never change, so it stays true."""
    if not level:
        return f"{target}/batch={first}"
    path = f"{target.rstrip('/')}-digests/level={level}/first={first}"
    if not _exists(spark, f"{path}/_SUCCESS"):
        parts = [_digests(spark, target, level - 1, first + k * MERGE ** (level - 1)) for k in range(MERGE)]
        _read(spark, parts).coalesce(1).write.mode("overwrite").parquet(path)
    return path


def _read(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.schema("digest string").parquet(*[p for p in paths if _exists(spark, p)])


def _older(spark: SparkSession, target: str, number: int) -> DataFrame | None:
    """Digests of all batches before `number`: at most MERGE - 1 folders of each level; None without any."""
    level = 0
    while MERGE ** (level + 1) <= number:
        level += 1
    paths, at = [], 0
    for k in range(level, -1, -1):
        size = MERGE**k
        while at + size <= number:
            paths.append(_digests(spark, target, k, at))
            at += size
    paths = [p for p in paths if _exists(spark, p)]
    return _read(spark, paths) if paths else None


def ingest_distinct(source: DataFrame, target: str, checkpoint: str, key: str = "text", order: str = "doc_id") -> list[dict]:
    """As ingest, but only texts not seen before: each micro-batch keeps the first row of each digest and anti-joins
    the digests already written. The accepted table is the only state (merged digests beside it can be made again), so a
    repeated batch is harmless: batches write to a folder of their own. Returns progress by batch.

    A batch reads all older digests once, from few files, and only those that it holds itself are met with its rows."""
    progress: list[dict] = []

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        n = df.count()
        hint = F.broadcast if n <= SMALL_BATCH else (lambda x: x)
        # A batch of few rows is dealt once, to one task.
        rows = (df.coalesce(1) if n <= SMALL_BATCH else df).withColumn("digest", F.sha2(tx.normalized(F.col(key)), 256))
        old, fresh_rows = _older(spark, target, number), rows
        if old is not None:
            met = old.join(hint(rows.select("digest")), "digest", "left_semi").distinct()
            fresh_rows = rows.join(hint(met), "digest", "left_anti").select(*rows.columns)
        firsts = fresh_rows.groupBy("digest").agg(F.min_by(F.struct(*rows.columns), order).alias("r")).select("r.*")
        kept = Observation()
        firsts.observe(kept, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{target}/batch={number}")
        progress.append({"batch": number, "seen": n, "accepted": kept.get["n"]})

    query = source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return progress


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
