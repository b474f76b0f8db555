"""File sources and sinks: listings, verified scans, ledgers, shards and receipts. Paths are read by Spark only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.scratch import fresh, stored


def file_table(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """path, length, sha256 of every file below path, found recursively."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", "length", F.sha2("content", 256).alias("sha256"))


def listing(files: DataFrame, prefix: str, seed: int) -> DataFrame:
    """Pinned listing: names with the prefix, in the order of a seeded hash; fails when empty."""
    rows = files.where(F.col("name").startswith(prefix))
    if not rows.limit(1).count():
        raise ValueError(f"no file starts with {prefix!r}")
    order = F.sha2(F.concat(F.lit(f"{seed}|"), F.col("name")), 256)
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(order)))


def verified(files: DataFrame, expected: DataFrame) -> DataFrame:
    """Files whose length and digest are as expected (name, length, sha256); fails if there is none."""
    rows = files.join(expected, ["name", "length", "sha256"], "left_semi")
    if not rows.limit(1).count():
        raise ValueError("no verified file")
    return rows


def arrow_file(path: str):
    """(file system, path in it) as pyarrow opens them; raises where it has no such file system."""
    from pyarrow import fs

    scheme, colon, rest = path.partition(":")
    if not colon or scheme == "file":
        return fs.LocalFileSystem(), "/" + (rest if colon else path).lstrip("/")
    return fs.FileSystem.from_uri(path)


def row_groups(spark: SparkSession, path: str) -> DataFrame:
    """path, number, first, rows of every row group below path, from the footers alone."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq

        for batch in batches:
            for file in batch.column("path").to_pylist():
                system, name = arrow_file(file)
                meta = pq.read_metadata(name, filesystem=system)
                rows = [meta.row_group(i).num_rows for i in range(meta.num_row_groups)]
                yield pa.RecordBatch.from_pydict(
                    {"path": [file] * len(rows), "number": range(len(rows)), "first": [sum(rows[:i]) for i in range(len(rows))], "rows": rows},
                    pa.schema([("path", pa.string()), ("number", pa.int32()), ("first", pa.int64()), ("rows", pa.int64())]),
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    return files.select("path").mapInArrow(run, "path string, number int, first long, rows long")


def rows_after(spark: SparkSession, path: str, cursor: int) -> DataFrame:
    """Rows of Parquet files from the cursor on, by their place in each file, and row_index. Row groups that end before the
    cursor are not read, and each of the others is a task's work. Where pyarrow cannot open the file system, which only
    Spark's readers can then, all are read and a filter drops the rows. Columns from folder names are not given."""
    import pyarrow as pa

    df = spark.read.option("recursiveFileLookup", "true").parquet(path)
    try:
        arrow_file(df.select("_metadata.file_path").limit(1).first()[0] if df.limit(1).count() else "/")
    except (OSError, ValueError, pa.ArrowException):
        return df.select("*", F.col("_metadata.row_index").alias("row_index")).where(F.col("row_index") >= cursor)
    schema = T.StructType([*df.schema.fields, T.StructField("row_index", T.LongType())])
    groups = stored(row_groups(spark, path).where(F.col("first") + F.col("rows") > cursor), "groups")

    def run(batches):
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import to_arrow_schema

        want = to_arrow_schema(schema)
        for batch in batches:
            for g in batch.to_pylist():
                system, name = arrow_file(g["path"])
                at = g["first"]
                with system.open_input_file(name) as file:
                    for part in pq.ParquetFile(file).iter_batches(1024, row_groups=[g["number"]], columns=want.names[:-1]):
                        here, at = at, at + part.num_rows
                        if at > cursor:
                            skip = max(cursor - here, 0)
                            table = pa.Table.from_batches([part.slice(skip)]).append_column("row_index", pa.array(range(here + skip, at), pa.int64()))
                            yield from table.select(want.names).cast(want).to_batches()

    dealt = groups.repartition(max(groups.count(), 1), "path", "number").select("path", "number", "first")
    return dealt.mapInArrow(run, schema)


def admission(files: DataFrame, expected: DataFrame) -> DataFrame:
    """name and status of each expected file (name, length, sha256): complete; partial, where it is shorter and the
    download would go on from there; wrong_size; wrong_digest; missing. Files that nobody expects are left out."""
    got = files.select("name", F.col("length").alias("have"), F.col("sha256").alias("digest"))
    status = (
        F.when(F.col("have").isNull(), "missing")
        .when(F.col("have") < F.col("length"), "partial")
        .when(F.col("have") > F.col("length"), "wrong_size")
        .when(F.col("digest") != F.col("sha256"), "wrong_digest")
        .otherwise("complete")
    )
    return expected.join(got, "name", "left").select("name", status.alias("status"))


#: Files that come with a model's weights.
MODEL_METADATA = [
    "config.json", "generation_config.json", "tokenizer.json", "tokenizer_config.json", "special_tokens_map.json", "added_tokens.json",
    "vocab.json", "merges.txt", "tokenizer.model", "model.safetensors.index.json", "pytorch_model.bin.index.json",
]


def model_files(files: DataFrame, repo: str, name: str) -> DataFrame:
    """Of each repository's listing the files to load, those at its root: safetensors weights, or PyTorch's where there are
    none, and metadata. A repository without weights gives no rows."""
    c = F.col(name)
    kind = F.when(c.endswith(".safetensors"), 2).when(c.rlike(r"^pytorch_model(-\d+-of-\d+)?\.bin$"), 1).when(c.isin(MODEL_METADATA), 0)
    k, best = fresh(files.columns, "kind", "best")
    rows = files.where(~c.contains("/")).withColumn(k, kind).where(F.col(k).isNotNull())
    rows = rows.withColumn(best, F.max(k).over(Window.partitionBy(repo)))
    return rows.where((F.col(best) > 0) & F.col(k).isin(0, F.col(best))).select(*files.columns)


def upsert_ledger(ledger: DataFrame, updates: DataFrame, key: list[str], version: str) -> DataFrame:
    """The latest row of each key."""
    both = ledger.unionByName(updates)
    return both.groupBy(*key).agg(F.max_by(F.struct(*(c for c in both.columns if c not in key)), version).alias("r")).select(*key, "r.*")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines; gz and zst by their endings."""
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str, codec: str = "gzip") -> None:
    df.write.mode("overwrite").option("compression", codec).json(path)


def read_csv_map(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """Two columns of a CSV with a header; fails on repeated keys or missing columns."""
    df = spark.read.csv(path, header=True)
    check_columns(df, [key, value])
    if df.groupBy(key).count().where("count > 1").limit(1).count():
        raise ValueError(f"repeated {key}")
    return df.select(key, value)


def check_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    return df


def write_shards(df: DataFrame, path: str, by: list[str], max_rows: int) -> None:
    """Parquet by the given columns, at most max_rows in a file."""
    df.write.mode("overwrite").option("maxRecordsPerFile", max_rows).partitionBy(*by).parquet(path)


def shard_receipts(df: DataFrame, by: list[str], order: Column, token: str) -> DataFrame:
    """rows and a digest of each shard: the tokens in order. A shard's size is bounded by how it was cut."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col(token).alias("t")))), lambda x: x["t"].cast("string")), ",")
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.sha2(body, 256).alias("sha256"))


def assert_unchanged(before: DataFrame, after: DataFrame) -> None:
    if before.exceptAll(after).limit(1).count() or after.exceptAll(before).limit(1).count():
        raise ValueError("inputs changed")


def write_receipt(spark: SparkSession, path: str, values: dict) -> None:
    """A JSON file by way of a temporary name in the same folder, then a rename."""
    import json

    jvm = spark._jvm
    target, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".part")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(part, True)
    out.write(bytearray(json.dumps(values, sort_keys=True).encode()))
    out.close()
    fs.delete(target, False)
    if not fs.rename(part, target):
        raise OSError(f"rename to {path} failed")


def fetch_blobs(df: DataFrame, payload: str, charset: str, keep: list[str]) -> DataFrame:
    """Gunzip and decode blobs; undecodable bytes fall back to UTF-8 without them, broken blobs drop the row."""
    import pandas as pd

    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField("text", T.StringType())])

    def run(batches):
        import gzip

        for pdf in batches:
            texts = []
            for raw, name in zip(pdf[payload], pdf[charset], strict=True):
                try:
                    data = gzip.decompress(bytes(raw))
                except (OSError, EOFError, TypeError, ValueError):
                    texts.append(None)
                    continue
                try:
                    texts.append(data.decode(name or "utf-8"))
                except (LookupError, UnicodeDecodeError):
                    texts.append(data.decode("utf-8", "ignore"))
            yield pd.concat([pdf[keep].reset_index(drop=True), pd.Series(texts, name="text", dtype=object)], axis=1).dropna(subset=["text"])

    return df.select(*dict.fromkeys([*keep, payload, charset])).mapInPandas(run, schema)


def tar_members(files: DataFrame) -> DataFrame:
    """name, member, length, sha256 of regular members of tar archives given as binary files; unsafe names fail."""

    def run(batches):
        import hashlib
        import io
        import tarfile

        import pandas as pd

        for pdf in batches:
            for name, content in zip(pdf["name"], pdf["content"], strict=True):
                rows = []
                with tarfile.open(fileobj=io.BytesIO(bytes(content))) as tar:
                    for m in tar:
                        if m.name.startswith("/") or ".." in m.name.split("/") or m.issym() or m.islnk():
                            raise ValueError(f"unsafe member {m.name}")
                        if m.isfile():
                            data = tar.extractfile(m).read()
                            rows.append((name, m.name, len(data), hashlib.sha256(data).hexdigest()))
                yield pd.DataFrame(rows, columns=["name", "member", "length", "sha256"])

    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").mapInPandas(run, "name string, member string, length long, sha256 string")
