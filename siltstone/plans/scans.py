"""Sources, sinks and streams over copies of the tables in the shared scratch folder."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from siltstone.functions.scratch import scratch_path
from siltstone.operators import sampling as sa
from siltstone.plans.base import query
from siltstone.sources import files
from siltstone.streaming import ingest

C = F.col


def copied(t, spark, name, parts=4):
    path = scratch_path(spark, name)
    t("documents").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id").write.parquet(path)
    return path


@query("s1_pinned_listing", "SELECT count(*) AS rows FROM documents")
def s1(t, spark):
    """Files in a seeded order; all their rows are read."""
    rows = files.listing(files.file_table(spark, copied(t, spark, "listing")), "part-", 42)
    return spark.read.parquet(*[r["path"] for r in rows.orderBy("rank").collect()]).agg(F.count("*").alias("rows"))


@query("s3_row_resume", "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) SELECT doc_id FROM r WHERE i >= 637")
def s3(t, spark):
    path = scratch_path(spark, "resume")
    t("documents").coalesce(1).sortWithinPartitions("doc_id").write.parquet(path)
    return files.rows_after(spark, path, 637).select("doc_id")


@query("s4_source_ledger", "SELECT source AS path, max(doc_id) AS rows_consumed FROM documents GROUP BY source")
def s4(t, spark):
    rows = t("documents").select(C("source").alias("path"), C("doc_id").alias("rows_consumed"))
    return files.upsert_ledger(rows.where("rows_consumed % 2 = 0"), rows.where("rows_consumed % 2 = 1"), ["path"], "rows_consumed")


@query("s5_verified_scan", "SELECT count(*) AS rows, sum(doc_id)::BIGINT AS ids FROM documents")
def s5(t, spark):
    path = copied(t, spark, "verified")
    table = files.file_table(spark, path)
    good = files.verified(table, table.select("name", "length", "sha256"))
    return spark.read.parquet(*[r["path"] for r in good.collect()]).agg(F.count("*").alias("rows"), F.sum("doc_id").alias("ids"))


@query("s6_gzip_jsonl", "SELECT doc_id, sha256(text) AS text_sha256 FROM documents")
def s6(t, spark):
    path = scratch_path(spark, "jsonl")
    files.write_jsonl(t("documents").select("doc_id", "text"), path)
    return files.read_jsonl(spark, path, "doc_id long, text string").select("doc_id", F.sha2("text", 256).alias("text_sha256"))


@query("s8_csv_map", "SELECT n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation")
def s8(t, spark):
    path = scratch_path(spark, "csv")
    t("nation").select("n_name", "n_regionkey").write.csv(path, header=True)
    return files.read_csv_map(spark, path, "n_name", "n_regionkey")


@query("s9_manifest_roundtrip", "SELECT conv_id, count(*) AS turns, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY conv_id")
def s9(t, spark):
    """Nested records to JSON lines and back."""
    path = scratch_path(spark, "manifest")
    nested = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("conversations"))
    files.write_jsonl(nested, path)
    back = files.read_jsonl(spark, path, "conv_id long, conversations array<struct<turn: long, role: string, text: string>>")
    total = F.aggregate("conversations", F.lit(0).cast("long"), lambda a, x: a + F.length(x["text"]))
    return back.select("conv_id", F.size("conversations").cast("long").alias("turns"), total.alias("chars"))


@query("s13_shard_equality", "SELECT source, count(*) AS rows FROM documents GROUP BY source")
def s13(t, spark):
    """Shards of at most 20 rows by source; counts must be those before."""
    path = scratch_path(spark, "shards")
    files.write_shards(t("documents").select("doc_id", "source"), path, ["source"], 20)
    count = lambda df: df.groupBy("source").agg(F.count("*").alias("rows"))
    got = count(spark.read.parquet(path).select(C("source").cast("string").alias("source")))
    files.assert_unchanged(count(t("documents")), got)
    return got


@query("t1_stream_ingest", "SELECT count(*) AS rows, count(DISTINCT doc_id) AS docs FROM documents")
def t1(t, spark):
    """Two runs over one checkpoint: the second finds nothing new."""
    path, out, mark = copied(t, spark, "in"), scratch_path(spark, "out"), scratch_path(spark, "mark")
    for _ in range(2):
        ingest.ingest(ingest.stream_files(spark, path, t("documents").schema), out, mark)
    return spark.read.parquet(out).agg(F.count("*").alias("rows"), F.countDistinct("doc_id").alias("docs"))


@query("t2_stream_dedup", r"SELECT count(DISTINCT trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS accepted FROM documents")
def t2(t, spark):
    path, out, mark = copied(t, spark, "in"), scratch_path(spark, "out"), scratch_path(spark, "mark")
    ingest.ingest_distinct(ingest.stream_files(spark, path, t("documents").schema), out, mark)
    return spark.read.parquet(out).agg(F.count("*").alias("accepted"))


@query("s7_budget_sink", "WITH r AS (SELECT source, doc_id, length(text) AS n, sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id) AS upto FROM documents) SELECT source, count(*) AS rows, sum(n)::BIGINT AS chars FROM r WHERE upto - n < 50000 GROUP BY source")
def s7(t, spark):
    """Rows of each source until its characters reach the budget, as compressed JSON lines and back."""
    from pyspark.sql import Window

    w = Window.partitionBy("source").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = t("documents").select("source", "doc_id", "text", F.coalesce(F.sum(F.length("text")).over(w), F.lit(0)).alias("before")).where("before < 50000")
    path = scratch_path(spark, "budget")
    files.write_jsonl(rows.select("source", "doc_id", "text"), path)
    back = files.read_jsonl(spark, path, "source string, doc_id long, text string")
    return back.groupBy("source").agg(F.count("*").alias("rows"), F.sum(F.length("text")).alias("chars"))


@query("s7_interleaved_reader", "WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS rn FROM documents) SELECT doc_id, row_number() OVER (ORDER BY rn // 32, source, rn) - 1 AS pos FROM r")
def s7b(t, spark):
    """Turns of 32 lines from each source."""
    return sa.take_turns(t("documents").select("doc_id", "source"), "source", "doc_id", 32, "pos").select("doc_id", "pos")


@query("s11_blob_fetch", "SELECT doc_id, sha256(text) AS text_sha256 FROM documents WHERE doc_id % 10 <> 3")
def s11(t, spark):
    """Gzipped blobs with a declared charset; broken ones drop their row."""
    @F.pandas_udf("binary")
    def zipped(s: pd.Series) -> pd.Series:
        import gzip

        return s.map(lambda x: gzip.compress(x.encode()))

    payload = F.when(C("doc_id") % 10 == 3, F.lit(bytearray(b"broken"))).otherwise(zipped("text"))
    blobs = t("documents").select("doc_id", payload.alias("payload"), F.lit("utf-8").alias("charset"))
    return files.fetch_blobs(blobs, "payload", "charset", ["doc_id"]).select("doc_id", F.sha2("text", 256).alias("text_sha256"))


@query("s12_shard_receipts", "SELECT source, count(*) AS rows, sha256(string_agg(n_chars::VARCHAR, ',' ORDER BY doc_id)) AS sha256 FROM documents GROUP BY source")
def s12r(t, spark):
    return files.shard_receipts(t("documents").select("source", "doc_id", "n_chars"), ["source"], C("doc_id"), "n_chars")


@query("s14_receipt", "SELECT count(*) AS rows, sum(n_chars)::BIGINT AS chars FROM documents")
def s14(t, spark):
    """A JSON receipt written by rename and read back."""
    got = t("documents").agg(F.count("*").alias("rows"), F.sum("n_chars").alias("chars")).first()
    path = scratch_path(spark, "receipt") + ".json"
    files.write_receipt(spark, path, got.asDict())
    return files.read_jsonl(spark, path, "rows long, chars long")


@query("a33_file_inventory", "SELECT 4 AS files, count(*) AS rows FROM documents")
def a33(t, spark):
    """Files below a folder with their sizes, and the rows they hold."""
    path = copied(t, spark, "inventory")
    sizes = files.file_table(spark, path).agg(F.count("*").cast("int").alias("files"), F.sum("length").alias("bytes"))
    rows = spark.read.parquet(path).count()
    return sizes.where("bytes > 0").select("files", F.lit(rows).cast("long").alias("rows"))


@query("t4_stream_progress", "SELECT sum(n)::BIGINT AS seen, 4 AS batches FROM (SELECT count(*) AS n FROM documents)")
def t4(t, spark):
    """One micro-batch a file; what each saw adds up to all rows."""
    path, out, mark = copied(t, spark, "in"), scratch_path(spark, "out"), scratch_path(spark, "mark")
    seen = ingest.ingest_distinct(ingest.stream_files(spark, path, t("documents").schema), out, mark)
    return spark.createDataFrame([(sum(p["seen"] for p in seen), len(seen))], "seen long, batches int")


@query("s2_admission", "SELECT * FROM (VALUES ('complete', 1), ('missing', 1), ('partial', 1), ('wrong_digest', 1), ('wrong_size', 1)) AS v(status, files)")
def s2(t, spark):
    """Four files against a list that is right about one of them and names a fifth."""
    table = files.file_table(spark, copied(t, spark, "admission")).select("name", "length", "sha256")
    rank = files.listing(table, "part-", 7).select("name", "length", "sha256", "rank")
    length = C("length") + F.when(C("rank") == 2, 1).when(C("rank") == 3, -1).otherwise(0)
    wrong = rank.select("name", length.alias("length"), F.when(C("rank") == 4, F.sha2("sha256", 256)).otherwise(C("sha256")).alias("sha256"))
    expected = wrong.unionByName(spark.createDataFrame([("absent.parquet", 1, "")], "name string, length long, sha256 string"))
    return files.admission(table, expected).groupBy("status").agg(F.count("*").cast("int").alias("files"))


@query("s10_tar_scan", "SELECT doc_id || '.tar' AS name, 'texts/' || doc_id || '.txt' AS member, octet_length(encode(text))::BIGINT AS length, sha256(text) AS sha256 FROM documents")
def s10(t, spark):
    """An archive for each document and back."""

    @F.pandas_udf("binary")
    def archive(ids: pd.Series, texts: pd.Series) -> pd.Series:
        import io
        import tarfile

        def one(i, x):
            out, data = io.BytesIO(), x.encode()
            with tarfile.open(fileobj=out, mode="w") as tar:
                info = tarfile.TarInfo(f"texts/{i}.txt")
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
            return out.getvalue()

        return pd.Series([one(i, x) for i, x in zip(ids, texts, strict=True)])

    path = F.concat(F.lit("in/"), C("doc_id").cast("string"), F.lit(".tar"))
    return files.tar_members(t("documents").where("text IS NOT NULL").select(path.alias("path"), archive("doc_id", "text").alias("content")))


NAMES = ["model.safetensors", "sub/model.safetensors", "pytorch_model.bin", "pytorch_model-00001-of-00002.bin", "config.json", "README.md"]


@query("s15_model_files", f"""WITH f AS (SELECT p_brand AS repo, p_partkey, {NAMES}[(p_partkey % 6 + p_size % 2) % 6 + 1] AS name FROM part), k AS (SELECT *, CASE WHEN contains(name, '/') THEN -1 WHEN name LIKE '%.safetensors' THEN 2 WHEN name LIKE 'pytorch_model%.bin' THEN 1 WHEN name = 'config.json' THEN 0 ELSE -1 END AS kind FROM f),
b AS (SELECT repo, max(kind) AS best FROM k GROUP BY repo) SELECT repo, p_partkey, name FROM k JOIN b USING (repo) WHERE best > 0 AND kind IN (0, best)""")
def s15(t, spark):
    """Brands stand in for repositories and parts for their files; the crawl itself needs a network."""
    i = ((C("p_partkey") % 6 + C("p_size") % 2) % 6).cast("int")
    listing = t("part").select(C("p_brand").alias("repo"), "p_partkey", F.get(F.array(*map(F.lit, NAMES)), i).alias("name"))
    return files.model_files(listing, "repo", "name")


@query("t3_stop_and_resume", "SELECT count(*) AS rows, count(DISTINCT doc_id) AS docs FROM documents")
def t3(t, spark):
    """Stopped after two micro-batches, then run to the end over the same checkpoint: each row is there once."""
    path, out, mark = copied(t, spark, "in"), scratch_path(spark, "out"), scratch_path(spark, "mark")
    source = ingest.stream_files(spark, path, t("documents").schema)
    ingest.ingest_some(source, out, mark, 2)
    ingest.ingest(source, out, mark)
    return spark.read.parquet(out).agg(F.count("*").alias("rows"), F.countDistinct("doc_id").alias("docs"))


@query("t5_fixed_batches", "SELECT count(*) AS seen, 0 AS too_large FROM documents")
def t5(t, spark):
    """Micro-batches of at most 1024 documents: files of that size, one a batch."""
    path, out, mark = scratch_path(spark, "in"), scratch_path(spark, "out"), scratch_path(spark, "mark")
    t("documents").repartitionByRange(4, "doc_id").write.option("maxRecordsPerFile", 1024).parquet(path)
    seen = [p["seen"] for p in ingest.ingest_distinct(ingest.stream_files(spark, path, t("documents").schema), out, mark)]
    return spark.createDataFrame([(sum(seen), sum(n > 1024 for n in seen))], "seen long, too_large int")
