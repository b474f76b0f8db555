"""The registered queries op1 to op10: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import chat_format, decontaminate, language_id, license_scan, lm_score, packing, quality_rules, secret_scan, simhash, toxicity
from siltstone.llm.common import doc_crc, documents


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(documents(spark, sf_dir), ["doc_id"])


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(documents(spark, sf_dir), ["doc_id"]).drop("rejected_by")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_scan(documents(spark, sf_dir), ["doc_id"])


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.contaminated(documents(spark, sf_dir), benchmark)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir)).drop("ids")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels, {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1})
    out = toxicity.predict(docs, model, ["doc_id"])
    return out.select("doc_id", (F.col("p_toxic") >= 0.5).alias("toxic"), F.col("p_toxic").alias("score"), "p_low_quality")


#: A conversation whose texts hold control strings of other templates.
EXTRA_TURNS = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["conv_id", "turn", "role", "text"]
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(*cols)
    values = ", ".join(f"({c}, {t}, '{r}', '{x}')" for c, t, r, x in EXTRA_TURNS)
    extra = spark.sql(f"SELECT * FROM VALUES {values} AS v(conv_id, turn, role, text)")
    return chat_format.chat_digest(chat_format.format_chat(given.unionByName(extra)))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = F.pmod(doc_crc(), F.lit(4)) == 2
    parsers = language_id.learn(docs, use=~held)
    out = docs.select("doc_id", "text", held.alias("held_out"))
    return language_id.identify(out, parsers, ["doc_id", "held_out"])


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.pmod(doc_crc(), F.lit(5)) == 1
    docs = documents(spark, sf_dir).select("doc_id", "text", held.alias("held_out"))
    return lm_score.lm_score(docs, ~F.col("held_out"), ["doc_id", "held_out"])


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.simhash_components(documents(spark, sf_dir))
    return got.select("doc_id", simhash.fingerprint_text(F.col("fp")).alias("fingerprint"), "component_id")


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_quality_rules": op2_quality_rules,
    "op3_secret_scan": op3_secret_scan,
    "op4_decontaminate": op4_decontaminate,
    "op5_packing": op5_packing,
    "op6_toxicity": op6_toxicity,
    "op7_chat_format": op7_chat_format,
    "op8_language_id": op8_language_id,
    "op9_lm_score": op9_lm_score,
    "op10_simhash": op10_simhash,
}
