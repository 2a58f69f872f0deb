"""The thin queries of the corpus operators: each reads a whole table and derives its contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm import decontamination, hard_negatives, jaccard, language_model, licenses, neighbours, packing, periodic_runs, quality, sanitisation, sharding, suffix_dedup, toxicity
from jobloom.llm.common import crc_of_id, table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(spark, table(spark, sf_dir, "documents"))


def op2_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sharding.shard(spark, table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve_index")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(spark, table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    df, name = decontamination.find_benchmark(spark, docs, table(spark, sf_dir, "benchmark"))
    return df.select(
        "doc_id", F.col(f"{name}.n_words").alias("n_words"), decontamination.hit_words(name).alias("n_hit"), F.size(f"{name}.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(f"{name}.items"), ",").cast("binary"), 256).alias("items_sha256"), decontamination.contaminated(name).alias("contaminated"),
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    df, name = toxicity.score_toxicity(spark, docs, table(spark, sf_dir, "labels"))
    score = F.col(f"{name}.score")
    return df.select("doc_id", (crc_of_id() % 4 == 2).alias("held_out"), score.alias("score"), (score >= 0.3).cast("int").alias("predicted"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    df, score, _ = quality.score_quality(spark, docs, table(spark, sf_dir, "labels"))
    scored = df.select("doc_id", (crc_of_id() % 5 == 0).alias("held_out"), score.alias("score"))
    return scored.select("*", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(spark, table(spark, sf_dir, "documents"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_texts(spark, table(spark, sf_dir, "documents"))


def op11_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sanitisation.find_private(spark, table(spark, sf_dir, "documents"))
    kind = F.array(*(F.lit(x) for x in sanitisation.KINDS))
    base = F.transform("base", lambda x: F.concat_ws(":", F.element_at(kind, x["kind"] + 1), x["start"], x["end"]))
    # Words do not overlap personal data, so the starts of both differ.
    both = F.array_sort(F.concat(F.transform("base", lambda x: F.struct(x["start"].alias("start"), F.element_at(kind, x["kind"] + 1).alias("kind"), x["end"].alias("end"), x["kind"].alias("place"))), F.transform("terms", lambda x: F.struct(x["start"].alias("start"), F.lit(sanitisation.TERM).alias("kind"), x["end"].alias("end"), F.lit(len(sanitisation.KINDS)).alias("place")))), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["place"] - b["place"]))
    of_kind = lambda i: F.size(F.filter("base", lambda x: x["kind"] == i)).cast("long")
    counts = [of_kind(i).alias(f"n_{name}") for i, name in enumerate(sanitisation.KINDS)]
    return found.select("doc_id", *counts, F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"), F.array_join(F.transform(both, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",").alias("spans"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(spark, vectors.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 100 == 0)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), crc_of_id().alias("h"))
    # Every tenth document by hash repeats a part of its words from word a on.
    g, n, own = F.floor(F.col("h") / 10), F.size("w"), F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda x: x != "")
    a = F.col("g") % n
    p = 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))
    made = docs.where("h % 10 = 0").select("doc_id", "text", g.alias("g"), own.alias("w")).withColumn("a", F.when(n > 0, a).otherwise(0)).withColumn("p", p)
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    turned = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at("w", (place(i) + 1).cast("int")))
    made = made.select("doc_id", F.when(n > 0, F.array_join(turned, " ")).otherwise("").alias("text"))
    df, name = periodic_runs.periodic_runs(docs.where("h % 10 <> 0").select("doc_id", "text").unionByName(made))
    runs = F.col(f"{name}.runs")
    best = F.element_at(F.array_sort(runs, lambda x, y: F.when(x["length"] != y["length"], F.signum(y["length"] - x["length"])).when(x["start"] != y["start"], F.signum(x["start"] - y["start"])).otherwise(F.signum(x["period"] - y["period"])).cast("int")), 1)
    lines = F.array_join(F.transform(runs, lambda x: F.concat_ws(",", x["start"], x["length"], x["period"])), "\n")
    none = F.size(runs) == 0
    return df.select("doc_id", F.size(runs).cast("long").alias("n_runs"), F.when(~none, best).alias("best"), F.when(none, "").otherwise(F.concat(lines, F.lit("\n"))).alias("lines"), F.col(f"{name}.collapsed").alias("collapsed")).select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_hilbert_sharding, op3_jaccard_join, op4_decontamination, op5_toxicity, op6_quality, op7_packing, op8_licenses, op9_neighbours, op10_language_model, op11_sanitisation, op12_hard_negatives, op13_periodic_runs)}
