"""A corpus pipeline: toxicity, near-duplicates, benchmark decontamination, mixing, sharding.

Every stage reads the table the stage before it wrote, and works on all of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinreel.llm import decontaminate, jaccard, mixing, sharding, simhash, toxicity
from twinreel.llm.common import drop_settled, packed, settle


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted on the labels of these documents, does not reject."""
    model = toxicity.fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest doc_id, nulls last, and of equal doc_ids the least digest.

    Candidates come from vantage-point trees over SimHash fingerprints of the sets of five-word shingles; two are
    linked if the Jaccard coefficient of the sets themselves is 0.8 or more; groups are what links connect.  Rows are told apart by doc_id and text
    (a digest of both), never by doc_id alone: ids may be null or repeated.
    """
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(" "), F.coalesce("text", F.lit(""))).cast("binary"))
    keyed = docs.select("doc_id", "text", key.alias("_key"))
    printed = settle(simhash.set_prints(keyed, 5, ["doc_id", "_key"]), "prints")
    links = settle(simhash.set_links(printed.groupBy("id").agg(F.first("bits").alias("bits"))), "links")
    found = jaccard.components(keyed.select("_key", "text"), printed, links, 5, 0.8)
    # the documents to drop are fewer than those to keep: a small table spares the texts a shuffle
    named = settle(printed.select("doc_id", "_key", "id").join(found, "id", "left").select("doc_id", "_key", F.coalesce("root", "id").alias("group")), "components")
    drop_settled(printed)
    first = named.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_key")).getField("_key").alias("first"), F.count("*").alias("c")).where("c > 1")
    grouped = settle(named.join(first, "group"), "grouped")
    gone = settle(grouped.where("_key <> first").select(F.col("_key").alias("_gone")).distinct(), "duplicates")
    out = packed(docs, _key=key).join(gone, F.col("_key") == F.col("_gone"), "left_anti")
    # rows with equal doc_id and text have one key: such a key stays once
    repeated = grouped.where("_key = first").groupBy("group").count().where("count > 1").limit(1).count() > 0
    return (out.dropDuplicates(["_key"]) if repeated else out).select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark."""
    return decontaminate.remove_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 10)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix with op1's weights: a document appears once for each time it is used, in training order."""
    mixed = settle(mixing.mix(docs, weights=(5, 2, 1), share=1.5, max_repeats=2.0), "mixed")
    return mixing.training_order(docs, mixed)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Eight shards of nearly equal bytes, slots gapless in each."""
    return sharding.shard(docs, 8)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Model fitting, SimHash and hash order are not SQL: tests compare near-duplicates, decontamination, mixing and sharding with brute
#: force, and toxicity with its labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
