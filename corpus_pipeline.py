"""The corpus pipeline: documents in, training-ordered token sequences out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridlark.llm.decontaminate import drop_leaks
from gridlark.llm.ngram_join import jaccard_join
from gridlark.llm.quality_gam import score_documents, train
from gridlark.llm.scratch import Scratch
from gridlark.llm.source_mix import mix
from gridlark.llm.token_order import materialise


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model, fitted on the stage's input, does not reject."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rest = F.struct(*[c for c in docs.columns if c != "text"]).alias("rest")
    scored = score_documents(docs.select("text", rest), model, keep_text=True)
    own = [F.col("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns]
    return scored.where("_score >= 0.5").select(*own)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that with the smallest id.

    Of rows that repeat an id one stays; rows with a null id stay.
    """
    scratch = Scratch(spark, "pipeline-near")
    joined = scratch.table(jaccard_join(docs, scratch).select("doc_id", "component_id"), "joined")
    kept = joined.where("doc_id = component_id or doc_id is null").select("doc_id").distinct()
    first = docs.join(kept, docs.doc_id.eqNullSafe(kept.doc_id), "left_semi").select(*docs.columns)
    repeated = joined.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        return first
    each = W.partitionBy("doc_id").orderBy(F.xxhash64("text"), *[c for c in docs.columns if c != "doc_id"])
    ranked = first.join(repeated, "doc_id", "left_semi").select(F.struct(*docs.columns).alias("doc"), F.row_number().over(each).alias("row"))
    one = ranked.where("row = 1").select("doc.*")
    return first.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(one)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), Scratch(spark, "pipeline-leaks"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source weights take them."""
    return mix(docs, Scratch(spark, "pipeline-mix"))


def order_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences at their global slots, in shards that this writes."""
    return materialise(docs, Scratch(spark, "pipeline-order"))


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", drop_benchmark),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", order_tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            scratch.drop(f"stage-{k - 1}")
    return docs
