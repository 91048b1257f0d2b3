"""The corpus pipeline: five stages over documents, each on all that the one before kept.

Quality rules reject poor texts, the toxicity field rejects toxic ones, the n-gram
Jaccard join keeps one document of each group of near copies, temperature mixing
repeats or thins documents by source, and packing lays the rest out in windows.
Every stage but the last returns the columns of documents.

Rules and the field are learned from labels whose crc32(doc_id as text) mod 5 is not 0,
so that the others measure what a stage does to rows it has not learned from.

Defined results, for every stage: rows, not ids, are what is judged, so that repeated and
null ids are kept apart; repeated rows are judged alike; further columns, whatever their
names, come through; an empty table gives an empty one.  What becomes of null texts stands
with each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.bayes_join import representatives
from docloom.llm.common import crc_mod, stored, tokenizer_path
from docloom.llm.mixing import mixture
from docloom.llm.packing import packed_documents
from docloom.llm.quality_rules import base_failed, fit_quality_rules, ratios, text_statistics, verdict
from docloom.llm.toxicity import fit_toxicity, score_toxicity


def labels_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels to learn from."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet").where(crc_mod(F.col("doc_id"), 5) != 0)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list keep; null texts have no words and go."""
    rules = fit_quality_rules(docs, labels_of(spark, sf_dir))
    whole = docs.select(F.struct(*docs.columns).alias("row"), "text")
    stats = text_statistics(whole, "row", "text")
    return stats.where(~base_failed() & verdict(rules, ratios())).select("id.*")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half; null and empty texts score as texts without toxic words and stay."""
    model = fit_toxicity(docs, labels_of(spark, sf_dir))
    whole = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return score_toxicity(whole, model, id_col="row").where("score < 0.5").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, the one with the least id (a null id comes last, then
    the text's hash decides); rows of groups of one, and texts without words, null ones too, stay."""
    return representatives(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them; a null source is a source, null texts have no tokens."""
    return mixture(docs, out="corpus_pipeline_mix").drop("corpus_pipeline_mix")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 2048 tokens; a null text is an end id alone."""
    return packed_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]
#: Learned rules, the field and exact packing have no SQL form; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{name}")
    return docs
