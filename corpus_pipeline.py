"""A corpus pipeline: quality, toxicity, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and reread as the next one's documents. All but the last return the columns
of documents. Rows that a stage rejects are gone for the stages after it.

Defined results: null text is the empty text for every stage; rows with a null id, or with an id that repeats, are judged
each by its own text in the first two stages and packed each on its own in the last; of near duplicates one row stays,
whatever their ids; an empty table stays empty; columns that clash with a stage's own names pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphspark.llm import best_fit, quality, simhash, toxicity
from graphspark.llm.queries import tokenizer_path
from graphspark.session import materialize, release


#: The column of row numbers in the near-duplicate stage.
ROW = "__row"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier predicts to be of low quality."""
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_documents(docs, model, lambda score: score >= 0.3)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the toxicity model predicts to be toxic."""
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_documents(docs, model, lambda score: score < 0.5)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each component of near duplicates.

    Documents are near if one of several short fingerprints of their 5-word shingles is within 4 bits and all of them together
    differ as little as those of sets with a similarity of 0.8 do (the README has the measured shares of pairs found). One row of a component stays, also
    where ids repeat: rows are told apart by a row number (the least stays), and null ids come last.
    """
    row = ROW
    while row.lower() in {c.lower() for c in docs.columns}:
        row += "_"
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = simhash.similar_documents(rows, row)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row))[row]
    kept = found.join(rows.select(row, "doc_id"), row).groupBy("component").agg(first.alias(row)).select(row)
    # what goes is the smaller part; where the written table of it is small enough for a broadcast, texts stay where they are
    gone = materialize(found.select(row).join(kept, row, "left_anti"), "gone")
    release(found)
    return rows.join(gone, row, "left_anti").select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens; one row per piece."""
    return best_fit.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality", quality_stage), ("toxicity", toxicity_stage), ("near_duplicates", near_duplicate_stage), ("packing", packing_stage)]

#: The stages' models and sketches aren't expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
