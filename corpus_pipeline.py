"""A corpus pipeline of five stages over documents; each stage's table is written and read again as the next one's input.

Stages keep all columns of documents; the last returns the packed pieces. Labels for language come from the column lang and for
toxicity from labels.parquet, each from the training folds of the respective query only. A stage's input is deleted once the next
one's is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticeworks.llm import decontaminate, langid, neardup, packing, toxicity
from latticeworks.llm.store import Workspace


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without text or letters, and those whose score is too near chance for their letters: other scripts, encoded
    data, mixtures. Without any labelled document only the letters decide."""
    model = langid.fit(docs.where(~langid.is_held_out(0, 5)))
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    made = ("_lang", "_score", "_letters")
    return langid.predict(docs, model, *made).where(langid.accepted(model, *made)).select(*docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose toxicity score reaches the threshold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs.where(~toxicity.is_held_out()), labels.where(~toxicity.is_held_out()))
    return toxicity.predict(docs, model, "_toxic").where(F.col("_toxic") < toxicity.THRESHOLD).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group; of different rows under that id, the one whose values hash lowest."""
    work, own = Workspace(spark, "pipeline"), Workspace(spark, "neardup")
    found = neardup.near_duplicates(docs, own).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.bool_and("kept").alias("kept"), F.count("*").alias("n"))
    found = work.put(found.where("NOT kept OR n > 1"), "changed")
    own.clear()
    rest = docs.join(found.select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    repeated = docs.join(found.where("kept").select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    one = repeated.groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("row"))
    return rest.unionByName(one.select("row.*"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a benchmark item."""
    work, own = Workspace(spark, "pipeline"), Workspace(spark, "decontaminate")
    found = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), work=own)
    found = work.put(found.select("doc_id").distinct(), "held")
    own.clear()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("language_id", language), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("decontamination", benchmark), ("packing", pack)]
#: A trained classifier and a vocabulary decide, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "corpus")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if i == len(STAGES) - 1 else work.put(out, name)
        if i:
            work.drop(STAGES[i - 1][0])  # the last stage has stored its pieces
    return docs
