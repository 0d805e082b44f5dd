"""A training corpus from raw documents: language, toxicity, near copies, secrets, packing.

Every stage takes all that the stage before it kept, and all but the last return the columns of documents.
Stages are written as Parquet in the cluster's shared folder and read again, so a lost executor costs a part of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import langid, minhash, packing, secrets, toxicity
from lectern.llm.common import scratch, written
from lectern.llm.queries import tokenizer_path

#: Phrases a character, beyond the SHORT that any text takes, from which no learned language explains a text. Held-out documents of the learned
#: languages have 0.34 at most, mostly 0.15; text in unlearned languages has 0.56 and more, random letters 0.62, other scripts 1.
UNEXPLAINED, SHORT = 0.5, 2
#: Near copies have 100 * |intersection| >= PERCENT * |union| of their sets of five-word shingles.
PERCENT = 80


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that have no letter, or that no learned language explains."""
    said = langid.identify(docs, langid.sample(docs.select("doc_id", "text", "lang")))
    beyond = F.col("phrase_rate") - SHORT / F.greatest(F.length("text"), F.lit(1))
    return said.where((F.col("lang_pred") != langid.UNKNOWN) & (beyond < UNEXPLAINED)).select(*docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that score as toxic."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).where(F.col("toxicity") < toxicity.THRESHOLD).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest doc_id. Rows without a doc_id stay, once for each text."""
    kept = written(minhash.groups(docs, PERCENT).where("kept").groupBy("doc_id").agg(F.count("*").alias("rows")), "kept")
    once = docs.join(kept.where("rows = 1"), "doc_id", "left_semi")
    again = docs.join(kept.where("rows > 1"), "doc_id", "left_semi").union(docs.where("doc_id is null"))
    return once.select(*docs.columns).union(again.select(*docs.columns).dropDuplicates(["doc_id", "text"]))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark; n_chars follows the text."""
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.digests(docs, tokenizer_path())


STAGES = [("language", languages), ("toxicity", toxic), ("near_copies", near_copies), ("secrets", without_secrets), ("packing", packed)]

#: Models, automata and a tokenizer are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch(spark):  # what a stage has written besides goes when its result is there
            docs = written(stage(spark, docs, sf_dir), name, kept=True)
    return STAGES[-1][1](spark, docs, sf_dir)
