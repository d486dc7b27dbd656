"""The corpus pipeline: quality rules, near-dedup, personal data, mixing, BPE encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept;
all but the last return the columns of documents, whatever these are called (doc_id and text are
the two that must be there). An empty table gives an empty one at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from medialoom.llm import bpe, common, mixing, neardup, pii, quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go. A null or empty text has no words, so it is rejected; rows that are repeated are judged one by one, so all stay or all go."""
    return quality.filtered(common.spread(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest doc_id (null counts as smallest). A null or empty text is near nothing and stays; of rows that repeat a doc_id and a text one stays, of rows that share a doc_id alone each."""
    return neardup.deduplicated(docs, shingle=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by the name of its kind, and n_chars follows; rows without any, null texts too, stay as they are, and repeated rows are treated alike."""
    return pii.redacted(docs)


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents appear as often as the rates fitted to the domains' weights say: 0, 1 or more times. A null or empty text has no tokens, so it has a rate but no part in the totals; rows that share a doc_id, or have none, appear alike; without labels or tokens all rates are 1, so all stay."""
    return mixing.resampled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (decimal, joined by a space), and the text decoded from them, for each row; a null or empty text has no ids."""
    return bpe.encode(docs, "word_bpe_49k.json")


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("personal data", personal_data),
    ("mixing", mixing_weights),
    ("BPE encoding", encode),
]

#: SQL expresses neither the classifier's fit nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder; what a stage returns is written as Parquet and read again. A stage's own tables, and its input, are deleted once its output is written."""
    docs = given = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = common.fresh_path(spark, "stage-" + name.replace(" ", "-"))
        with common.scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        if docs is not given:
            common.dropped(docs)
        docs = spark.read.schema(out.schema).parquet(path)
        docs.saved_at = path
    return STAGES[-1][1](spark, docs, sf_dir)
