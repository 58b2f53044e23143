"""A training-corpus pipeline over ``documents``: five stages, each one of the operators in ``stocklane.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every stage's result as Parquet to the
shared folder and rereads it as the next stage's input. All but the last return the columns of ``documents``.

Every stage works on whole texts of any length and takes further columns, whatever their names, but returns its own. Null and
empty texts: the classifier scores them with zero features, they have no lines and no shingles, hold no benchmark window, and
encode to the end id. Null metadata is a value of its own. Rows with a null id are judged by the classifier and the benchmark
only. A row repeated under one id loses the same lines and is one document to the n-gram join; another text under the same id
is a document of its own. Ties go to the smaller id. An empty table passes through empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stocklane.llm import decontaminate, jaccard_join, line_dedup, piece_bpe, quality
from stocklane.llm.common import materialize, table
from stocklane.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained quality classifier rejects go."""
    return quality.keep_good(docs.select(COLUMNS), table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of similar lines all over the corpus the first stays; n_chars follows the text."""
    cut = line_dedup.dedup(docs.select(COLUMNS))
    return cut.withColumn("n_chars", F.when(F.col("gone").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicate documents (five-word shingles, similarity 0.8 or more) the one with the smallest id stays."""
    return jaccard_join.keep_one(docs.select(COLUMNS), width=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go."""
    return decontaminate.drop_documents(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document's text, digests of them and of the text that they decode to."""
    return piece_bpe.report(docs.select(COLUMNS), tokenizer_path())


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_lines),
    ("n-gram jaccard join", drop_copies),
    ("benchmark decontamination", drop_contaminated),
    ("sentencepiece encoding and decoding", encode),
]

#: Training, MinHash and merges are not SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
