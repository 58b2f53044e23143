"""The registered queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stocklane.llm import chat, collocations, decontaminate, html_text, jaccard_join, line_dedup, mixing, piece_bpe, prefix_tree, quality, secrets, topk, toxicity
from stocklane.llm.common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item: windows of ten words; null and empty texts are clean."""
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text, base kinds and confirmed ones; null and empty texts have none."""
    return secrets.report(table(spark, sf_dir, "documents"))


@query
def op10_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text and the text they decode to, as digests; null and empty texts are the end id."""
    return piece_bpe.report(table(spark, sf_dir, "documents"), tokenizer_path())


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query
def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page; null and empty html give an empty one."""
    return html_text.extract(table(spark, sf_dir, "pages"))


@query
def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one more, formatted and read back; null roles and texts are empty."""
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, [("user", said), ("assistant", said)])], "conv_id bigint, messages array<struct<role:string,content:string>>")
    return chat.report(table(spark, sf_dir, "conversations"), extra)


@query
def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best candidates of every fiftieth vector among all usable ones; ties go to the smaller id."""
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk.search(vectors, vectors.where("vec_id % 50 = 0"))


ORACLES["op2_topk"] = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.vec AS DOUBLE[]), CAST(c.vec AS DOUBLE[])) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.vec) = len(c.vec)
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every whole text, learned from two thirds of the labels; null and empty texts get the base score."""
    documents = table(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.train(documents, table(spark, sf_dir, "labels")))


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every document from its text and metadata; null and empty texts have zero features."""
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size and component at three words and 90 hundredths; empty sets stay alone."""
    return jaccard_join.join(table(spark, sf_dir, "documents"))


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated lines, and how many went; null and empty texts stay."""
    return line_dedup.report(table(spark, sf_dir, "documents"))


@query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each lang's first 2000 phrases of two to five words that occur a hundred times or more."""
    return collocations.mine(table(spark, sf_dir, "documents"))


ORACLES["op11_collocations"] = collocations.oracle()


@query
def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's share in the mix of all sources by weights 1, 2, 3; null texts have size 0."""
    return mixing.report(table(spark, sf_dir, "documents"))


ORACLES["op12_mixing"] = mixing.ORACLE


@query
def op13_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations; null roles and texts are empty."""
    return prefix_tree.report(table(spark, sf_dir, "conversations"))


ORACLES["op13_prefix_tree"] = prefix_tree.ORACLE
