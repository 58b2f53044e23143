"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, the source's target over its size. Documents are put in the
order of their sizes, expected copies are added up within the source, one random offset is added, and a document comes out
once for every integer boundary that its stretch crosses. By the order of sizes a source's taken words miss its target by one
largest document at most, whatever the offset. All sums are exact integers: the k-th document of a source with expectation N / D
is taken floor((k * N + U) / D) - floor(((k - 1) * N + U) / D) times, so never more often than the expectation rounded up.

Targets: sources in code point order, null last, take the weights in turn and share the whole; a target stops at ``most`` times its
source's size, and the excess is shared out again by weight until no target is above. The loop keeps two sums only; sources
stay a table, so there may be any number of them.

Defined results: a null text has size 0; a document of size 0 takes nothing; a source of size 0 has target 0; a null source is a
source; a null id is an id, sorted first; rows repeated, or alike in id, source, size and text, are documents of their own and share the
group's copies in any order; an empty table gives no rows; further columns stay with their document, whatever their names.
Offsets come from the seed and the source's name, so runs agree, also after lost executors.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocklane.llm.common import materialize
from stocklane.operators.ranges import ranks

WEIGHTS = (1, 2, 3)
MOST = 3
SEED = 17
#: Offsets are so many steps to the integer.
STEPS = 1 << 32


def words(text: Column) -> Column:
    """Number of words (bytes 9 to 13 and 32 part them) without holding them: each becomes one letter."""
    marks = F.regexp_replace(text, r"[^\x20\x09-\x0D]++", "x")
    return F.coalesce(F.length(F.translate(marks, " \t\n\x0b\f\r", "")), F.lit(0)).cast("long")


def whole(x: int | str | Column) -> Column:
    return (F.lit(Decimal(x)) if isinstance(x, int) else F.col(x) if isinstance(x, str) else x).cast("decimal(38,0)")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sizes`` (source, source_size) with the target and the expected copies of a document as a fraction, ``top`` / ``bottom``."""
    ordered = ranks(sizes, [], [F.col("source").asc_nulls_last()], "place")
    sources = materialize(ordered.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.expr(f"CAST((place - 1) % {len(weights)} AS INT) + 1"))), "sources")
    total, weight = (int(x or 0) for x in sources.agg(F.sum(whole("source_size")), F.sum("weight")).first())
    share, capped = total, None
    while True:  # each round caps at least one more source
        capped = whole("source_size") * F.lit(most) * whole(weight) < whole("weight") * whole(share)
        taken, left = sources.agg(F.sum(F.when(capped, whole("source_size"))), F.sum(F.when(~capped, F.col("weight")))).first()
        if (found := (total - most * int(taken or 0), int(left or 0))) == (share, weight):
            break
        share, weight = found
    empty = F.col("source_size") == 0
    top = F.when(empty, whole(0)).when(capped, whole(most)).otherwise(whole("weight") * whole(share))
    bottom = F.when(empty | capped, whole(1)).otherwise(whole("source_size") * whole(weight))
    target = F.when(capped, F.col("source_size").cast("double") * most).otherwise((whole("weight") * whole(share)).cast("double") / F.lit(float(max(weight, 1))))
    return sources.select("source", "source_size", target.alias("target"), top.alias("top"), bottom.alias("bottom"))


def copies(rows: DataFrame, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``rows`` (source, size, doc_id, same_text and any others) with source_size, target and ``copies``."""
    rows = materialize(rows, "sized")
    goals = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most).withColumnRenamed("source", "of")
    placed = ranks(rows, ["source"], ["size", F.col("doc_id").asc_nulls_first(), "same_text"], "k")
    met = placed.join(goals, placed["source"].eqNullSafe(goals["of"])).drop("of")
    # The offset of a source: 32 bits of a digest of seed and name, in 1 / bottom.
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")))
    drawn = F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("decimal(20,0)")
    offset = F.expr("CAST(drawn * bottom AS DECIMAL(38,0))")
    met = met.withColumn("drawn", drawn).withColumn("offset", F.floor(offset / whole(STEPS)).cast("decimal(38,0)"))
    passed = "CAST((CAST({k} AS DECIMAL(20,0)) * top + offset) AS DECIMAL(38,0)) DIV bottom"
    return met.withColumn("copies", F.expr(f"{passed.format(k='k')} - {passed.format(k='(k - 1)')}")).drop("k", "drawn", "offset", "top", "bottom")


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", words(F.col("text")).alias("size"), F.xxhash64("text").alias("same_text"))


def mix(docs: DataFrame, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mixed corpus: every document's columns, once for each copy."""
    whole_rows = docs.select("doc_id", "source", words(F.col("text")).alias("size"), F.xxhash64("text").alias("same_text"), F.struct("*").alias("document"))
    found = copies(whole_rows, seed, weights, most).where("copies > 0")
    return found.withColumn("copy", F.explode(F.expr("sequence(1, CAST(copies AS INT))"))).select("document.*")


def report(docs: DataFrame, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """A row a document: its size, its source's size and target, its copies and the words that they take."""
    return copies(sized(docs), seed, weights, most).select("doc_id", "source", "size", "source_size", "target", "copies", F.expr("copies * size").alias("taken"))


def sums(taken: DataFrame) -> DataFrame:
    """A source's target beside the words taken from it."""
    return taken.groupBy("source").agg(F.max("source_size").alias("source_size"), F.max("target").alias("target"), F.sum("taken").alias("taken"), F.max("size").alias("largest"))


ORACLE = """
WITH sized AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, text FROM documents
), sources AS (
  SELECT source, SUM(size)::HUGEINT AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM sized GROUP BY source
), filled AS (
  SELECT *, SUM(source_size) OVER () AS total, SUM(weight) OVER () AS weights,
    COALESCE(SUM(source_size) OVER earlier, 0) AS full_size, COALESCE(SUM(weight) OVER earlier, 0) AS full_weight
  FROM sources WINDOW earlier AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT (total - 3 * full_size)::HUGEINT AS share, (weights - full_weight)::HUGEINT AS left_weight FROM filled
  WHERE 3 * source_size * (weights - full_weight) >= weight * (total - 3 * full_size) ORDER BY full_weight LIMIT 1
), goals AS (
  SELECT source, source_size, 3 * source_size * left_weight < weight * share AS capped,
    CASE WHEN source_size = 0 THEN 0 WHEN capped THEN 3 ELSE weight * share END::HUGEINT AS top,
    CASE WHEN source_size = 0 OR capped THEN 1 ELSE source_size * left_weight END::HUGEINT AS bottom,
    CASE WHEN capped THEN 3.0 * source_size::DOUBLE ELSE (weight * share)::DOUBLE / left_weight::DOUBLE END AS target
  FROM sources CROSS JOIN level
), offsets AS (
  SELECT *, (('0x' || substr(md5('17:' || COALESCE('=' || source, 'null')), 1, 8))::BIGINT::HUGEINT * bottom) // 4294967296 AS shift FROM goals
), placed AS (
  SELECT s.*, g.* EXCLUDE (source), row_number() OVER (PARTITION BY s.source ORDER BY size, doc_id NULLS FIRST, text)::HUGEINT AS k
  FROM sized s JOIN offsets g ON s.source IS NOT DISTINCT FROM g.source
), dealt AS (SELECT *, ((k * top + shift) // bottom - ((k - 1) * top + shift) // bottom)::BIGINT AS copies FROM placed)
SELECT doc_id, source, size, source_size::BIGINT AS source_size, target, copies, copies * size AS taken FROM dealt
"""
