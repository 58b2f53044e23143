"""Toxicity: a factorization machine over hashed terms.

Terms of a text are its distinct lower-cased words and their beginnings of 4, 5 and 6 letters, hashed to
``2**BITS`` buckets. A bounded sample of the labelled training rows (``sample`` rows in expectation, both classes in
equal parts, weighted back to their shares) tells which buckets carry signal (the ``active`` largest likelihood ratios, from
``least_ratio``; counted in tasks) and trains a factorization machine on them: a bias, a linear weight a bucket and ``factors`` latent numbers a bucket, whose
inner products are the pairwise interactions that additive weights miss, such as insult with group mention.
Every document is then scored by its whole text; scoring reads neither labels nor any other column.

Training rows are the labelled documents whose crc32(doc_id as text) mod 3 is not 1.

Defined results: null and empty texts have no terms and get the bias' score; a null doc_id counts as the empty
text in the fold; of several labels of a document the largest counts, null labels none; a single-class
or empty training set gives every text the smoothed share of positives; a very long text is scored whole, as one slice; an
empty table gives no rows; repeated rows are scored one by one; further columns play no part.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocklane.llm.common import batches, materialize

BITS = 20
WORD = re.compile(r"[^\W_]+")
PREFIXES = (4, 5, 6)
CACHED = 300_000


def terms(word: str) -> set[int]:
    own = {word, *(word[:n] + "*" for n in PREFIXES if len(word) >= n)}
    return {zlib.crc32(t.encode()) & ((1 << BITS) - 1) for t in own}


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


@dataclass
class Machine:
    """The trained parameters; ``place`` maps a bucket to its row in ``linear`` and ``latent``."""

    bias: float
    place: dict[int, int]
    linear: np.ndarray
    latent: np.ndarray

    def score(self, rows: np.ndarray) -> float:
        v = self.latent[rows]
        pair = 0.5 * float((v.sum(axis=0) ** 2 - (v * v).sum(axis=0)).sum())
        return squash(self.bias + float(self.linear[rows].sum()) + pair)


def squash(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def balanced_sample(labelled: DataFrame, label: str, size: int, id_col: str) -> DataFrame:
    """About ``size`` rows, half of each class, chosen by a hash of the id; ``weight`` restores the shares."""
    counts = {r[label]: r["count"] for r in labelled.groupBy(label).count().collect()}
    keep = {y: min(1.0, size / 2 / n) for y, n in counts.items()}
    pick = F.pmod(F.xxhash64(F.col(id_col), F.lit(17)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    rate = F.lit(0.0)
    for y, share in keep.items():
        rate = F.when(F.col(label) == y, F.lit(float(share))).otherwise(rate)
    return labelled.where(pick < rate).withColumn("weight", F.try_divide(F.lit(1.0), rate))


def train(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 16_000, active: int = 4096, least_ratio: float = 7.0, factors: int = 6, rounds: int = 250, recall_weight: float = 8.0) -> Machine:
    """``sample`` bounds the labelled rows that are gathered, ``active`` the buckets of the machine. ``recall_weight``: how
    much more a missed toxic text costs than a clean one reported."""
    labelled = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(id_col).agg(F.max(label_col).cast("int").alias("y"))
    chosen = balanced_sample(labelled, "y", sample, id_col)

    def step(batch):
        return {"y": batch.column(1), "weight": batch.column(2), "terms": [sorted(set().union(*map(terms, words_of(t)))) for t in batch.column(0).to_pylist()]}

    rows = documents.select(id_col, text_col).join(F.broadcast(chosen), id_col).select(text_col, "y", "weight")
    found = materialize(batches(rows, step, "y int, weight double, terms array<int>"), "terms")
    best = [r["bucket"] for r in telling(found, active, least_ratio).collect()]  # ``active`` at most
    got = found.select("y", "weight", F.array_intersect("terms", F.array(*map(F.lit, best)).cast("array<int>")).alias("terms")).toArrow()
    y = np.asarray(got["y"].combine_chunks(), np.float64)
    weight = np.asarray(got["weight"].combine_chunks(), np.float64)
    listed = got["terms"].combine_chunks()
    sizes = np.diff(np.asarray(listed.offsets))
    return fit(y, np.where(y == 1, recall_weight * weight, weight), sizes, np.asarray(listed.flatten(), np.int64), active, least_ratio, factors, rounds)


def telling(rows: DataFrame, active: int, least_ratio: float) -> DataFrame:
    """The ``active`` buckets with the largest likelihood ratio among rows (y, terms), counted in tasks: what the driver then
    gathers has no more than that many numbers a row, however long the texts are."""
    n, n1 = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    seen = rows.select("y", F.explode("terms").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("k"), F.sum("y").alias("k1"))
    part = lambda cell, row, column: F.when(cell > 0, cell * F.log(cell * F.lit(float(n)) / (row * column))).otherwise(0.0)
    k, k1, rest, rest1 = F.col("k"), F.col("k1"), F.lit(n) - F.col("k"), F.lit(n1) - F.col("k1")
    ratio = 2 * (part(k1, k, F.lit(n1)) + part(k - k1, k, F.lit(n - n1)) + part(rest1, rest, F.lit(n1)) + part(rest - rest1, rest, F.lit(n - n1)))
    return seen.select("bucket", ratio.alias("ratio")).where(F.col("ratio") >= 0.999 * least_ratio).orderBy(F.desc("ratio"), "bucket").limit(active)


def likelihood_ratio(y: np.ndarray, doc: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """G squared of each bucket against the class, from document counts."""
    n, n1 = len(y), y.sum()
    k1 = np.bincount(bucket, y[doc], 1 << BITS)
    k = np.bincount(bucket, minlength=1 << BITS).astype(float)
    total = np.zeros(1 << BITS)
    for seen, row, column in ((k1, k, n1), (k - k1, k, n - n1), (n1 - k1, n - k, n1), (n - n1 - k + k1, n - k, n - n1)):
        with np.errstate(divide="ignore", invalid="ignore"):
            total += np.where(seen > 0, seen * np.log(seen * n / (row * column)), 0.0)
    return 2 * total


def fit(y, weight, sizes, bucket, active, least_ratio, factors, rounds) -> Machine:
    share = (float((weight * y).sum()) + 0.5) / (float(weight.sum()) + 1.0)
    start = float(np.log(share / (1 - share)))
    empty = Machine(start, {}, np.zeros(0), np.zeros((0, factors)))
    if not 0 < y.sum() < len(y):
        return empty
    doc = np.repeat(np.arange(len(y)), sizes)
    ratio = likelihood_ratio(y, doc, bucket)
    best = np.argsort(-ratio)[:active]
    best = best[ratio[best] >= least_ratio]
    if not len(best):
        return empty
    number = np.full(1 << BITS, -1)
    number[best] = np.arange(len(best))
    own = number[bucket] >= 0
    doc, feature = doc[own], number[bucket[own]]
    rng = np.random.default_rng(7)
    bias, linear, latent = start, np.zeros(len(best)), rng.normal(0, 0.02, (len(best), factors))
    weight = weight / weight.mean()
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (np.zeros(1), linear, latent)]
    n = len(y)
    gather = lambda x: np.stack([np.bincount(doc, x[feature, f], n) for f in range(factors)], axis=1)
    for step in range(1, rounds + 1):
        total = gather(latent)
        margin = bias + np.bincount(doc, linear[feature], n) + 0.5 * ((total**2).sum(axis=1) - np.bincount(doc, (latent**2).sum(axis=1)[feature], n))
        gap = weight * (squash(margin) - y) / n
        slope = gap[doc]
        grads = [
            np.array([gap.sum()]),
            np.bincount(feature, slope, len(best)) + 1e-4 * linear,
            np.stack([np.bincount(feature, slope * (total[doc, f] - latent[feature, f]), len(best)) for f in range(factors)], axis=1) + 2e-3 * latent,
        ]
        for k, g in enumerate(grads):  # Adam
            m, v = moments[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            if k == 0:
                bias -= float(move[0])
            elif k == 1:
                linear = linear - move
            else:
                latent = latent - 0.1 * move
    return Machine(bias, {int(b): k for k, b in enumerate(best)}, linear, latent)


def score(documents: DataFrame, machine: Machine, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """Per document: id, held_out, score, predicted."""
    shared = documents.sparkSession.sparkContext.broadcast(machine)
    known: dict[str, tuple[int, ...]] = {}
    fields = documents.select(id_col).withColumn("score", F.lit(0.0)).schema

    def step(batch):
        own = shared.value
        scores = []
        for text in batch.column(1).to_pylist():
            rows: set[int] = set()
            for w in words_of(text):
                found = known.get(w)
                if found is None:
                    if len(known) > CACHED:
                        known.clear()
                    found = known[w] = tuple(own.place[t] for t in terms(w) if t in own.place)
                if found:
                    rows.update(found)
            scores.append(float(own.score(np.array(sorted(rows), np.int64))))
        return {id_col: batch.column(0), "score": scores}

    scored = batches(documents.select(id_col, text_col), step, fields)
    return scored.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
