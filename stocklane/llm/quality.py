"""Quality classifier by co-training of two views.

One logistic model sees only the text (shape of its characters, words and lines), the other only the page's
metadata (language, source, declared length). Both start from a bounded sample of labelled documents. In each round both
views label every unlabelled document, and what one is sure of (``sure``) joins the other's training rows at half
weight (a class by half of its labelled rows at most): the unlabelled rows stay in their tasks, which send sums of fixed size (gradients and curvatures) for a few Newton
steps. In the end both views are calibrated on labelled rows kept aside, the calibrated log-odds are combined by a
third small fit, and every document is scored from its whole text.

The bound on labelled rows (``labelled``, in expectation) is a documented parameter; all else covers every row.

Defined results: null and empty texts have zero features, very long ones the same shares as short ones; null metadata is a
value of its own; of several labels of a document the smallest counts, null labels none; with fewer than ``LEAST`` training
rows of a class among those that fit or those kept aside (one class only, no labels, an empty table) nothing is learned: every
document gets the smoothed share as its score and is kept; repeated rows are scored one by one; further columns pass through.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocklane.llm.common import ROWS, batches, fresh, materialize
from stocklane.llm.toxicity import balanced_sample, squash

#: Bytes by kind, to count them by deletion.
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = b"0123456789"
SPACES = b" \t\r\n\x0b\x0c"
PLAIN = b".,;:'-()\""
OTHER = bytes(x for x in range(33, 127) if x not in UPPER + LOWER + DIGITS + PLAIN)
META = 64
TEXT = 19
#: Training rows of each class that either part has to have.
LEAST = 5
#: Sums of doubles are rounded to this unit, so that they do not depend on the order of addition.
UNIT = 2.0**-20


def text_features(text: str | None) -> list[float]:
    """The text view: shares and logarithms, none of which grows without bound."""
    data = (text or "").encode()
    n = len(data)
    if not n:
        return [0.0] * TEXT
    count = lambda kind: n - len(data.translate(None, kind))
    upper, lower, digits, spaces, plain, other = map(count, (UPPER, LOWER, DIGITS, SPACES, PLAIN, OTHER))
    words = data.lower().split()
    m = max(1, len(words))
    seen = Counter(words)
    same = sum(a == b for a, b in zip(words, words[1:]))
    lines = [x for x in data.split(b"\n") if x.strip()]
    distinct = len(set(lines))
    top = [c for _, c in seen.most_common(3)] + [0, 0, 0]
    starts = sum(x[:1].isupper() for x in lines)
    return [
        upper / n, lower / n, digits / n, spaces / n, plain / n, other / n, (n - upper - lower - digits - spaces - plain - other) / n,
        np.log1p(m) / 10, np.log1p(len(lines)) / 10, len(seen) / m, np.log(len(seen) + 1) / np.log(m + 2), same / m, top[0] / m, sum(top[:3]) / m,
        min(1.0, n / m / 40), distinct / max(1, len(lines)), min(1.0, m / max(1, len(lines)) / 100), starts / max(1, len(lines)), 1.0 if upper > lower else 0.0,
    ]


def meta_features(lang, source, n_chars) -> list[int]:
    """The metadata view: hashed categories (row numbers of ones in a vector of ``META``)."""
    size = "null" if n_chars is None else str(int(np.log2(max(1, n_chars))))
    return sorted({zlib.crc32(f"{name}={value}".encode()) % META for name, value in (("lang", lang), ("source", source), ("size", size))})


def one_hot(rows: list[list[int]]) -> np.ndarray:
    out = np.zeros((len(rows), META))
    for k, r in enumerate(rows):
        out[k, r] = 1.0
    return out


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return z @ self.weights[:-1] + self.weights[-1]


def standard(model: Logistic, x: np.ndarray) -> np.ndarray:
    return np.hstack([np.clip((x - model.mean) / model.scale, -6, 6), np.ones((len(x), 1))])


def slopes(model: Logistic, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the weighted log-loss."""
    z = standard(model, x)
    p = squash(z @ model.weights)
    return z.T @ (weight * (p - y)), (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z


def newton(model: Logistic, gradient: np.ndarray, curvature: np.ndarray, ridge: float) -> float:
    """One damped step on the weights; the size of the largest move."""
    penalty = np.full(len(model.weights), ridge)
    penalty[-1] = 1e-6
    move = np.linalg.solve(curvature + np.diag(penalty), gradient + penalty * model.weights)
    model.weights = model.weights - move * min(1.0, 4.0 / (np.abs(move).max() + 1e-12))
    return float(np.abs(move).max())


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> Logistic:
    """Weighted ridge logistic regression by Newton steps on standardised features."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    model = Logistic(mean, np.where(scale < 1e-6, 1.0, scale), np.zeros(x.shape[1] + 1))
    for _ in range(rounds):
        if newton(model, *slopes(model, x, y, weight), ridge) < 1e-6:
            break
    return model


def squares(x: np.ndarray) -> np.ndarray:
    """The text view with squares, so that both ends of a share can be bad."""
    return np.hstack([x, x * x])


@dataclass
class CoTrained:
    """Two views, their calibrations (slope and offset of the margin) and the combining fit."""

    text: Logistic | None
    meta: Logistic | None
    calibrations: list[tuple[float, float]]
    combine: np.ndarray
    share: float

    def odds(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        return np.stack([a * m + b for m, (a, b) in zip((self.text.margin(text), self.meta.margin(meta)), self.calibrations, strict=True)], axis=1)

    def score(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        if self.text is None:
            return np.full(len(text), self.share)
        return squash(np.clip(self.odds(text, meta), -12, 12) @ self.combine[:-1] + self.combine[-1])


def calibrate(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Platt's slope and offset; a view that says nothing gets a slope near 0."""
    fit = logistic(margin[:, None], y, weight)
    slope = max(0.0, float(fit.weights[0] / fit.scale[0]))
    return slope, float(fit.weights[1] - slope * fit.mean[0])


def co_train(text, meta, y, weight, aside, unlabelled, *, rounds: int = 2, steps: int = 8, sure: float = 0.97, ridge: float = 1.0) -> CoTrained:
    """``unlabelled(labellers, models, sure)``: for each view and class the summed slopes over all unlabelled rows that the other
    view's labeller (model, calibration) is sure of, and how many. A row weighs a half, and less where a class would weigh more
    than half of its labelled rows."""
    share = (float((weight * y).sum()) + 0.5) / (float(weight.sum()) + 1.0)
    own = ~aside
    if min(y[own].sum(), (1 - y[own]).sum(), y[aside].sum(), (1 - y[aside]).sum()) < LEAST:
        return CoTrained(None, None, [], np.zeros(3), share)
    weight = weight / weight[own].mean()
    views = (text, meta)
    models = [logistic(v[own], y[own], weight[own], ridge) for v in views]
    checked = lambda: [calibrate(m.margin(v[aside]), y[aside], weight[aside]) for m, v in zip(models, views, strict=True)]
    for _ in range(rounds if unlabelled else 0):
        labellers = [*zip(models, checked(), strict=True)]
        models = [Logistic(m.mean, m.scale, np.zeros_like(m.weights)) for m in models]
        for _ in range(steps):
            for model, v, classes in zip(models, views, unlabelled(labellers, models, sure), strict=True):
                g, h = slopes(model, v[own], y[own], weight[own])
                for c, (gradient, curvature, n) in enumerate(classes):
                    part = 0.5 * min(1.0, weight[own & (y == c)].sum() / max(n, 1.0))
                    g, h = g + part * gradient, h + part * curvature
                newton(model, g, h, ridge)
    out = CoTrained(models[0], models[1], checked(), np.zeros(3), share)
    odds = np.clip(out.odds(text[aside], meta[aside]), -12, 12)
    fit = logistic(odds, y[aside], weight[aside], ridge=5.0)
    slope = np.maximum(fit.weights[:-1] / fit.scale, 0.0)
    out.combine = np.append(slope, fit.weights[-1] - float(slope @ fit.mean))
    return out


def text_view(column: list) -> np.ndarray:
    return squares(np.array(column, float).reshape(len(column), TEXT))


def stored_views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Both views of rows (text_view, meta_view) as matrices."""
    text, meta = batch.column(0), batch.column(1)
    hot = np.zeros((batch.num_rows, META))
    hot[np.repeat(np.arange(batch.num_rows), np.asarray(pc.list_value_length(meta))), np.asarray(meta.flatten())] = 1.0
    return squares(np.asarray(text.flatten(), dtype=float).reshape(-1, TEXT)), hot


def summed(rows: DataFrame):
    """The function ``unlabelled`` of ``co_train`` over rows (text_view, meta_view): tasks send a number for each cell of
    each view's and class' gradient, curvature and count, summed by cell."""
    sides = [n for n in (2 * TEXT + 1, META + 1) for _ in (0, 1)]  # view by view, in each the classes 0 and 1

    def unlabelled(labellers, models, sure):
        shared = rows.sparkSession.sparkContext.broadcast((labellers, models))

        def run(parts):
            (told, own), sums = shared.value, [np.zeros((n + 2, n)) for n in sides]
            for part in (batch.slice(at, ROWS) for batch in parts for at in range(0, batch.num_rows, ROWS)):
                views = stored_views(part)
                good = [squash(a * m.margin(x) + b) for (m, (a, b)), x in zip(told, views, strict=True)]
                for v in (0, 1):  # the text view learns from the metadata view's labels and the other way round
                    for c, picked in enumerate((good[1 - v] <= 1 - sure, good[1 - v] >= sure)):
                        n = int(picked.sum())
                        gradient, curvature = slopes(own[v], views[v][picked], np.full(n, float(c)), np.ones(n))
                        sums[2 * v + c] += np.vstack([gradient, curvature, np.full(len(gradient), float(n))])
            flat = np.concatenate([x.ravel() for x in sums])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(np.round(flat / UNIT).astype(np.int64))], names=["cell", "value"])

        got = rows.mapInArrow(run, "cell bigint, value bigint").groupBy("cell").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).toArrow()
        shared.unpersist()
        flat = np.zeros(sum(n * (n + 2) for n in sides))
        flat[np.asarray(got["cell"].combine_chunks())] = [float(x) * UNIT for x in got["value"].to_pylist()]
        out, at = [], 0
        for n in sides:
            own = flat[at : at + n * (n + 2)].reshape(n + 2, n)
            out.append((own[0], own[1:-1], float(own[-1, 0])))
            at += n * (n + 2)
        return out[:2], out[2:]

    return unlabelled


def features(documents: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    def step(batch):
        columns = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
        meta = zip(*(columns[c].to_pylist() for c in ("lang", "source", "n_chars")), strict=True)
        return {c: columns[c] for c in keep} | {"text_view": [text_features(t) for t in columns[text_col].to_pylist()], "meta_view": [meta_features(*m) for m in meta]}

    fields = documents.select(keep).withColumns({"text_view": F.lit(None).cast("array<double>"), "meta_view": F.lit(None).cast("array<int>")}).schema
    return batches(documents.select(*keep, text_col, "lang", "source", "n_chars"), step, fields)


def train(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality", labelled: int = 12_000, **options) -> CoTrained:
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).cast("int").alias("y"))
    chosen = balanced_sample(known, "y", labelled, id_col).withColumn("aside", F.pmod(F.xxhash64(id_col, F.lit(5)), F.lit(3)) == 0)
    joined = documents.select(id_col, "text", "lang", "source", "n_chars").join(F.broadcast(chosen), id_col, "left")
    rows = materialize(features(joined, ["y", "weight", "aside"]), "views")
    got = rows.where("y IS NOT NULL").toArrow()
    column = lambda c: np.asarray(got[c].combine_chunks(), dtype=float)
    aside = np.array(got["aside"].to_pylist(), bool)
    text, meta = text_view(got["text_view"].to_pylist()), one_hot(got["meta_view"].to_pylist())
    return co_train(text, meta, column("y"), column("weight"), aside, summed(rows.where("y IS NULL").select("text_view", "meta_view")), **options)


def score(documents: DataFrame, model: CoTrained, *, text_col: str = "text", score_col: str = "quality_score") -> DataFrame:
    """``documents`` plus ``score_col``, the probability that a document is of good quality; a column of that name is replaced."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in documents.columns if c != score_col]

    def step(batch):
        columns = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
        text = text_view([text_features(t) for t in columns[text_col].to_pylist()])
        meta = one_hot([meta_features(*m) for m in zip(*(columns[c].to_pylist() for c in ("lang", "source", "n_chars")), strict=True)])
        return columns | {score_col: shared.value.score(text, meta)}

    plain = documents.select(*[F.col(f"`{c}`") for c in kept])
    return batches(plain, step, plain.withColumn(score_col, F.lit(0.0)).schema)


def good(score_col: str, model: CoTrained, threshold: float):
    """Whether a scored document is kept: all are if nothing could be learned."""
    return F.lit(True) if model.text is None else F.col(score_col) >= threshold


def keep_good(documents: DataFrame, labels: DataFrame, *, threshold: float = 0.5, **options) -> DataFrame:
    """The documents that the classifier does not reject, unchanged."""
    model, own = train(documents, labels, **options), fresh(documents, "quality_score")
    return score(documents, model, score_col=own).where(good(own, model, threshold)).select(*[F.col(f"`{c}`") for c in documents.columns])


def report(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", threshold: float = 0.5, **options) -> DataFrame:
    """Per document: id, ``score``, ``kept`` (1 or 0)."""
    model = train(documents, labels, id_col=id_col, **options)
    scored = score(documents.select(id_col, "text", "lang", "source", "n_chars"), model)
    return scored.select(id_col, F.col("quality_score").alias("score"), good("quality_score", model, threshold).cast("int").alias("kept"))
