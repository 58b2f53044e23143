"""Exact top-k inner-product search with a three-phase uniform threshold.

Each vector is cut into ``slices`` blocks of dimensions; a slice of all candidates is one score list, held in
partitions, and a candidate's score is the sum of its entries over the lists. For a block of queries:

1. every task sends, once, the k best entries of each query in its portion of every list; the exact scores of the candidates seen
   give each query a cutoff that its k-th best cannot be below;
2. the cutoff over the number of slices goes to all partitions, which send every entry at or above it. A candidate
   without such an entry stays below the cutoff, so it is safe to leave out;
3. entries are added up by candidate; what lacks entries of some slices is dropped if even the uniform threshold
   there would leave it below the cutoff, and is scored exactly from its vector otherwise.

Queries are worked on in blocks of at most ``block`` rows, so what is gathered or broadcast at once is bounded by
``block * dims`` and ``block * slices * k`` numbers at any input size. Equal vectors share one entry that carries
their k + 1 smallest ids (a query leaves out only its own), so a much repeated vector costs no more than a rare one.

Defined results: vectors that are null, empty or hold null or non-finite components take no part, nor do rows
with a null id; ties go to the smaller id; a repeated (id, vector) row counts once, and of several vectors under
one id each is a candidate of its own; vectors of different lengths never meet. Scores must fit 63 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stocklane.llm.common import materialize

CHUNK = 1024


def integer_vectors(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """``vec_id, vec``: floor(scale * component) of every usable vector."""
    x = F.col(vector_col)
    usable = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    out = df.where(F.col(id_col).isNotNull() & F.coalesce(usable, F.lit(False)))
    return out.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("vec"))


def rows_to_matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.int64).reshape(-1, dims)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products; through float64 only where every sum is exact there."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def bounds(dims: int, slices: int) -> list[tuple[int, int]]:
    edges = np.linspace(0, dims, min(slices, dims) + 1).astype(int).tolist()
    return [*zip(edges, edges[1:])]


def search(vectors: DataFrame, queries: DataFrame, *, k: int = 5, slices: int = 2, block: int = 4096) -> DataFrame:
    """The k best candidates of ``vectors`` (vec_id, vec) for each row of ``queries`` (same columns):
    query_id, rank, vec_id, score. A query's own id is no candidate of it."""
    by_vector = Window.partitionBy("vec").orderBy("vec_id")
    few = vectors.distinct().withColumn("n", F.row_number().over(by_vector)).where(F.col("n") <= k + 1)
    groups = few.groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    groups = materialize(groups.select(F.monotonically_increasing_id().alias("g"), F.size("vec").alias("dims"), "ids", "vec"), "groups")
    asked = materialize(queries.distinct().select("vec_id", "vec", F.size("vec").alias("dims")), "queries")
    parts = []
    for dims, n in sorted((r["dims"], r["count"]) for r in asked.groupBy("dims").count().collect()):
        blocks = -(-n // block) + (n > block)
        for at in range(blocks):
            own = asked.where((F.col("dims") == dims) & (F.pmod(F.xxhash64("vec_id", "vec"), F.lit(blocks)) == at)).toArrow()
            if own.num_rows:
                parts.append(search_block(groups.where(F.col("dims") == dims), own, dims, k, slices))
    if not parts:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def search_block(groups: DataFrame, asked: pa.Table, dims: int, k: int, slices: int) -> DataFrame:
    spark = groups.sparkSession
    ids = np.asarray(asked["vec_id"].combine_chunks(), dtype=np.int64)
    matrix = rows_to_matrix(asked["vec"].combine_chunks(), dims)
    cuts = bounds(dims, slices)
    shared = spark.sparkContext.broadcast((ids, matrix))
    # One list for each slice; a task holds a portion of every list.
    lists = groups.select("g", F.size("ids").alias("n"), "ids", F.posexplode(F.array(*[F.slice("vec", a + 1, b - a) for a, b in cuts])).alias("slice", "part"))

    def entries(q: np.ndarray, s: int, g: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(np.full(len(q), s, np.int32)), pa.array(g), pa.array(score)], names=["q", "slice", "g", "score"])

    def local(best_only: bool, cutoff=None):
        def run(parts):
            own_ids, own = shared.value
            best: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # of each list the best scores and their candidates, a row a query
            for batch in parts:
                for at in range(0, batch.num_rows, CHUNK):
                    rows = batch.slice(at, CHUNK)
                    where = np.asarray(rows.column(3))
                    for s, (a, b) in enumerate(cuts):
                        pick = np.flatnonzero(where == s)
                        if not len(pick):
                            continue
                        sub = rows.take(pa.array(pick))
                        score = products(own[:, a:b], rows_to_matrix(sub.column(4), b - a))
                        g = np.asarray(sub.column(0), dtype=np.int64)
                        if best_only:  # k + 1 entries: one of them may be the query itself
                            held = np.broadcast_to(g, score.shape)
                            if s in best:
                                score, held = np.concatenate([best[s][0], score], axis=1), np.concatenate([best[s][1], held], axis=1)
                            n = min(k + 1, score.shape[1])
                            j = np.argpartition(-score, n - 1, axis=1)[:, :n]
                            best[s] = np.take_along_axis(score, j, axis=1), np.take_along_axis(held, j, axis=1)
                        else:
                            i, j = np.nonzero(score >= cutoff.value[:, None])
                            yield entries(i, s, g[j], score[i, j])
            for s, (score, held) in best.items():
                yield entries(np.repeat(np.arange(len(own_ids)), score.shape[1]), s, held.ravel(), score.ravel())

        return lists.mapInArrow(run, "q int, slice int, g bigint, score bigint")

    def exact(pairs: DataFrame) -> DataFrame:
        """q, g, ids, score of pairs (q, g), from whole vectors."""

        def run(parts):
            own = shared.value[1]
            for batch in parts:
                q = np.asarray(batch.column(0))
                vec = rows_to_matrix(batch.column(3), dims)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.einsum("ij,ij->i", own[q], vec))], names=["q", "g", "ids", "score"])

        return pairs.join(groups.select("g", "ids", "vec"), "g").select("q", "g", "ids", "vec").mapInArrow(run, "q int, g bigint, ids array<bigint>, score bigint")

    # Phase 1: the best entries of each list, merged; exact scores of what they name give the cutoffs.
    by_score = Window.partitionBy("q", "slice").orderBy(F.desc("score"), "g")
    seen = local(True).withColumn("n", F.row_number().over(by_score)).where(F.col("n") <= k + 1).select("q", "g").distinct()
    scored = expand(exact(seen), asked_ids(spark, ids))
    least = ranked(scored, k).groupBy("q").agg(F.min("score").alias("score"), F.count(F.lit(1)).alias("n")).toArrow()
    total = np.full(len(ids), np.iinfo(np.int64).min // 4)
    q, score, n = (np.asarray(least[c].combine_chunks()) for c in ("q", "score", "n"))
    total[q[n >= k]] = score[n >= k]  # fewer than k candidates: everything is wanted
    # Phase 2: a total of at least t needs an entry of at least t / slices (rounded up) in one list.
    uniform = spark.sparkContext.broadcast(-(-total // len(cuts)))
    sent = local(False, uniform).groupBy("q", "g").agg(F.sum("score").alias("part"), F.count(F.lit(1)).alias("lists"))
    # Phase 3: whole sums stand; others are kept if the missing lists could lift them, and scored exactly.
    limits = spark.createDataFrame([(i, int(t), int(-(-t // len(cuts)))) for i, t in enumerate(total.tolist())], "q int, total bigint, uniform bigint")
    known = sent.join(F.broadcast(limits), "q")
    whole = known.where((F.col("lists") == len(cuts)) & (F.col("part") >= F.col("total"))).select("q", "g", F.col("part").alias("score"))
    open_ = known.where((F.col("lists") < len(cuts)) & (F.col("part") + (len(cuts) - F.col("lists")) * (F.col("uniform") - 1) >= F.col("total"))).select("q", "g")
    whole = whole.join(groups.select("g", "ids"), "g").select("q", "g", "ids", "score")
    return ranked(expand(whole.unionByName(exact(open_)), asked_ids(spark, ids)), k).select(F.col("query_id"), F.col("rank"), F.col("vec_id"), F.col("score"))


def asked_ids(spark, ids: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, int(v)) for i, v in enumerate(ids.tolist())], "q int, query_id bigint")


def expand(scored: DataFrame, names: DataFrame) -> DataFrame:
    """A row for each id of an entry, without the query's own. ``names`` has the rows of one query block."""
    return scored.join(F.broadcast(names), "q").withColumn("vec_id", F.explode("ids")).where("vec_id <> query_id").select("q", "query_id", "vec_id", "score")


def ranked(rows: DataFrame, k: int) -> DataFrame:
    own = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
