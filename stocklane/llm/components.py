"""Distributed union-find, and complete candidate pairs for groups of any size without all pairs of a group.

Candidates come as rows (key, node): nodes that share a key may be linked. Emitting all pairs of a key would
grow with the square of a group of copies, so links are found in rounds. First each node is compared with one pivot
(the smallest node of the keys it shares most), then delegates of components that meet under a key are compared: no
more pairs than rows, and the verified links are joined to components. Then only keys whose nodes still lie in several
components are left; there, every node outside the key's largest component is compared with all nodes of other
components that pass an exact necessary condition. Afterwards every two nodes of a key are verified, ruled out or already
in one component, so the components are those of all links.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocklane.llm.common import materialize

#: Open rows of a key above which its pairs are dealt to several tasks by size and by chunk.
CROWD = 4000
#: Of its open keys a node's rows carry so many, the smallest, by which a pair is made under one of the keys that it shares.
FIRST = 8


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) of every node of ``edges`` (a, b).

    Each round hooks every node on its smallest smaller neighbour, follows the links to their roots and contracts
    the edges; rounds are few, as every root with an edge vanishes. All state is in tables of the shared folder.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    left = first = materialize(pairs.distinct(), "edges")
    maps = []
    while left.limit(1).count():
        up = materialize(left.groupBy("hi").agg(F.min("lo").alias("up")), "up")
        while True:
            higher = up.select(F.col("hi").alias("up"), F.col("up").alias("top"))
            moved = materialize(up.join(higher, "up", "left").select("hi", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")), "up")
            up = moved.select("hi", "up")
            if not moved.where("moved").limit(1).count():
                break
        maps.append(up)
        mapped = rooted(rooted(left, up, "hi"), up, "lo").where("hi <> lo")
        left = materialize(mapped.select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).distinct(), "edges")
    out = first.select(F.col("hi").alias("node")).union(first.select("lo")).distinct().withColumn("component", F.col("node"))
    for up in maps:
        out = rooted(out, up, "component")
    return out


def rooted(df: DataFrame, up: DataFrame, column: str) -> DataFrame:
    top = up.select(F.col("hi").alias(column), F.col("up").alias("_top"))
    return df.join(top, column, "left").withColumn(column, F.coalesce("_top", column)).select(df.columns)


def shared_keys(candidates: DataFrame) -> DataFrame:
    """Rows (key, node, pivot), each once, of keys with two nodes at least; the pivot is a key's smallest node.

    One shuffle: a task reads its keys as a sorted stream and holds the last row only, however many nodes a key has.
    """

    def run(parts):
        key = node = pivot = np.zeros(0, np.int64)  # the last row so far
        for batch in parts:
            k, v = (np.concatenate([last, np.asarray(batch.column(c), dtype=np.int64)]) for c, last in enumerate((key, node)))
            if not len(k):
                continue
            new = np.concatenate([[True], k[1:] != k[:-1]])
            own = new | np.concatenate([[True], v[1:] != v[:-1]])
            k, v, new = k[own], v[own], new[own]
            p = v[np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))]
            second = ~new & np.concatenate([[False], new[:-1]])  # brings its pivot along
            if len(key):
                p[: int(np.argmax(new[1:])) + 1 if new[1:].any() else len(p)] = pivot[0]
                if node[0] != pivot[0]:
                    second[1:2] = False
            out = [np.concatenate([x[~new], y[second]]) for x, y in ((k, k), (v, p), (p, p))]
            key, node, pivot = k[-1:], v[-1:], p[-1:]
            if len(out[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["key", "node", "pivot"])

    dealt = candidates.select("key", "node").repartition("key").sortWithinPartitions("key", "node")
    return dealt.mapInArrow(run, "key bigint, node bigint, pivot bigint")


def best_pairs(shared: DataFrame) -> DataFrame:
    """For each node the pivot that it shares the most keys with."""
    stars = shared.where("node <> pivot").groupBy("pivot", "node").agg(F.count(F.lit(1)).alias("n"))
    best = stars.groupBy("node").agg(F.max(F.struct("n", F.bitwise_not("pivot").alias("less"))).alias("best"))
    return best.select(F.bitwise_not("best.less").alias("a"), F.col("node").alias("b"))


def delegate_pairs(placed: DataFrame) -> DataFrame:
    """For each key in several components the smallest node of each against the smallest of all."""
    least = placed.groupBy("key", "component").agg(F.min("node").alias("b"))
    first = least.groupBy("key").agg(F.min("b").alias("a"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("key", "a")
    return least.join(first, "key").where("a <> b").select("a", "b").distinct()


def place(shared: DataFrame, labels: DataFrame) -> DataFrame:
    return shared.select("key", "node").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))


def distinct_groups(shared: DataFrame) -> DataFrame:
    """``shared`` without keys that have the same nodes as another key: near copies share dozens of such keys."""
    nodes = shared.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    return shared.join(nodes.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key"), "key", "left_semi")


def open_rows(placed: DataFrame) -> DataFrame:
    """The rows of keys in several components, with ``main``, the largest of them, and ``crowd``, the key's rows."""
    sizes = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("size"))
    mixed = sizes.groupBy("key").agg(F.max(F.struct("size", "component")).alias("main"), F.sum("size").alias("crowd"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    return placed.join(mixed.select("key", F.col("main.component").alias("main"), "crowd"), "key")


def first_keys(rows: DataFrame) -> DataFrame:
    """The ``FIRST`` smallest keys of each node. Keys are hashes, so nodes that share many keys share some of these."""
    return rows.groupBy("node").agg(F.slice(F.sort_array(F.collect_set("key")), 1, FIRST).alias("first"))


def made_pairs(rows: DataFrame, fits: str, percent: int) -> DataFrame:
    """Pairs (a, b) of a key's nodes in different components, ``a`` outside the largest; both outside: a < b.

    ``fits``: SQL over the rows ``l`` and ``r`` that is true for every pair that can link. A pair that shares keys among the
    ``first`` of both nodes is made under the smallest of these only, not under each. A crowded key is dealt to many
    tasks: by bands of the set size ``n`` (sets that link lie in the same or in neighbouring bands), and the left rows by
    chunks, for each of which the right rows come again.
    """
    step = math.log(100 / percent) * 1.000001
    rows = rows.withColumns({
        "band": F.expr(f"IF(crowd > {CROWD}, CAST(floor(ln(n) / {step!r}) AS INT), 0)"),
        "chunks": F.expr(f"CAST(ceil(crowd / {CROWD}) AS INT)"),
    })
    left = rows.where("component <> main").withColumn("chunk", F.expr("CAST(pmod(xxhash64(node), chunks) AS INT)"))
    bands = F.expr(f"IF(crowd > {CROWD}, array(band - 1, band, band + 1), array(band))")
    right = rows.withColumn("band", F.explode(bands)).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = "l.key = r.key AND l.band = r.band AND l.chunk = r.chunk"
    once = "l.key <= coalesce(array_min(array_intersect(l.first, r.first)), l.key)"
    met = left.alias("l").join(right.alias("r"), F.expr(f"{dealt} AND l.component <> r.component AND (r.component = r.main OR l.node < r.node) AND {fits} AND {once}"))
    return met.select(F.col("l.node").alias("a"), F.col("r.node").alias("b"))


class Linker:
    """Pairs compared so far, the links among them and their components. ``verify(pairs)`` keeps the linked (a, b)."""

    def __init__(self, spark, verify):
        self.verify = verify
        self.done = self.links = spark.createDataFrame([], "a bigint, b bigint")
        self.labels = spark.createDataFrame([], "node bigint, component bigint")

    def compare(self, pairs: DataFrame) -> None:
        """Verify the pairs that were not compared before."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = materialize(pairs.join(self.done, ["a", "b"], "left_anti"), "pairs")
        found = materialize(self.verify(pairs).select("a", "b"), "links")
        self.done = self.done.unionByName(pairs)
        if found.limit(1).count():
            self.links = self.links.unionByName(found)
            self.labels = materialize(components(self.links), "labels")

    def stars(self, shared: DataFrame) -> None:
        """Best pivots, then delegates: no more pairs than rows."""
        self.compare(best_pairs(shared))
        self.compare(delegate_pairs(place(shared, self.labels)))

    def open(self, shared: DataFrame) -> DataFrame:
        return materialize(open_rows(place(shared, self.labels)), "open")

    def rest(self, shared: DataFrame, features: DataFrame, fits: str, percent: int) -> None:
        """Every pair of a key that is still in different components and passes ``fits``, an exact necessary condition on
        ``features`` (columns by node, the set size ``n`` among them)."""
        if not shared.limit(1).count():
            return
        left = self.open(shared)
        self.compare(made_pairs(left.join(first_keys(left), "node").join(features, "node"), fits, percent))
