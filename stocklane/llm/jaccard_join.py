"""N-gram Jaccard join by prefix trees.

A document is the set of its distinct word n-grams (64-bit hashes); two documents link when their Jaccard
similarity is at least ``percent`` hundredths. All sets follow one global order, rare n-grams first: by a count
sketch of fixed size over the whole corpus, ties by hash. Similar sets share an n-gram among the first
``n - ceil(t * n) + 1`` of each, so these are the keys under which Spark brings candidates together; equal sets are
one node. Candidates are verified exactly against prefix trees: the sets that meet one probe are stored in a trie in
global order, the traversal shares the overlap of common beginnings, and a subtree is left as soon as the remaining
lengths cannot reach the overlap that its sizes ask for. Links become components (see ``components``).

Defined results: null, empty and wordless texts have the empty set and link with nothing; fewer words than n are one
n-gram; a null id links with nothing; repeated rows get equal results; of several texts under one id each is a document of
its own; an empty table gives no rows; a very long text is hashed in pieces; further columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocklane.llm.common import batches, fresh, lookup, materialize, mix64, slices, utf8
from stocklane.llm.components import Linker, distinct_groups, shared_keys

SKETCH_BITS = 20
PARTS = 64
PORTION_BYTES = 250_000
#: A-Z become a-z; the bytes that part words become blanks; all other bytes stay.
LOWER = bytes(x + 32 if 65 <= x <= 90 else 32 if 9 <= x <= 13 else x for x in range(256))
#: A probe's candidates are dealt to tasks in portions of about this many sets.
PORTION = 1000
#: Sets that a task remembers so as not to name their keys again (about 20 MB).
SEEN = 200_000
#: Cells of a set's histogram.
CELLS = 64
#: Ids up to this number go out as a broadcast (16 MB); beyond it the same join shuffles.
SMALL = 2_000_000


class Shingler:
    """Distinct n-gram hashes of texts, vectorised over portions of about ``PORTION_BYTES``.

    A word's hash adds up a random number for each of its bytes and their places (tabulation); an n-gram's hash
    mixes its words' hashes in order. ASCII letters are lower-cased; bytes 9 to 13 and 32 part words. A longer text is
    hashed in pieces that end between words, so only its word hashes are held whole.
    """

    def __init__(self, width: int):
        self.width = width
        rng = np.random.default_rng(3)
        self.random = rng.integers(0, 2**64, 64 * 256, dtype=np.uint64, endpoint=False)
        self.odd = rng.integers(0, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.odd[0] = 1
        self.factors = mix64(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        out, held, size = [], [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size > PORTION_BYTES:
                out += self.portion(held)
                held, size = [], 0
        return out + (self.portion(held) if held else [])

    def words(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Where each word of a folded text starts, and its hash."""
        starts, hashes, at = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
        while at < len(text):
            end = text.find(b" ", at + PORTION_BYTES) + 1 or len(text)
            data = np.frombuffer(text, np.uint8, end - at, at)
            inside = data != 32
            edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
            first, sizes = edge[::2], edge[1::2] - edge[::2]
            if len(first):
                packed = np.cumsum(sizes) - sizes
                place = np.arange(int(sizes.sum()), dtype=np.int32) - np.repeat(packed.astype(np.int32), sizes)
                value = self.random[((place & 63) << 8) | data[inside]]
                if sizes.max() > 64:
                    value *= self.odd[(place >> 6) & 4095]
                starts.append(first + at)
                hashes.append(mix64(np.add.reduceat(value, packed) + sizes.astype(np.uint64)))
            at = end
        return np.concatenate(starts), np.concatenate(hashes)

    def portion(self, texts: list[bytes]) -> list[np.ndarray]:
        starts, h = self.words(b" ".join(texts).translate(LOWER))
        bounds = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))
        w, m = self.width, max(0, len(h) - self.width + 1)
        grams = np.full(m, w, np.uint64)
        for k in range(w):
            grams += mix64(h[k : k + m] * self.factors[k])
        grams, out, at = mix64(grams), [], 0
        for n in np.diff(bounds, prepend=0).tolist():
            if n >= w:
                own = np.sort(grams[at : at + n - w + 1])
                out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
            elif n:
                out.append(mix64(np.array([n], np.uint64) + mix64(h[at : at + n] * self.factors[:n]).sum(dtype=np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
            at += n
        return out


def fingerprint(own: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums over a set, as signed numbers."""
    a = int(mix64(own).sum(dtype=np.uint64)) if len(own) else 0
    b = int(mix64(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) if len(own) else 0
    return tuple(x - (1 << 64) if x >> 63 else x for x in (a, b))


def in_order(own: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """A set in global order: by the sketch's count, then by hash (the set comes sorted by hash)."""
    return own[np.argsort(sketch[(own >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")]


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def least_overlap(n: int, m: int, percent: int) -> int:
    """The smallest overlap with 100 * overlap >= percent * union."""
    return -(-percent * (n + m) // (100 + percent))


class Trie:
    """Sets in global order with shared beginnings. A node's label is an array of n-grams."""

    class Node:
        __slots__ = ("children", "ids", "label", "largest", "smallest")

        def __init__(self, label: np.ndarray, size: int):
            self.label, self.children, self.ids = label, {}, []
            self.smallest = self.largest = size

    def __init__(self):
        self.root = self.Node(np.zeros(0, np.uint64), 0)
        self.root.smallest = 1 << 60

    def add(self, key, own: np.ndarray) -> None:
        node, at, size = self.root, 0, len(own)
        while True:
            node.smallest, node.largest = min(node.smallest, size), max(node.largest, size)
            if at == size:
                node.ids.append(key)
                return
            child = node.children.get(own[at])
            if child is None:
                child = node.children[own[at]] = self.Node(own[at:], size)
                child.ids.append(key)
                return
            n = min(len(child.label), size - at)
            differ = np.flatnonzero(child.label[:n] != own[at : at + n])
            same = int(differ[0]) if len(differ) else n
            if same < len(child.label):  # the label is cut in two
                upper = self.Node(child.label[:same], size)
                upper.smallest, upper.largest = child.smallest, child.largest
                child.label = child.label[same:]
                upper.children[child.label[0]] = child
                node.children[own[at]] = upper
                child = upper
            node, at = child, at + same

    def similar(self, probe: np.ndarray, percent: int) -> list:
        """Keys of the sets that link with ``probe``."""
        by_hash, n, found = np.sort(probe), len(probe), []
        todo = [(child, 0, 0) for child in self.root.children.values()]
        while todo:
            node, depth, overlap = todo.pop()
            at = np.minimum(np.searchsorted(by_hash, node.label), n - 1)
            depth, overlap = depth + len(node.label), overlap + int((by_hash[at] == node.label).sum())
            # What is left of the largest set below, against the overlap that the smallest size needs.
            if overlap + min(node.largest - depth, n - overlap) < least_overlap(n, node.smallest, percent):
                continue
            if node.ids and overlap >= least_overlap(n, depth, percent):
                found += node.ids
            todo += [(child, depth, overlap) for child in node.children.values()]
        return found


def count_sketch(documents: DataFrame, text_col: str, width: int) -> np.ndarray:
    """How many documents have n-grams in each of ``2**SKETCH_BITS`` cells; its size does not depend on the input."""

    def counts(parts):
        shingler, total = Shingler(width), np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in parts:
            for part in slices(batch):
                own = np.concatenate(shingler.sets(utf8(part.column(0))))
                np.add.at(total, (own >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), np.uint32(1))
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([x.tobytes() for x in np.split(total, PARTS)], pa.binary())], names=["part", "cells"])

    def add(parts):
        total: dict[int, np.ndarray] = {}
        for batch in parts:
            for part, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[part] = total.get(part, 0) + np.frombuffer(cells, np.uint32).astype(np.uint64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([*total], pa.int32()), pa.array([np.minimum(x, 2**32 - 1).astype(np.uint32).tobytes() for x in total.values()], pa.binary())], names=["part", "cells"])

    kind = "part int, cells binary"
    got = documents.select(text_col).mapInArrow(counts, kind).repartition(F.col("part")).mapInArrow(add, kind).toArrow().to_pydict()
    out = np.zeros((PARTS, (1 << SKETCH_BITS) // PARTS), np.uint32)
    for part, cells in zip(got["part"], got["cells"], strict=True):
        out[part] = np.frombuffer(cells, np.uint32)
    return out.ravel()


def grouped(documents: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The rows (id, n, fp, fp2, own: a digest of the text) and the classes of equal sets (fp, fp2, n, copies) with their
    component: ``least``, its smallest id, and ``first``, the smallest (id, own) in it."""
    spark = documents.sparkSession
    base = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketch = spark.sparkContext.broadcast(count_sketch(base, "text", width))
    shinglers: list[Shingler] = []
    seen: set[int] = set()

    def sets(column):
        if not shinglers:
            shinglers.append(Shingler(width))
        return shinglers[0].sets(utf8(column))

    def summary(batch):
        own = sets(batch.column(1))
        prints = [fingerprint(x) for x in own]
        return {"id": batch.column(0), "own": batch.column(2), "n": [len(x) for x in own], "fp": [p[0] for p in prints], "fp2": [p[1] for p in prints], "hist": [histogram(x) for x in own]}

    def keys(batch):
        heads, nodes = [np.zeros(0, np.uint64)], []
        for own in sets(batch.column(0)):
            if len(own) and (node := fingerprint(own)[0]) not in seen:  # a task names the keys of equal sets once
                if len(seen) > SEEN:
                    seen.clear()
                seen.add(node)
                heads.append(in_order(own, sketch.value)[: prefix_length(len(own), percent)])
                nodes.append(node)
        return {"key": np.concatenate(heads).view(np.int64), "node": np.repeat(np.array(nodes, np.int64), [len(x) for x in heads[1:]])}

    def ordered(batch):
        own = sets(batch.column(1))
        same = [fingerprint(x) == p for x, p in zip(own, zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True), strict=True)]
        return {"node": batch.column(0), "same": same, "items": arrays([in_order(x, sketch.value) for x in own])}

    marked = base.select("id", "text", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("own"))
    rows = materialize(batches(marked, summary, "id bigint, own binary, n bigint, fp bigint, fp2 bigint, hist array<tinyint>"), "sets")
    # Equal sets (size and 128 bits) are one node.
    least = F.min(F.struct("id", "own")).alias("first")
    classes = rows.where("n > 0 AND id IS NOT NULL").groupBy("fp", "fp2", "n").agg(least, F.any_value("hist").alias("hist"), F.count(F.lit(1)).alias("copies"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    hashed = batches(base.where("id IS NOT NULL").select("text"), keys, "key bigint, node bigint")
    meeting = materialize(shared_keys(hashed).select("key", "node"), "meeting")
    named = meeting.join(classes.select("fp", F.col("node").alias("class")), meeting["node"] == F.col("fp")).select("key", F.col("class").alias("node"))
    named = materialize(distinct_groups(shared_keys(named)), "named")
    sizes = materialize(classes.select("node", "n", "fp", "fp2", F.col("first.id").alias("id"), "hist").join(named.select("node").distinct(), "node", "left_semi"), "sizes")

    def full(nodes: DataFrame) -> DataFrame:
        """Sets of nodes in global order. Of rows that share an id, those of another text are not the node's set."""
        needed = matching(base, nodes.join(sizes, "node").select("node", "id", "fp", "fp2"), "id", "inner").select("node", "text", "fp", "fp2")
        return batches(needed, ordered, "node bigint, same boolean, items array<bigint>").where("same").select("node", "items")

    linker = Linker(spark, lambda pairs: verify(pairs, sizes, full, percent))
    linker.stars(named)
    linker.rest(named, sizes.select("node", "n", "hist"), fits("l", "r", percent), percent)
    placed = classes.drop("hist").join(linker.labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    tops = placed.groupBy("component").agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    placed = placed.withColumnRenamed("first", "own_first").join(tops.drop("parts"), "component", "left")
    first = F.coalesce("first", "own_first").alias("first")
    return rows.drop("hist"), materialize(placed.select("fp", "fp2", "n", "copies", first), "placed")


CLASS = ["fp", "fp2", "n"]


def join(documents: DataFrame, *, width: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``documents``: id, ``n_shingles``, ``component_id`` (the smallest id reachable by links, itself included)."""
    rows, classes = grouped(documents, width, percent, id_col, text_col)
    met = lookup(rows.where("n > 0"), classes, CLASS, "copies")
    component = F.coalesce(F.when(F.col("id").isNotNull(), F.col("first.id")), "id").alias("component_id")
    linked = met.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component)
    return linked.unionByName(rows.where("n = 0").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("id").alias("component_id")))


def arrays(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(x) for x in rows], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*rows, np.zeros(0, np.uint64)]).view(np.int64)))


def matching(df: DataFrame, ids: DataFrame, column: str | list[str], how: str = "left_semi") -> DataFrame:
    """A join with ids; these are broadcast only where their number is checked to be small."""
    return df.join(F.broadcast(ids) if ids.count() <= SMALL else ids, column, how)


def histogram(own: np.ndarray) -> np.ndarray:
    """How many of a set's hashes fall in each of ``CELLS`` cells, modulo 256 (a byte a cell, signed)."""
    return np.bincount((own & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS).astype(np.int8)


def fits(a: str, b: str, percent: int) -> str:
    """SQL, true for every pair of rows that can link: their sizes allow it, and the cells' counts differ by no more
    than the sets may. (The summed differences never exceed the symmetric difference, modulo 256 the less, so no link is lost.)"""
    total = f"({a}.n + {b}.n)"
    most = f"({total} - 2 * ceil({percent} * {total} / {100 + percent}))"
    apart = f"aggregate(zip_with({a}.hist, {b}.hist, (p, q) -> abs(((CAST(p AS INT) - CAST(q AS INT) + 128) & 255) - 128)), 0, (s, d) -> s + d)"
    return f"least({a}.n, {b}.n) * 100 >= greatest({a}.n, {b}.n) * {percent} AND {apart} <= {most}"


def fitting(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    near = pairs.join(sizes.alias("x"), F.expr("a = x.node")).join(sizes.alias("y"), F.expr("b = y.node")).where(fits("x", "y", percent))
    return materialize(near.select("a", "b"), "near")


def nodes_of(near: DataFrame) -> DataFrame:
    return materialize(near.select(F.col("a").alias("node")).union(near.select("b")).distinct(), "needed")


def verify(pairs: DataFrame, sizes: DataFrame, full, percent: int) -> DataFrame:
    """The pairs (a, b) that link. Each ``a`` probes a trie of its ``b`` sets; many are dealt to several tasks.

    ``full(nodes)`` fetches sets, of the nodes in pairs of fitting sizes only.
    """
    near = fitting(pairs, sizes, percent)
    probes = near.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PORTION).cast("int").alias("portions"))
    members = near.join(probes, "a").select(F.col("a").alias("x"), F.pmod(F.xxhash64("b"), F.col("portions")).alias("y"), F.col("b").alias("node"), F.lit(0).alias("kind"))
    heads = probes.select(F.col("a").alias("x"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("portions") - 1)).alias("y"), F.col("a").alias("node"), F.lit(1).alias("kind"))
    return probe(members.unionByName(heads), materialize(full(nodes_of(near)), "full"), percent)


def probe(rows: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """Within each (x, y): the sets of kind 0 make a trie, those of kind 1 probe it one after another."""
    dealt = rows.join(own, "node").repartition("x", "y").sortWithinPartitions("x", "y", "kind", "node")

    def run(parts):
        group, trie, found, last = None, None, [], None
        for batch in parts:
            items = batch.column(4)
            flat, offsets = np.asarray(items.flatten(), dtype=np.int64).view(np.uint64), np.asarray(items.offsets)
            offsets = offsets - offsets[0]
            for k, (x, y, node, kind) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True)):
                if last == (x, y, kind, node):  # a repeated row's set
                    continue
                one, last = flat[offsets[k] : offsets[k + 1]], (x, y, kind, node)
                if group != (x, y):
                    group, trie = (x, y), Trie()
                if kind == 0:
                    trie.add(node, one.copy())
                else:
                    found += [(node, b) for b in trie.similar(one, percent) if b != node]
            if len(found) > 5000:
                yield links(found)
                found = []
        if found:
            yield links(found)

    return dealt.select("x", "y", "node", "kind", "items").mapInArrow(run, "a bigint, b bigint")


def links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


def keep_one(documents: DataFrame, *, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, unchanged: the one with the smallest id, of several texts under that id the one with
    the smallest digest, of repeated rows of it the first by their JSON. Rows decide by id and text, so another text under the
    same id is judged by itself. Rows with a null id or without words all stay."""
    rows, classes = grouped(documents, width, percent, id_col, text_col)
    met = lookup(rows.where("n > 0 AND id IS NOT NULL"), classes, CLASS, "copies").withColumn("won", F.expr("id = first.id AND own = first.own"))
    judged = materialize(met.groupBy("id", "own", "won").agg(F.count(F.lit(1)).alias("copies")), "judged")
    key, own = fresh(documents, "key"), fresh(documents, "own")
    marked = documents.withColumns({key: F.col(f"`{id_col}`").cast("long"), own: F.unhex(F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))})
    named = lambda df: df.select(F.col("id").alias(key), F.col("own").alias(own))
    gone, repeated = named(judged.where("NOT won OR copies > 1")), named(judged.where("won AND copies > 1"))
    columns = [F.col(f"`{c}`") for c in documents.columns]
    kept = matching(marked, gone, [key, own], "left_anti").select(columns)
    if not repeated.limit(1).count():
        return kept
    whole = F.struct(columns)
    one = matching(marked, repeated, [key, own]).groupBy(key, own).agg(F.min_by(whole, F.to_json(whole)).alias("row"))
    return kept.unionByName(one.select("row.*"))
