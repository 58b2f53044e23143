"""Fuzzy line dedup by MinHash.

Trimmed lines of at least ``min_chars`` characters, runs of blanks in them as one, are sets of character shingles
(``width`` code points, ASCII letters lower-cased; a shorter line is one shingle). Signatures of ``bands * rows`` minima,
vectorised over a batch, are cut into bands; lines that share a band are candidates, verified by the exact Jaccard
similarity of their shingle sets (``percent`` hundredths or more). Links become components by distributed
union-find, and of each component the line that comes first (by document id, then line number) stays. Several texts under
one id are documents of their own, told apart by ``text_key`` and ordered by it.

Every two lines of a band are verified, ruled out by an exact necessary condition or already in one component. Best pivots
and delegates of each band come first, then all pairs of a band that are left in different components. Before lines are
fetched, pairs have to pass their numbers of distinct shingles and a parity sketch of 1024 cells a line. Where more than
``crowd`` lines of a band are left (variants of one template), it is cut into finer keys by its lines' rarest shingles, as
many as two lines of the wanted similarity cannot both miss, and the same rounds run on these. So a crowd of variants costs by
the shingles that they share beyond the template.
With 6 bands of 4 rows a pair at similarity 0.8 is a candidate with probability 0.95, at 0.85 with 0.99, at 0.9 with
0.998; equal lines always are, as they are one node (by 128 bits).

Defined results: null and empty texts have no lines and stay as they are; lines shorter than ``min_chars`` always stay;
a document with a null id keeps its lines and claims none; rows repeated with one id lose the same lines; an empty table
loses none; a very long text or line is one slice of its own; further columns pass through. A document may end up with an
empty text: it stays, with that text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocklane.llm.common import batches, fresh, lookup, materialize
from stocklane.llm.components import CROWD, Linker, distinct_groups, shared_keys
from stocklane.llm.jaccard_join import matching, prefix_length

WIDTH = 9
BANDS, PER_BAND = 6, 4
MIN_CHARS = 10
CHUNK_CHARS = 200_000
PAD = 0x9E3779B1
#: 64-bit words of a line's parity sketch.
WORDS = 16
#: Bits of a shingle's hash, behind the number of its line in a portion.
HASH_BITS = 44
#: Lines that a task remembers so as not to describe them again (about 30 MB).
SEEN = 200_000
#: Cells of the sketch that counts shingles, for their order by rarity: 1 MB a task.
SKETCH_BITS = 18
#: Dropped line numbers (and four more a document) up to which their table is broadcast: about 32 MB.
SMALL = 4_000_000
LOWER = {x: x + 32 for x in range(65, 91)}


def eligible(text: str | None, min_chars: int) -> list[tuple[int, str]]:
    """Number and trimmed form of the lines that take part."""
    if not text:
        return []
    found = [(k, own) for k, line in enumerate(text.split("\n")) if len(own := line.strip()) >= min_chars]
    return [(k, " ".join(own.split()) if "  " in own or "\t" in own else own) for k, own in found] if "  " in text or "\t" in text else found


def name(line: str) -> tuple[int, int]:
    """128 bits of a line as two signed numbers; the first is its node."""
    x = xxhash.xxh3_128_intdigest(line.encode())
    return tuple(h - (1 << 64) if h >> 63 else h for h in (x & 0xFFFFFFFFFFFFFFFF, x >> 64))


class Fresh:
    """Lines that a task has not met before, as far as it remembers."""

    def __init__(self):
        self.seen: set[int] = set()

    def __call__(self, texts: list, min_chars: int) -> tuple[list[str], np.ndarray]:
        if len(self.seen) > SEEN:
            self.seen.clear()
        lines, names = [], []
        for text in texts:
            for _, line in eligible(text, min_chars):
                own = name(line)
                if own[0] not in self.seen:
                    self.seen.add(own[0])
                    lines.append(line)
                    names.append(own)
        return lines, np.array(names, np.int64).reshape(-1, 2)


def shingle_hashes(lines: list[str], width: int, kind=np.uint32) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (``kind``) of all shingles of the lines, and where each line's begin. Lines shorter than ``width`` are padded."""
    lines = [x if len(x) >= width else x.ljust(width, "\0") for x in lines]
    points = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32)
    points = (points + ((points >= 65) & (points <= 90)) * np.uint32(32)).astype(kind)
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    bits = 8 * points.itemsize
    h, done, factor, half = points * kind(PAD) + kind(1), 1, PAD, kind(bits // 2 - 1)
    total = h
    while done * 2 <= width:  # shingles of doubled width from two halves
        factor = factor * 0x85EBCA6B1B873593 % 2**bits
        total = total[:-done] * kind(factor) + total[done:]
        total ^= total >> half
        done *= 2
    for k in range(done, width):
        total = total[:-1] * kind(0xC2B2AE3D27D4EB4F % 2**bits) + h[k:]
        total ^= total >> half
    ends = np.cumsum(sizes)
    counts = sizes - width + 1
    # Positions whose shingle would cross into the next line go.
    mark = np.zeros(len(points) + 1, np.int8)
    mark[ends[:-1] - width + 1] = 1
    mark[ends[:-1]] = -1
    keep = np.cumsum(mark[: len(total)], dtype=np.int8) == 0
    return total[keep], np.cumsum(counts) - counts


def signatures(lines: list[str], width: int, bands: int, per_band: int) -> np.ndarray:
    """A 64-bit key for each line and band."""
    h, starts = shingle_hashes(lines, width)
    rng = np.random.default_rng(11)
    factors = rng.integers(1, 2**31, bands * per_band).astype(np.uint32) * np.uint32(2) + np.uint32(1)
    masks = rng.integers(0, 2**32, bands * per_band, dtype=np.uint32)
    keys, x = np.zeros((len(lines), bands), np.uint64), np.empty_like(h)
    for b in range(bands):
        own = np.full(len(lines), b + 1, np.uint64)
        for k in range(b * per_band, (b + 1) * per_band):
            np.bitwise_xor(h, masks[k], out=x)
            np.multiply(x, factors[k], out=x)
            own = (own ^ np.minimum.reduceat(x, starts).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            own ^= own >> np.uint64(29)
        keys[:, b] = own
    return keys


def lowered(line: str) -> str:
    return line if line.islower() else line.translate(LOWER)


def shingle_set(line: str, width: int) -> frozenset:
    """The distinct shingles of a lower-cased line."""
    return frozenset(line[k : k + width] for k in range(max(1, len(line) - width + 1)))


def distinct_hashes(lines: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each line as hashes of ``HASH_BITS`` bits behind the line's number, sorted, and how many each
    line has. (In a line of 500 shingles two of them share a hash once in a hundred million lines.)"""
    h, starts = shingle_hashes(lines, width, np.uint64)
    owner = np.repeat(np.arange(len(lines), dtype=np.uint64), np.diff(np.append(starts, len(h))))
    h *= np.uint64(0x9E3779B97F4A7C15)
    own = np.sort(owner << np.uint64(HASH_BITS) | h >> np.uint64(64 - HASH_BITS))
    own = own[np.concatenate([[True], own[1:] != own[:-1]])]
    return own, np.bincount((own >> np.uint64(HASH_BITS)).astype(np.int64), minlength=len(lines))


def sketches(lines: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """How many distinct shingles each line has; ``WORDS`` 64-bit words a line: for each cell whether an odd number falls in it."""
    own, counts = distinct_hashes(lines, width)
    cells = 64 * WORDS
    at = (own >> np.uint64(HASH_BITS)).astype(np.int64) * cells + (own & np.uint64(cells - 1)).astype(np.int64)
    odd = np.bincount(at, minlength=cells * len(lines)) & 1
    return counts, np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(len(lines), WORDS)


def fits(a: str, b: str, percent: int) -> str:
    """SQL, true for every pair of rows that can link: their sizes allow it, and no more cells' parities differ than the
    sets may. (Each cell that differs holds a hash of a shingle that only one of them has, so no link is lost.)"""
    total = f"({a}.n + {b}.n)"
    most = f"({total} - 2 * ceil({percent} * {total} / {100 + percent}))"
    apart = " + ".join(f"bit_count({a}.s{k} ^ {b}.s{k})" for k in range(WORDS))
    return f"least({a}.n, {b}.n) * 100 >= greatest({a}.n, {b}.n) * {percent} AND {apart} <= {most}"


def sorted_hashes(lines: list[str], width: int) -> list[np.ndarray]:
    """The distinct shingles of each line as sorted 64-bit hashes."""
    found = []
    for part in portions(lines):
        h, starts = shingle_hashes(part, width, np.uint64)
        for one in np.split(h, starts[1:]):
            own = np.sort(one)
            found.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
    return found


def jaccard_links(a: list[int], b: list[int], x: list[str], y: list[str], percent: int, width: int):
    """Of pairs (a, b) with their texts (x, y), those that link. Shingles are compared by hash; where one equal hash more or less
    would change the answer, the shingles themselves decide."""
    lines = dict(zip(a, x, strict=True)) | dict(zip(b, y, strict=True))
    own = dict(zip(lines, sorted_hashes([*lines.values()], width), strict=True))
    for i, j in zip(a, b, strict=True):
        p, q = own[i], own[j]
        both = np.sort(np.concatenate([p, q]), kind="stable")
        both = int(np.count_nonzero(both[1:] == both[:-1]))
        margin = 100 * both - percent * (len(p) + len(q) - both)
        if abs(margin) <= 100 + percent:
            s, t = (shingle_set(lowered(lines[k]), width) for k in (i, j))
            margin = 100 * len(s & t) - percent * len(s | t)
        if margin >= 0:
            yield i, j


def text_key(text: str | Column) -> Column:
    """A digest that, with its id, names a document."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def portions(lines: list[str]):
    """Lists of lines of a bounded number of characters in all."""
    held, size = [], 0
    for line in lines:
        held.append(line)
        size += len(line)
        if size > CHUNK_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def dropped_lines(documents: DataFrame, *, width: int = WIDTH, bands: int = BANDS, per_band: int = PER_BAND, percent: int = 80, min_chars: int = MIN_CHARS, crowd: int = CROWD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``mark`` (``text_key``), ``gone``: the numbers of the lines that each document loses; documents that lose none are absent."""
    base = documents.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), text_key(text_col).alias("mark"))
    full, labels = labelled_lines(base, width, bands, per_band, percent, min_chars, crowd)

    def occurrences(batch):
        found = [(i, mark, k, *name(line)) for i, text, mark in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True) for k, line in eligible(text, min_chars)]
        return dict(zip(("id", "mark", "number", "node", "check"), zip(*found, strict=True) if found else ([],) * 5, strict=True))

    rows = materialize(batches(base, occurrences, "id bigint, mark bigint, number int, node bigint, check bigint"), "occurrences")
    # Equal lines first, so neither a line nor a component that a third of all rows hold meets in one task.
    lines = rows.groupBy("node", "check").agg(F.min(F.struct("id", "mark", "number")).alias("first"), F.count(F.lit(1)).alias("copies"))
    known = full.select("node", "check").join(labels, "node")
    placed = materialize(lines.join(known, ["node", "check"], "left"), "placed")
    linked, alone = placed.where("component IS NOT NULL"), placed.where("component IS NULL AND copies > 1")
    tops = linked.groupBy("component").agg(F.min("first").alias("top"))
    several = linked.join(tops, "component").select("node", "check", "top", "copies").unionByName(alone.select("node", "check", F.col("first").alias("top"), "copies"))
    met = lookup(rows, materialize(several, "several"), ["node", "check"], "copies")
    gone = met.where("top IS NOT NULL AND (id <> top.id OR mark <> top.mark OR number <> top.number)")
    return gone.groupBy("id", "mark").agg(F.array_sort(F.collect_set("number")).alias("gone"))


def labelled_lines(base: DataFrame, width: int, bands: int, per_band: int, percent: int, min_chars: int, crowd: int) -> tuple[DataFrame, DataFrame]:
    """The lines that share a band with others (node, check, line, ...), and the components (node, component) of those that link.
    Of different lines with one node (64 bits) the smallest ``check`` is the node's line; the others link with nothing."""
    unseen, named = Fresh(), Fresh()

    def keys(batch):
        lines, nodes = unseen(batch.column(0).to_pylist(), min_chars)
        found = np.concatenate([*(signatures(part, width, bands, per_band) for part in portions(lines)), np.zeros((0, bands), np.uint64)])
        return {"key": found.ravel().view(np.int64), "node": np.repeat(nodes[:, 0], bands)}

    hashed = batches(base.select("text"), keys, "key bigint, node bigint")
    meeting = materialize(shared_keys(hashed), "meeting")
    wanted = materialize(meeting.select("node").distinct(), "wanted")

    def texts(batch):
        lines, nodes = named(batch.column(0).to_pylist(), min_chars)
        return {"node": nodes[:, 0], "check": nodes[:, 1], "line": lines}

    def described(batch):
        found = [sketches(part, width) for part in portions(batch.column(2).to_pylist())]
        words = np.concatenate([*(w for _, w in found), np.zeros((0, WORDS), np.int64)])
        sizes = np.concatenate([*(n for n, _ in found), np.zeros(0, np.int64)])
        return {"node": batch.column(0), "check": batch.column(1), "line": batch.column(2), "n": sizes} | {f"s{k}": words[:, k] for k in range(WORDS)}

    columns = ", ".join(f"s{k} bigint" for k in range(WORDS))
    found = matching(batches(base.select("text"), texts, "node bigint, check bigint, line string"), wanted, "node")
    one = found.groupBy("node").agg(F.min(F.struct("check", "line")).alias("own")).select("node", "own.*")
    full = materialize(batches(one, described, f"node bigint, check bigint, line string, n bigint, {columns}"), "lines")
    features = full.drop("check", "line")

    def verify(pairs: DataFrame) -> DataFrame:
        near = pairs.join(features.alias("l"), F.expr("a = l.node")).join(features.alias("r"), F.expr("b = r.node")).where(fits("l", "r", percent)).select("a", "b")
        left, right = (full.select(F.col("node").alias(c), F.col("line").alias(f"line_{c}")) for c in "ab")
        met = materialize(near, "near").join(left, "a").join(right, "b")

        def step(batch):
            linked = [*jaccard_links(*(batch.column(k).to_pylist() for k in range(4)), percent, width)]
            return {"a": [p for p, _ in linked], "b": [q for _, q in linked]}

        return batches(met.select("a", "b", "line_a", "line_b"), step, "a bigint, b bigint")

    linker = Linker(base.sparkSession, verify)
    linker.stars(meeting)
    left = linker.open(meeting)
    few = left.where(F.col("crowd") <= crowd).select("key", "node")
    linker.rest(few, features, fits("l", "r", percent), percent)
    large = left.where(F.col("crowd") > crowd).select(F.col("key").alias("band"), "node")
    if large.limit(1).count():
        lines = materialize(matching(full.select("node", "line"), large.select("node").distinct(), "node"), "crowd")
        rare = large.join(rare_shingles(lines, width, percent), "node").select(F.xxhash64("band", "key").alias("key"), "node")
        rare = materialize(distinct_groups(shared_keys(rare)), "rare")
        linker.stars(rare)
        linker.rest(rare, features, fits("l", "r", percent), percent)
    return full, linker.labels


def rare_shingles(lines: DataFrame, width: int, percent: int) -> DataFrame:
    """Rows (key, node): of each line (node, line) its rarest shingles, as many as it has beyond those that a line of
    similarity ``percent`` must share, and one; lines that link share a key. The order is by a count sketch of fixed size
    over all ``lines``, ties by hash."""

    def counted(parts):
        total = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in parts:
            for part in portions(batch.column(0).to_pylist()):
                np.add.at(total, (distinct_hashes(part, width)[0] & np.uint64(len(total) - 1)).astype(np.int64), np.uint32(1))
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0].astype(np.int64))], names=["cell", "n"])

    cells = lines.select("line").mapInArrow(counted, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    sketch = np.zeros(1 << SKETCH_BITS, np.int64)
    sketch[np.asarray(cells["cell"].combine_chunks())] = np.asarray(cells["n"].combine_chunks())
    shared = lines.sparkSession.sparkContext.broadcast(sketch)

    def keys(batch):
        out, nodes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        node, at = np.asarray(batch.column(0), dtype=np.int64), 0
        for part in portions(batch.column(1).to_pylist()):
            own, counts = distinct_hashes(part, width)
            line, h = (own >> np.uint64(HASH_BITS)).astype(np.int64), own & np.uint64((1 << HASH_BITS) - 1)
            order = np.lexsort((h, shared.value[(h & np.uint64(len(sketch) - 1)).astype(np.int64)], line))
            head = np.arange(len(own)) - (np.cumsum(counts) - counts)[line] < prefix_length(counts, percent)[line]
            out.append(h[order][head].astype(np.int64))
            nodes.append(node[at : at + len(part)][line[head]])
            at += len(part)
        return {"key": np.concatenate(out), "node": np.concatenate(nodes)}

    return batches(lines.select("node", "line"), keys, "key bigint, node bigint")


def dedup(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``documents`` with their texts shortened, plus ``gone``, the numbers of the lines they lost (null: none)."""
    kept = documents.select(*[F.col(f"`{c}`") for c in documents.columns if c != "gone"])
    own = fresh(kept, "_mark")
    gone = materialize(dropped_lines(documents, id_col=id_col, text_col=text_col, **options).withColumnsRenamed({"id": id_col, "mark": own}), "gone")
    split = F.transform(F.split(text_col, "\n", -1), lambda line, k: F.struct(line.alias("line"), k.alias("k")))
    left = F.transform(F.filter(split, lambda x: ~F.array_contains("gone", x.k)), lambda x: x.line)
    # Shuffling every text is the way for a large table of dropped lines; a small one (checked) is broadcast.
    count = gone.agg(F.coalesce(F.sum(F.size("gone") + 6), F.lit(0))).first()[0]
    marked = kept.withColumn(own, text_key(text_col))
    joined = marked.join(F.broadcast(gone) if count <= SMALL else gone, [id_col, own], "left").withColumn(text_col, F.when(F.col("gone").isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n")))
    return joined.select(*kept.columns, "gone")


def report(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document: id, n_lines, n_dropped, ``text`` without the dropped lines."""
    cut = dedup(documents.select(id_col, text_col, F.size(F.split(F.coalesce(text_col, F.lit("")), "\n", -1)).cast("long").alias("n_lines")), id_col=id_col, text_col=text_col, **options)
    return cut.select(id_col, "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), F.col(text_col).alias("text"))
