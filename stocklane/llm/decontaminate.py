"""Benchmark decontamination: a broadcast hash set of test n-grams scanned over training token windows.

Words are runs of ASCII digits, ASCII letters (lower-cased) and any code point above U+007F. A window is
``width`` consecutive words of one benchmark item; an item of fewer words, but not none, is one window.

The benchmark's windows go to the executors in broadcast sets of a bounded number of words (``set_words``), streamed
one after another; nothing is dropped, an item longer than a set is cut where its windows still overlap, and no broadcast
grows with the data. With one set, the usual case, documents are neither shuffled nor written. With several, each set's hits
(documents that have any, by a digest of the text) are written, merged and joined to the documents at the end; the documents
themselves are only read.

Defined results: null and empty texts have no words and are clean; a repeated document row is judged by
itself; items with null or wordless text never match; a null item_id is skipped; a very long text is scanned alone; other
columns, also ones named like the result's, play no part. An empty benchmark leaves every document clean.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocklane.llm.common import batches, fresh, lookup, materialize, utf8

#: Bytes outside words become spaces, A-Z become a-z; bytes of longer UTF-8 sequences stay.
FOLD = bytes(x if x >= 0x80 or chr(x) in "0123456789abcdefghijklmnopqrstuvwxyz" else x + 32 if 0x41 <= x <= 0x5A else 0x20 for x in range(256))
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class WindowSet:
    """The windows of some benchmark items: word numbers, rolling hashes by length, items by exact window."""

    def __init__(self, items: list[tuple[str, bytes]], width: int):
        self.numbers: dict[bytes, int] = {}
        self.items: dict[bytes, list[str]] = {}
        hashes: dict[int, set[int]] = {}
        for item, text in items:
            ids = np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in words(text)], np.int32)
            if len(ids):
                n = min(width, len(ids))
                for at, h in enumerate(rolling(ids, n)):
                    owners = self.items.setdefault(ids[at : at + n].tobytes(), [])
                    if item not in owners:
                        owners.append(item)
                    hashes.setdefault(n, set()).add(int(h))
        self.hashes = {n: np.sort(np.fromiter(x, np.uint64, len(x))) for n, x in hashes.items()}

    def scan(self, texts: list[bytes]) -> list[tuple[int, np.ndarray, set[str]]]:
        """For each text: its number of words, which of them are hit, the items that occur."""
        get, none = self.numbers.get, np.zeros(0, bool)
        split = [words(t) for t in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        ids = np.fromiter((get(w, 0) for s in split for w in s), np.int32, int(sizes.sum()))
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(split)), sizes)
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        found: dict[int, tuple[np.ndarray, set[str]]] = {}
        for n, hashes in self.hashes.items():
            if len(ids) < n:
                continue
            full = np.flatnonzero(known[n:] - known[:-n] == n)
            full = full[owner[full] == owner[full + n - 1]]
            hit = np.isin(rolling_at(ids, full, n), hashes)
            for at in full[hit].tolist():
                if items := self.items.get(ids[at : at + n].tobytes()):  # the hash is verified
                    k = int(owner[at])
                    mask, own = found.setdefault(k, (np.zeros(int(sizes[k]), bool), set()))
                    start = at - int(ends[k] - sizes[k])
                    mask[start : start + n] = True
                    own.update(items)
        return [(int(sizes[k]), *found.get(k, (none, set()))) for k in range(len(split))]


def rolling(ids: np.ndarray, n: int) -> np.ndarray:
    return rolling_at(ids, np.arange(len(ids) - n + 1), n)


def rolling_at(ids: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    h = np.zeros(len(starts), np.uint64)
    for k in range(n):
        h = h * BASE + ids[starts + k].astype(np.uint64)
    return h


def pieces(text: bytes, width: int, most: int):
    """``text``, or parts of it of ``most`` words that overlap by a window less one word."""
    found = words(text)
    if len(found) <= most:
        yield text, len(found)
        return
    for at in range(0, len(found) - width + 1, most - width + 1):
        yield b" ".join(found[at : at + most]), most


def window_sets(benchmark: DataFrame, width: int, set_words: int, item_col: str, text_col: str):
    """The items in lists of about ``set_words`` words at most, streamed partition by partition."""
    rows = benchmark.where(F.col(item_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")
    )
    held, size = [], 0
    for row in rows.toLocalIterator():
        for text, n in pieces(row["text"].encode(), width, max(set_words, 2 * width)):
            if held and size + n > set_words:
                yield held
                held, size = [], 0
            held.append((row["item"], text))
            size += n
    if held:
        yield held


HITS = "struct<n_words:bigint,mask:binary,items:array<string>>"


def scan(documents: DataFrame, benchmark: DataFrame, *, width: int = 10, set_words: int = 2_000_000, text_col: str = "text", item_col: str = "item_id", bench_text_col: str = "text", hits_col: str = "hits") -> DataFrame:
    """``documents`` plus one struct column ``hits_col`` (a column of that name is replaced): n_words, mask (a byte a word, empty
    if clean), items."""
    kept = documents.select(*[F.col(f"`{c}`") for c in documents.columns if c != hits_col])
    sets = window_sets(benchmark, width, set_words, item_col, bench_text_col)
    first, second = next(sets, []), next(sets, None)
    if second is None:
        return one_set(kept, first, width, text_col, hits_col)
    found = None
    texts = kept.select(F.unhex(F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256)).alias("digest"), F.col(f"`{text_col}`").alias("text"))
    while first:
        hit = one_set(texts, first, width, "text", "hits").where(F.size("hits.items") > 0).select("digest", "hits.mask", "hits.items")
        hit = materialize(hit.groupBy("digest").agg(F.any_value("mask").alias("mask"), F.any_value("items").alias("items"), F.count(F.lit(1)).alias("copies")), "hits")
        found = hit if found is None else found.unionByName(hit)
        first, second = second, next(sets, None)
    digest, hits = fresh(kept, "digest"), fresh(kept, "merged")
    table = merged(found).withColumnRenamed("digest", digest).select(digest, F.struct("mask", "items").alias(hits), "copies")
    copies = fresh(kept, "copies")
    table = materialize(table.withColumnRenamed("copies", copies), "merged")
    marked = one_set(kept, [], width, text_col, hits_col).withColumn(digest, F.unhex(F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256)))
    joined = lookup(marked, table, [digest], copies)
    whole = F.struct(F.col(f"`{hits_col}`.n_words").alias("n_words"), F.coalesce(f"{hits}.mask", F.lit(b"")).alias("mask"), F.coalesce(f"{hits}.items", F.array().cast("array<string>")).alias("items"))
    return joined.withColumn(hits_col, whole).select(*kept.columns, hits_col)


def merged(found: DataFrame) -> DataFrame:
    """The hits of several sets by text: a word is hit if it is in any of them."""

    def step(batch):
        masks = [np.max([np.frombuffer(m, np.uint8) for m in own], axis=0).tobytes() for own in batch.column(1).to_pylist()]
        return {"digest": batch.column(0), "mask": masks, "items": batch.column(2), "copies": batch.column(3)}

    whole = found.groupBy("digest").agg(F.collect_list("mask").alias("masks"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("copies").alias("copies"))
    return batches(whole.select("digest", "masks", "items", "copies"), step, "digest binary, mask binary, items array<string>, copies bigint")


def one_set(documents: DataFrame, items: list[tuple[str, bytes]], width: int, text_col: str, hits_col: str) -> DataFrame:
    """``documents`` plus ``hits_col`` for the items of one set."""
    shared = documents.sparkSession.sparkContext.broadcast((items, width))
    built: list[WindowSet] = []

    def step(batch):
        if not built:
            built.append(WindowSet(*shared.value))
        columns = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
        result = built[0].scan(utf8(columns[text_col]))
        return columns | {hits_col: [{"n_words": n, "mask": mask.astype(np.uint8).tobytes(), "items": sorted(own)} for n, mask, own in result]}

    return batches(documents, step, documents.withColumn(hits_col, F.lit(None).cast(HITS)).schema)


def report(documents: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256 (hex of the sorted, comma-joined items), contaminated."""
    text = options.get("text_col", "text")
    found = scan(documents.select(id_col, text), benchmark, **options)
    items = F.array_sort("hits.items")
    n_hit = F.length(F.translate(F.hex("hits.mask"), "0", "")).cast("long")
    return found.select(
        id_col,
        F.col("hits.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def drop_documents(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents in which no window of the benchmark occurs, unchanged."""
    own = fresh(documents, "hits")
    found = scan(documents, benchmark, hits_col=own, **options)
    return found.where(F.size(f"{own}.items") == 0).select(*[F.col(f"`{c}`") for c in documents.columns])


def drop_spans(documents: DataFrame, benchmark: DataFrame, *, text_col: str = "text", mark: str = "\n", **options) -> DataFrame:
    """Every document, its hit words cut out with all between them; ``mark`` stands where a span was.

    What is left of a hit span's neighbours cannot form a new window by accident only if ``mark`` is no word
    break within a window, so the cut is repeated on the result until no window occurs (each pass removes
    words, and a pass over clean texts changes nothing).
    """

    def cut(batch):
        columns = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
        texts = []
        for text, hit in zip(columns[text_col].to_pylist(), columns[own].to_pylist(), strict=True):
            mask = np.frombuffer(hit["mask"], np.uint8)
            texts.append(text if text is None or not mask.any() else without(text, mask, mark))
        return columns | {text_col: pa.array(texts, pa.string())}

    out, own = documents, fresh(documents, "hits")
    while True:
        found = materialize(scan(out, benchmark, text_col=text_col, hits_col=own, **options), "spans")
        if not found.where(F.size(f"{own}.items") > 0).limit(1).count():
            return found.select(*[F.col(f"`{c}`") for c in documents.columns])
        out = batches(found, cut, found.schema).drop(own)


def without(text: str, mask: np.ndarray, mark: str) -> str:
    data = text.encode()
    folded = np.frombuffer(data.translate(FOLD), np.uint8) != 0x20
    edge = np.diff(np.concatenate([[False], folded, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    keep, at = [], 0
    runs = np.diff(np.concatenate([[0], mask, [0]]).astype(np.int8))
    for a, b in zip(np.flatnonzero(runs == 1), np.flatnonzero(runs == -1), strict=True):
        keep.append(data[at : starts[a]])
        at = int(ends[b - 1])
    keep.append(data[at:])
    return mark.join(x.decode() for x in keep)

