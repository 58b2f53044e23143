"""Phrase collocation mining after Toivonen.

A sample of rows proposes phrases of one to ``LONGEST - 1`` words at a lowered threshold. A full pass then counts exactly, besides all single
words, every phrase whose beginning and end (all its words but the last, but the first) are proposed: the proposed phrases and
their negative border. A phrase that proves frequent but was not proposed is a border failure. If there is any, an expansion pass counts
the phrases that have not been counted and whose beginning and end are each known to be frequent, or not yet counted either and
so not known to be rare: the border moves through the unknown up to the longest phrases, so this pass closes it. Then every
frequent phrase has been counted, for all its parts are frequent, whatever the sample held.

Proposals go to tasks as a hash filter of at most ``MOST_BITS`` bits, made by Spark from hashed positions. A false hit only
makes a phrase counted that need not be, so results do not depend on the filter, and a full one costs time only. Tasks count portions of
``BYTES`` of text: words get numbers (equal hashes are compared byte by byte), phrases of w words get numbers from pairs of numbers, and Spark adds
up (lang, phrase) after a partial sum in each task. The rare ones are gone before anything is written.

Defined results: a null text is empty; a null lang is ``und``; A-Z become a-z, all other characters stay; ``[.,;:!?\\x0A-\\x0D]`` end a piece and
blanks and tabs part words, so a text without words has no phrases; repeated rows count each; ids play no part, null or not; an empty table gives no
rows; a text of any length is counted in portions that overlap by ``LONGEST - 1`` words; further columns play no part. Ties in rank go by frequency,
then by the phrase's bytes.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stocklane.llm.common import materialize, mix64, utf8

LEAST = 100
LONGEST = 5
TOP = 2000
#: Share of rows in the sample, and the share of the expected times that a phrase has to be there to be proposed (twice at least).
SAMPLE = 1 / 16
LOWERED = 0.8
SEED = 5
MOST_BITS = 1 << 27
BYTES = 1_000_000
#: A-Z become a-z, the characters that end a piece become line ends, tabs become blanks.
FOLD = bytes(x + 32 if 65 <= x <= 90 else 32 if x == 9 else 10 if 10 <= x <= 13 or x in b".,;:!?" else x for x in range(256))
NEXT_WORDS = re.compile(rb"(?:[ \n]*[^ \n]+){0,%d}" % (LONGEST - 1))
PRIME = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """The words of a folded portion: where they stand in ``packed`` (each followed by a blank), their pieces, numbers and hashes."""

    random = np.random.default_rng(11).integers(0, 2**64, 64 * 256, dtype=np.uint64, endpoint=False)
    odd = np.random.default_rng(12).integers(0, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    odd[0] = 1  # a word's hash is the same beside words of any length

    def __init__(self, text: bytes, lang: str):
        data = np.frombuffer(text, np.uint8)
        inside = (data != 32) & (data != 10)
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        self.first, self.sizes = edge[::2], edge[1::2] - edge[::2]
        self.n = len(self.first)
        self.piece = np.cumsum(data == 10, dtype=np.int32)[self.first] if self.n else np.zeros(0, np.int32)
        self.starts = np.cumsum(self.sizes + 1) - (self.sizes + 1)
        self.packed = np.full(int(self.sizes.sum()) + self.n, 32, np.uint8)
        place = np.arange(int(self.sizes.sum()), dtype=np.int32) - np.repeat((np.cumsum(self.sizes) - self.sizes).astype(np.int32), self.sizes)
        letters = data[inside]
        gaps = np.ones(len(self.packed), bool)  # the blank behind each word
        gaps[self.starts + self.sizes] = False
        self.packed[gaps] = letters
        if not self.n:
            self.hashes, self.number, self.shown = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            return
        value = self.random[((place & 63) << 8) | letters]
        if self.sizes.max() > 64:
            value = value * self.odd[(place >> 6) & 4095]
        salt = np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "big"))
        hashes = mix64(np.add.reduceat(value, np.cumsum(self.sizes) - self.sizes) + self.sizes.astype(np.uint64) + salt)
        _, self.shown, self.number = np.unique(hashes, return_index=True, return_inverse=True)
        self.hashes = hashes[self.shown]
        like = self.shown[self.number]
        if not np.array_equal(self.sizes, self.sizes[like]) or not np.array_equal(letters, self.packed[np.repeat(self.starts[like], self.sizes) + place]):
            self.by_bytes(hashes)

    def by_bytes(self, hashes: np.ndarray) -> None:
        """Numbers for a portion where two words share a hash."""
        seen: dict[bytes, int] = {}
        raw = self.packed.tobytes()
        words = [raw[a : a + n] for a, n in zip(self.starts.tolist(), self.sizes.tolist(), strict=True)]
        self.number = np.array([seen.setdefault(x, len(seen)) for x in words], np.int64)
        _, self.shown = np.unique(self.number, return_index=True)
        self.hashes = hashes[self.shown]

    def phrases(self, at: np.ndarray, width: int) -> pa.Array:
        """The phrases of ``width`` words that start at words ``at``."""
        start, last = self.starts[at], at + width - 1
        size = self.starts[last] + self.sizes[last] - start
        offsets = np.concatenate([[0], np.cumsum(size)])
        raw = self.packed[np.repeat(start - offsets[:-1], size) + np.arange(int(offsets[-1]))]
        return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw)])


def longer(beginning: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase from the hash of all its words but the last and that of the last."""
    return mix64(beginning * PRIME + word)


def bits_of(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Word and bits of a filter of ``size`` words that stand for ``h``."""
    one = np.uint64(1)
    mask = (one << (h & np.uint64(63))) | (one << (h >> np.uint64(6) & np.uint64(63))) | (one << (h >> np.uint64(12) & np.uint64(63)))
    return (h >> np.uint64(20)) & np.uint64(size - 1), mask


def holds(words: np.ndarray | None, h: np.ndarray) -> np.ndarray:
    if words is None:
        return np.zeros(len(h), bool)
    at, mask = bits_of(h, len(words))
    return (words[at.astype(np.int64)] & mask) == mask


def portions(text: bytes, most: int):
    """(bytes, owned): portions of a folded text; phrases that start in the first ``owned`` bytes belong to it, up to four more words follow."""
    at = 0
    while at < len(text):
        end = at + most
        if end >= len(text):
            yield text[at:], len(text) - at
            return
        ends = [x for x in (text.find(b" ", end), text.find(b"\n", end)) if x >= 0]
        end = min(ends, default=len(text))
        yield text[at : NEXT_WORDS.match(text, end).end()], end - at
        at = end


def by_lang(part: pa.RecordBatch) -> dict[str, list[bytes]]:
    found: dict[str, list[bytes]] = {}
    for lang, text in zip(part.column(0).to_pylist(), utf8(part.column(1)), strict=True):
        found.setdefault("und" if lang is None else lang, []).append(text)
    return found


def by_portion(parts, most: int):
    """(lang, folded portion, owned bytes), texts of a lang together, at most about ``most`` bytes."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for part in parts:
        for lang, texts in by_lang(part).items():
            for text in texts:
                held.setdefault(lang, []).append(text)
                size += len(text)
                if size > most:
                    for k, own in held.items():
                        for chunk, owned in portions(b"\n".join(own).translate(FOLD), most):
                            yield k, chunk, owned
                    held, size = {}, 0
    for k, own in held.items():
        for chunk, owned in portions(b"\n".join(own).translate(FOLD), most):
            yield k, chunk, owned


def proposals(docs: DataFrame, share: float, least: int, most: int = BYTES) -> DataFrame:
    """Hashes of the phrases that a sample has ``least`` times or more."""

    def count(parts):
        for lang, chunk, owned in by_portion(parts, most):
            w = Words(chunk, lang)
            mine = int(np.searchsorted(w.first, owned))
            own, h = w.hashes[w.number], w.hashes[w.number]
            for width in range(1, LONGEST):
                if width > 1:
                    h = longer(h[:-1], own[width - 1 :])
                fits = np.flatnonzero(w.piece[: len(h)] == w.piece[width - 1 :])
                found, n = np.unique(h[fits[fits < mine]], return_counts=True)
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["h", "n"])

    taken = docs.select("lang", "text").sample(fraction=share, seed=SEED)
    return taken.mapInArrow(count, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("h")


def phrase_hashes(phrases: DataFrame) -> DataFrame:
    """``phrases`` (lang, phrase) with their hashes ``h``."""

    def run(parts):
        for part in parts:
            langs, texts = part.column(0).to_pylist(), utf8(part.column(1))
            out = np.zeros(len(texts), np.uint64)
            for lang in set(langs):
                mine = [k for k, x in enumerate(langs) if x == lang]
                w = Words(b"\n".join(texts[k] for k in mine), lang)
                own = w.hashes[w.number]
                first, count = np.flatnonzero(np.diff(w.piece, prepend=-1)), np.bincount(w.piece, minlength=len(mine))
                h = own[first]
                for width in range(2, LONGEST + 1):
                    more = count >= width
                    h[more] = longer(h[more], own[first[more] + width - 1])
                out[mine] = h
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out.view(np.int64))], names=["lang", "phrase", "h"])

    return phrases.select("lang", "phrase").mapInArrow(run, "lang string, phrase string, h bigint")


def filter_words(hashes: DataFrame, size: int) -> np.ndarray:
    """A filter of ``size`` 64-bit words that holds all ``hashes``. At most ``size`` rows, so ``MOST_BITS`` in all, come to the driver."""

    def run(parts):
        for part in parts:
            at, mask = bits_of(np.asarray(part.column(0)).view(np.uint64), size)
            yield pa.RecordBatch.from_arrays([pa.array(at.view(np.int64)), pa.array(mask.view(np.int64))], names=["at", "mask"])

    found = hashes.mapInArrow(run, "at bigint, mask bigint").groupBy("at").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(size, np.uint64)
    out[np.asarray(found.column(0))] = np.asarray(found.column(1)).view(np.uint64)
    return out


def filter_size(n: int) -> int:
    """Words of a filter for ``n`` phrases: sixteen bits each, up to ``MOST_BITS``."""
    size = 1 << 10
    while size * 64 < min(16 * n, MOST_BITS):
        size *= 2
    return size


def counts(docs: DataFrame, now: np.ndarray, before: np.ndarray | None, least: int, most: int = BYTES) -> DataFrame:
    """(lang, phrase, n) of frequent phrases.

    The first pass (no ``before``) counts single words, all words of a lang as the empty phrase, and phrases with both parts in the
    filter ``now``. The expansion pass counts what the first, by the filter ``before``, has not: both parts are in ``now`` or uncounted.
    """
    sent = docs.sparkSession.sparkContext.broadcast((now, before))

    def count(parts):
        now, before = sent.value
        for lang, chunk, owned in by_portion(parts, most):
            w = Words(chunk, lang)
            mine = int(np.searchsorted(w.first, owned))
            mark = f"{len(lang)}:{lang}"
            out: list[tuple[pa.Array, np.ndarray]] = []
            if before is None and mine:
                yield pa.RecordBatch.from_arrays([pa.array([f"#{mark}"]), pa.array([mine], pa.int64())], names=["key", "n"])
                n = np.bincount(w.number[:mine], minlength=len(w.shown))
                out += [(w.phrases(w.shown[n > 0], 1), n[n > 0])]
            # Of each level: the words where a phrase stands, its number there; by number its hash and whether it may be part of more.
            at, number, hashes = np.arange(w.n), w.number, w.hashes
            inside, earlier = holds(now, hashes), holds(before, hashes)
            for width in range(2, LONGEST + 1):
                keep = inside[number]
                at, number = at[keep], number[keep]
                both = np.flatnonzero(at[1:] == at[:-1] + 1)
                both = both[w.piece[at[both]] == w.piece[at[both] + width - 1]]
                if not len(both):
                    break
                a, b, at = number[both], number[both + 1], at[both]
                pair, shown, number = np.unique(a * np.int64(len(hashes)) + b, return_index=True, return_inverse=True)
                counted = earlier[a[shown]] & earlier[b[shown]]
                n = np.bincount(number[at < mine], minlength=len(pair))
                new = (n > 0) & ~counted
                if new.any():
                    out += [(w.phrases(at[shown[new]], width), n[new])]
                hashes = longer(hashes[a[shown]], w.hashes[w.number[at[shown] + width - 1]])
                earlier = counted & holds(before, hashes)
                inside = holds(now, hashes) if before is None else ~counted | holds(now, hashes)
            for phrases, n in out:
                keys = pc.binary_join_element_wise(pa.scalar(mark, pa.large_string()), phrases, pa.scalar("", pa.large_string()))
                yield pa.RecordBatch.from_arrays([keys.cast(pa.string()), pa.array(n, pa.int64())], names=["key", "n"])
        pa.default_memory_pool().release_unused()

    # One string is the whole key: length of the lang, lang, phrase; a # in front of the words of a lang in all.
    found = docs.select("lang", "text").mapInArrow(count, "key string, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    found = found.where((F.col("n") >= least) | F.startswith("key", F.lit("#"))).withColumn("key", F.expr("ltrim('#', key)"))
    size = F.substring_index("key", ":", 1)
    found = found.select("n", size.cast("int").alias("size"), F.col("key").substr(F.length(size) + 2, F.length("key")).alias("key"))
    return found.select(F.expr("substring(key, 1, size)").alias("lang"), F.expr("substring(key, size + 1)").alias("phrase"), "n")


def parts_of_more(phrases: DataFrame) -> DataFrame:
    """Hashes of the phrases that are not the longest."""
    short = phrases.where((F.col("phrase") != "") & (F.regexp_count("phrase", F.lit(" ")) < LONGEST - 1))
    return phrase_hashes(short).select("h")


def outside(hashes: DataFrame, words: np.ndarray) -> DataFrame:
    """Hashes that the filter does not hold."""
    sent = hashes.sparkSession.sparkContext.broadcast(words)

    def run(parts):
        for part in parts:
            own = np.asarray(part.column(0)).view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(own[~holds(sent.value, own)].view(np.int64))], names=["h"])

    return hashes.mapInArrow(run, "h bigint")


def frequent(docs: DataFrame, least: int = LEAST, share: float = SAMPLE, most: int = BYTES) -> DataFrame:
    """(lang, phrase, n) of every phrase of up to ``LONGEST`` words with n >= ``least``, and the empty phrase with all words of the lang."""
    proposed = materialize(proposals(docs, share, max(2, int(LOWERED * least * share)), most), "proposed")
    filtered = filter_words(proposed, filter_size(proposed.count()))
    found = materialize(counts(docs, filtered, None, least, most), "counted")
    known = materialize(parts_of_more(found), "known")
    if not outside(known, filtered).limit(1).count():
        return found
    expanded = counts(docs, filter_words(known, filter_size(known.count())), filtered, least, most)
    return found.unionByName(materialize(expanded, "counted"))


def scored(found: DataFrame, least: int = LEAST) -> DataFrame:
    """Candidates that no longer one matches in frequency, at their lowest-scoring cut: lang, phrase, a, l, r, n, score."""
    total = found.where("phrase = ''").select("lang", F.col("n").alias("total"))
    phrases = found.where("phrase <> ''")
    long = phrases.select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w")).where("size(w) > 1")
    # A phrase inside a longer one of the same frequency is inside one that is a single word longer, of that frequency too.
    inner = long.where("size(w) > 2").select("lang", F.explode(F.array(F.expr("array_join(slice(w, 1, size(w) - 1), ' ')"), F.expr("array_join(slice(w, 2, size(w) - 1), ' ')"))).alias("phrase"), "a")
    inner = inner.groupBy("lang", "phrase").agg(F.max("a").alias("above"))
    kept = long.join(inner, ["lang", "phrase"], "left").where("above IS NULL OR 100 * above < 100 * a")
    cuts = kept.select("lang", "phrase", "a", "w", F.explode(F.expr("sequence(1, size(w) - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("left_part"), F.expr("array_join(slice(w, k + 1, size(w) - k), ' ')").alias("right_part"))
    left = phrases.select("lang", F.col("phrase").alias("left_part"), F.col("n").alias("l"))
    right = phrases.select("lang", F.col("phrase").alias("right_part"), F.col("n").alias("r"))
    met = cuts.join(left, ["lang", "left_part"]).join(right, ["lang", "right_part"]).join(total, "lang")
    wide = "CAST({} AS DECIMAL(20,0))"
    score = F.expr(f"CAST(CAST(1000 AS DECIMAL(4,0)) * {wide.format('a')} * CAST(total AS DECIMAL(14,0)) AS DECIMAL(38,0)) DIV CAST(CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)) AS DECIMAL(38,0))")
    best = met.withColumn("score", score).groupBy("lang", "phrase", "a", "total").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "a", "cut.l", "cut.r", F.col("total").alias("n"), "cut.score")


def mine(docs: DataFrame, least: int = LEAST, top: int = TOP, **options) -> DataFrame:
    """Each lang's first ``top`` phrases. Tasks keep their own first ones, so a lang's task ranks ``top`` rows a task at most."""
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = scored(frequent(docs, least, **options), least).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def oracle(least: int = LEAST, top: int = TOP) -> str:
    return f"""
WITH pieces AS (
  SELECT COALESCE(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), worded AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces
), totals AS (SELECT lang, SUM(len(w))::BIGINT AS n FROM worded GROUP BY lang
), grams AS (
  SELECT lang, width, array_to_string(list_slice(w, i, i + width - 1), ' ') AS phrase
  FROM (SELECT lang, w, width, unnest(generate_series(1, len(w) - width + 1)) AS i FROM worded CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS width) WHERE len(w) >= width)
), freq AS (SELECT lang, width, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= {least}
), kept AS (
  SELECT * FROM freq p WHERE width > 1 AND NOT EXISTS (
    SELECT 1 FROM freq q WHERE q.lang = p.lang AND q.width > p.width AND contains(' ' || q.phrase || ' ', ' ' || p.phrase || ' ') AND 100 * q.f >= 100 * p.f)
), cuts AS (
  SELECT k.lang, k.phrase, k.f AS a, cut, l.f AS l, r.f AS r, t.n, ((1000::HUGEINT * k.f * t.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(generate_series(1, width - 1)) AS cut FROM kept) k
  JOIN freq l ON l.lang = k.lang AND l.phrase = array_to_string(list_slice(k.w, 1, cut), ' ')
  JOIN freq r ON r.lang = k.lang AND r.phrase = array_to_string(list_slice(k.w, cut + 1, k.width), ' ')
  JOIN totals t ON t.lang = k.lang
), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best QUALIFY rank <= {top}
"""
