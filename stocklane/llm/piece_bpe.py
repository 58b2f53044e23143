"""SentencePiece BPE by vectorised merge rounds.

The text becomes flat numpy arrays of symbols cut into words. In each round every word finds its smallest pair
rank (a segmented minimum), merges the leftmost pair of that rank, and the array is compacted; the rounds end
when no word has a pair left. A cut between two characters is safe where no piece of the vocabulary holds them
side by side, so words never exceed what a merge could reach; the few words longer than ``LONG`` symbols take
the same merges from a heap, since one merge a round would cost the square of their length.

The model file stays where it is: its path is a parameter, each worker reads it once. Supported are BPE models
with identity normalisation, escaped white space, an optional dummy prefix and byte fallback; others raise.

Defined results: null and empty texts encode to the end id alone and decode to an empty text; rows are encoded
one by one, so repeats, ties and further columns play no part.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocklane.llm.common import batches

SPACE = "▁"
LONG = 96
#: Words whose ids a worker keeps, twice: those of late and those before them (about 60 MB in all).
CACHED = 100_000
#: Words that are merged at once.
PORTION = 20_000
NONE = np.int64(1 << 40)


@dataclass(slots=True)
class Word:
    """A word's ids as decimals each followed by a space, and the bytes of its pieces."""

    decimal: str
    data: bytes


class Model:
    """The vocabulary as arrays: piece text and kind by id, ranks by pair of symbols."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm, train = proto.normalizer_spec, proto.trainer_spec
        if train.model_type != train.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or train.treat_whitespace_as_suffix or not train.byte_fallback:
            raise ValueError("only BPE models with identity normalisation and byte fallback are supported")
        kinds = proto.pieces[0]
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.prefix = SPACE if norm.add_dummy_prefix else ""
        self.texts = [p.piece for p in proto.pieces]
        self.id = {p.piece: k for k, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
        self.bytes = {int(p.piece[1:-1], 16): k for k, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        self.byte_of = {k: bytes([b]) for b, k in self.bytes.items()}
        self.end = next(k for k, p in enumerate(proto.pieces) if p.type == kinds.CONTROL and p.piece == (train.eos_piece or "</s>"))
        # Larger scores merge first; equal scores leave the choice to the position, as equal ranks do.
        scores = sorted({-p.score for p in proto.pieces if p.type == kinds.NORMAL})
        place = {s: r for r, s in enumerate(scores)}
        self.rank = np.full(len(self.texts), NONE, np.int64)
        for p in proto.pieces:
            if p.type == kinds.NORMAL:
                self.rank[self.id[p.piece]] = place[-p.score]
        # Every way to cut a piece in two pieces or characters; characters outside the vocabulary never merge.
        self.pairs: dict[tuple[int, int], int] = {}
        for piece, k in self.id.items():
            for at in range(1, len(piece)):
                a, b = self.id.get(piece[:at]), self.id.get(piece[at:])
                if a is not None and b is not None:
                    self.pairs[a, b] = k
        self.keys = np.fromiter((a << 32 | b for a, b in self.pairs), np.int64, len(self.pairs))
        self.merged = np.fromiter(self.pairs.values(), np.int64, len(self.pairs))
        # Pairs by hash, a table eight times as large; what collides goes to the next free slot.
        self.shift = np.uint64(64 - (8 * len(self.pairs)).bit_length())
        self.slots = np.full((1 << (64 - int(self.shift))) + 64, -1, np.int32)
        left, at = np.arange(len(self.keys)), self.slot(self.keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]  # of several the last stays
            moved = self.slots[at] != left
            left, at = left[moved], at[moved] + 1
        joined = {piece[k : k + 2] for piece in self.id for k in range(len(piece) - 1)}
        self.inside = np.sort(np.fromiter((ord(x[0]) << 32 | ord(x[1]) for x in joined), np.int64, len(joined)))
        # White space starts a word if no piece has it after another character.
        self.by_space = not any(x[1] == SPACE != x[0] for x in joined)
        self.out = [self.byte_of.get(k) or (b"" if p.type == kinds.CONTROL else p.piece.replace(SPACE, " ").encode()) for k, p in enumerate(proto.pieces)]
        self.out[next(k for k, p in enumerate(proto.pieces) if p.type == kinds.UNKNOWN)] = (train.unk_surface or " ⁇ ").encode()
        self.decimal = [f"{k} " for k in range(len(self.texts))]
        self.late: dict[str, Word] = {}
        self.before: dict[str, Word] = {}

    def symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code points, symbol ids (-1 outside the vocabulary) and the safe word each symbol belongs to."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        distinct, where = np.unique(points, return_inverse=True)
        ids = np.fromiter((self.id.get(chr(x), -1) for x in distinct.tolist()), np.int64, len(distinct))[where]
        new = np.zeros(len(points), bool)
        new[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        if len(points) > 1:
            key = points[:-1] << 32 | points[1:]
            at = np.minimum(np.searchsorted(self.inside, key), len(self.inside) - 1)
            new[1:] |= self.inside[at] != key
        return points, ids, np.cumsum(new) - 1

    def slot(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = np.where((a < 0) | (b < 0), -1, a << 32 | b)
        at = self.slot(key)
        pair = self.slots[at]
        open_ = np.flatnonzero((pair >= 0) & (self.keys[pair] != key))
        while len(open_):  # another pair has the slot
            at[open_] += 1
            pair[open_] = self.slots[at[open_]]
            open_ = open_[(pair[open_] >= 0) & (self.keys[pair[open_]] != key[open_])]
        piece = np.where(pair >= 0, self.merged[pair], 0)
        return np.where(pair >= 0, self.rank[piece], NONE), piece

    def merge(self, ids: np.ndarray, word: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All merges; ids, the index of each symbol's first code point. Words that are done leave the rounds."""
        done_ids, done_first = [], []
        while len(ids):
            rank, piece = np.full(len(ids), NONE), np.zeros(len(ids), np.int64)
            same = word[1:] == word[:-1]
            rank[:-1], piece[:-1] = self.pair_rank(ids[:-1], ids[1:])
            rank[:-1][~same] = NONE
            starts = np.flatnonzero(np.concatenate([[True], ~same]))
            sizes = np.diff(np.append(starts, len(ids)))
            best = np.minimum.reduceat(rank, starts)
            live = np.repeat(best < NONE, sizes)
            if not live.all():
                done_ids.append(ids[~live])
                done_first.append(first[~live])
            at = np.flatnonzero(live & (rank == np.repeat(best, sizes)))
            at = at[np.concatenate([[True], word[at][1:] != word[at][:-1]])] if len(at) else at  # the leftmost of a word
            ids = ids.copy()
            ids[at] = piece[at]
            keep = live
            keep[at + 1] = False
            ids, word, first = ids[keep], word[keep], first[keep]
        if not done_ids:
            return ids, first
        ids, first = np.concatenate(done_ids), np.concatenate(done_first)
        order = np.argsort(first)
        return ids[order], first[order]

    def merge_long(self, ids: list[int]) -> list[tuple[int, int]]:
        """The same merges of one long word from a heap: (id, index of its first symbol)."""
        n, ids = len(ids), list(ids)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap: list[tuple[int, int, int, int, int]] = []

        def push(i: int, j: int) -> None:
            if (piece := self.pairs.get((ids[i], ids[j]))) is not None:
                heapq.heappush(heap, (int(self.rank[piece]), i, j, ids[i] << 32 | ids[j], piece))

        for i in range(n - 1):
            push(i, i + 1)
        dead = bytearray(n)
        while heap:
            _, i, j, key, piece = heapq.heappop(heap)
            if dead[i] or dead[j] or after[i] != j or ids[i] << 32 | ids[j] != key:
                continue
            ids[i], dead[j], after[i] = piece, 1, after[j]
            if after[i] < n:
                before[after[i]] = i
                push(i, after[i])
            if before[i] >= 0:
                push(before[i], i)
        return [(ids[i], i) for i in range(n) if not dead[i]]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Piece ids of each word; the words must not share a piece across their edges."""
        points, ids, word = self.symbols(words)
        if not len(points):
            return [[] for _ in words]
        starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        sizes = np.diff(np.append(starts, len(ids)))
        short = np.repeat(sizes <= LONG, sizes)
        index = np.arange(len(ids))
        out, first = self.merge(ids[short], word[short], index[short])
        for at, n in zip(starts[sizes > LONG].tolist(), sizes[sizes > LONG].tolist(), strict=True):
            found = np.array(self.merge_long(ids[at : at + n].tolist()), np.int64).reshape(-1, 2)
            out, first = np.concatenate([out, found[:, 0]]), np.concatenate([first, found[:, 1] + at])
        order = np.argsort(first, kind="stable")
        out, first = out[order], first[order]
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        cuts = np.searchsorted(first, ends)
        flat, unknown = out.tolist(), bool((out < 0).any())
        result, at = [], 0
        for cut in cuts.tolist():
            own = flat[at:cut]
            if unknown and min(own, default=0) < 0:
                own = [k for s, i in zip(own, first[at:cut].tolist(), strict=True) for k in ([s] if s >= 0 else [self.bytes[b] for b in chr(points[i]).encode()])]
            result.append(own)
            at = cut
        return result

    def split(self, text: str) -> list[str]:
        if not text:
            return []
        text = self.prefix + text.replace(" ", SPACE)
        return WORDS.findall(text) if self.by_space else [text]

    def known(self, split: list[list[str]]) -> dict[str, Word]:
        """The words of some texts (and others) with their pieces; what is not remembered is merged, a portion at a time."""
        if len(self.late) > CACHED:
            self.before, self.late = {w: x for w, x in self.late.items() if len(w) <= LONG}, {}
        late, before = self.late, self.before
        fresh = []
        for w in set().union(*split).difference(late):
            if (found := before.get(w)) is not None:
                late[w] = found
            else:
                fresh.append(w)
        decimal, out = self.decimal, self.out
        for k in range(0, len(fresh), PORTION):
            part = fresh[k : k + PORTION]
            for w, ids in zip(part, self.encode_words(part), strict=True):
                late[w] = Word("".join([decimal[i] for i in ids]), b"".join([out[i] for i in ids]))
        return late

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text, the end id last."""
        return [[int(k) for k in ids.split(" ")] for ids, _ in self.told(texts)]

    def plain(self, data: bytes) -> str:
        """The text of joined piece bytes, without the dummy prefix."""
        return (data[1:] if self.prefix and data[:1] == b" " else data).decode("utf-8", "replace")

    def told(self, texts: list[str | None]) -> list[tuple[str, str]]:
        """For each text its ids as decimals joined by one space, the end id last, and the text that they decode to."""
        split = [self.split(t or "") for t in texts]
        own = self.known(split)
        out = []
        for s in split:
            found = [own[w] for w in s]
            out.append(("".join([w.decimal for w in found]) + str(self.end), self.plain(b"".join([w.data for w in found] + [self.out[self.end]]))))
        return out

    def decode(self, rows: list[list[int]]) -> list[str]:
        """Text of each row of ids: white space restored, the dummy prefix dropped, bytes joined to characters."""
        out = self.out
        return [self.plain(b"".join([out[k] for k in ids])) for ids in rows]


WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
MODELS: dict[str, Model] = {}


def model(path: str) -> Model:
    if path not in MODELS:
        MODELS[path] = Model(path)
    return MODELS[path]


def encode(documents: DataFrame, path: str, *, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``documents`` plus ``ids_col``, the piece ids with the end id last."""
    kept = [c for c in documents.columns if c != ids_col]
    fields = documents.select(*[F.col(f"`{c}`") for c in kept]).withColumn(ids_col, F.lit(None).cast("array<int>")).schema

    def step(batch):
        columns = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
        rows = model(path).encode(columns[text_col].to_pylist())
        return columns | {ids_col: lists(rows)}

    return batches(documents.select(*[F.col(f"`{c}`") for c in kept]), step, fields)


def lists(rows: list[list[int]]) -> pa.Array:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    flat = np.fromiter((k for r in rows for k in r), np.int32, int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def decode(encoded: DataFrame, path: str, *, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``encoded`` plus ``text_col``, the text of its ids; null ids are empty."""
    kept = [c for c in encoded.columns if c != text_col]
    fields = encoded.select(*[F.col(f"`{c}`") for c in kept]).withColumn(text_col, F.lit(None).cast("string")).schema

    def step(batch):
        columns = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
        return columns | {text_col: model(path).decode([r or [] for r in columns[ids_col].to_pylist()])}

    return batches(encoded.select(*[F.col(f"`{c}`") for c in kept]), step, fields)


def report(documents: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the number of ids and digests of the ids and of the text decoded from them.

    Encoding, decoding and digests share one pass over a batch: neither ids nor decoded texts are stored.
    """
    fields = documents.select(id_col).withColumns({"n_tokens": F.lit(0).cast("long"), "ids_sha256": F.lit(None).cast("string"), "decoded_sha256": F.lit(None).cast("string")}).schema

    def step(batch):
        told = model(path).told(batch.column(1).to_pylist())
        return {
            id_col: batch.column(0),
            "n_tokens": [ids.count(" ") + 1 for ids, _ in told],
            "ids_sha256": [hashlib.sha256(ids.encode()).hexdigest() for ids, _ in told],
            "decoded_sha256": [hashlib.sha256(text.encode()).hexdigest() for _, text in told],
        }

    return batches(documents.select(id_col, text_col), step, fields)
