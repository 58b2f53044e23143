"""Prefix trie of conversations by adaptive radix trees.

A turn's id is a digest of its role and text, 16 bytes wide and big-endian; a conversation's key is the ids of its turns one after
another. Tasks put keys into adaptive radix trees: inner nodes of four sizes that grow as children come, with compressed paths.
Walking a tree emits a row for every place whose byte depth is a whole number of turns, with sums over the keys below. The trees
are built over ranges of sorted keys, so beginnings are shared within a task, and give out what they hold once they reach ``BYTES`` of
keys; a node that several trees hold is added up by Spark afterwards, so no beginning, however common, has to fit a task.

A node is named by its depth and two 64-bit sums over the turns before it, each turn's id mixed with its place. A conversation of more than
``TURNS`` turns is cut into pieces; a piece's key starts with the name of the node where it begins. So a conversation of any length is many rows.

Sums over subtrees come from sums over members. The smallest member of a node is its name's bearer; from the first depth at
which it bears a node a conversation bears all its deeper ones. Let E be the code points of a conversation's turns above that depth
(of all its turns, if it bears none). The saved tokens of a node are the sum of E over its members, less the bearer's E, less
(members - 1) times the code points above the node; its leaves are the members that bear a childless node.

Defined results: null role and text are empty; rows of a null conv_id take no part; null turns come first; turns that tie come by role
and text; a repeated row is a turn of its own; a conversation without turns is a member of the root only; an empty table gives no rows;
further columns play no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocklane.llm.common import lookup, materialize, mix64
from stocklane.operators.ranges import ranks, running

WIDTH = 16
#: Turns in one piece of a conversation.
TURNS = 64
#: A tree gives out its nodes at so many bytes of keys.
BYTES = 8_000_000
#: A piece's key starts with depth and name of the node where it begins.
HEAD = 24
NODE = ["depth", "a", "b"]
#: Most turns that a conversation takes over, as the contract of the query has it.
SHARED = 5
GROUP = 100
#: A piece of a list of ids, in bytes.
CHUNK = 1_000_000


class Inner:
    """A node with up to 256 children by key byte in one of four layouts; ``path`` holds the bytes that lead to it from its parent's byte."""

    __slots__ = ("bytes", "kids", "path", "size", "value")

    def __init__(self, path: bytes, value=None):
        self.path, self.value, self.size = path, value, 4
        self.bytes: bytearray | None = bytearray()  # 4, 16: the children's bytes; 48: 256 places, 255 for none; 256: none
        self.kids: list = []

    def get(self, byte: int):
        if self.size == 256:
            return self.kids[byte]
        if self.size == 48:
            at = self.bytes[byte]
            return None if at == 255 else self.kids[at]
        at = self.bytes.find(byte)
        return None if at < 0 else self.kids[at]

    def put(self, byte: int, kid: Inner) -> None:
        """Replaces the child at ``byte`` or adds one; a full node takes the next layout first."""
        if self.size == 256:
            self.kids[byte] = kid
        elif self.size == 48:
            if self.bytes[byte] != 255:
                self.kids[self.bytes[byte]] = kid
            elif len(self.kids) < 48:
                self.bytes[byte] = len(self.kids)
                self.kids.append(kid)
            else:
                self.grow()
                self.put(byte, kid)
        elif (at := self.bytes.find(byte)) >= 0:
            self.kids[at] = kid
        elif len(self.kids) < self.size:
            self.bytes.append(byte)
            self.kids.append(kid)
        else:
            self.grow()
            self.put(byte, kid)

    def grow(self) -> None:
        if self.size == 4:
            self.size = 16
        elif self.size == 16:
            places = bytearray(b"\xff" * 256)
            for at, byte in enumerate(self.bytes):
                places[byte] = at
            self.bytes, self.size = places, 48
        else:
            kids = [None] * 256
            for byte, at in enumerate(self.bytes):
                if at != 255:
                    kids[byte] = self.kids[at]
            self.bytes, self.kids, self.size = None, kids, 256

    def edges(self) -> list[tuple[int, Inner]]:
        if self.size == 256:
            return [(b, k) for b, k in enumerate(self.kids) if k is not None]
        if self.size == 48:
            return [(b, self.kids[at]) for b, at in enumerate(self.bytes) if at != 255]
        return list(zip(self.bytes, self.kids, strict=True))


def shared(a: bytes, b: bytes) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


class RadixTree:
    """Keys with values that ``add`` merges."""

    def __init__(self, add):
        self.root, self.add = Inner(b""), add

    def insert(self, key: bytes, value) -> None:
        node, at, above, byte = self.root, 0, None, 0
        while True:
            same = shared(node.path, key[at:])
            if same < len(node.path):  # the key leaves inside the path: split it
                fork = Inner(node.path[:same])
                rest = node.path[same]
                node.path = node.path[same + 1 :]
                fork.put(rest, node)
                above.put(byte, fork)
                node = fork
            at += same
            if at == len(key):
                node.value = value if node.value is None else self.add(node.value, value)
                return
            kid = node.get(key[at])
            if kid is None:
                node.put(key[at], Inner(key[at + 1 :], value))
                return
            above, byte, node, at = node, key[at], kid, at + 1

    def places(self, first: int, step: int):
        """Every (key, sum of the values at or below it) at byte depths ``first``, ``first + step``, ...: children before parents."""
        stack = [(self.root, b"", None)]
        sums: list = []
        while stack:
            node, before, waits = stack.pop()
            if waits is None:
                stack.append((node, before, len(sums)))
                own = before + node.path
                for byte, kid in node.edges():
                    stack.append((kid, own + bytes((byte,)), None))
                continue
            value = node.value
            for x in sums[waits:]:
                value = x if value is None else self.add(value, x)
            del sums[waits:]
            if value is None:  # an empty tree
                continue
            sums.append(value)
            own = before + node.path
            above = len(before)  # places on the edge that leads here, its first byte included
            for depth in range(first + max(0, -(-(above - first) // step)) * step, len(own) + 1, step):
                yield own[:depth], value


def names(ids: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What turns add to a node's two sums. ``ids``: pairs of big-endian halves; ``before``: turns before each."""
    salt = mix64(before.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    a = mix64(ids[:, 0] ^ salt) + ids[:, 1]
    b = mix64(ids[:, 1] + salt) ^ mix64(ids[:, 0])
    return mix64(a), mix64(b)


def signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def turn_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), id, chars of every turn; a conversation of any length is spread over tasks."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), digest.alias("id"), F.length(text).cast("long").alias("chars"))
    return ranks(rows, ["conv_id"], [F.col("turn").asc_nulls_first(), "role", "id"], "place").select("conv_id", "place", "id", "chars")


def shares(turns: DataFrame) -> DataFrame:
    """A row a conversation: how many turns it has, of whom and how many it takes over, how many it then has."""
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    convs = convs.select("conv_id", "n", F.expr(f"conv_id - conv_id % {GROUP}").alias("donor"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (SHARED + 1)).alias("h"))
    have = convs.where(f"conv_id % {GROUP} = 0").select(F.col("conv_id").alias("donor"), F.col("n").alias("given"))
    return convs.join(have, "donor", "left").select("conv_id", "n", "donor", "h", F.expr("least(h, coalesce(given, 0))").alias("have"))


def rebuilt(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Conversations that start with turns of another one. A donor gives ``SHARED`` turns to fewer than ``GROUP`` others."""
    gifts = turns.where(f"conv_id % {GROUP} = 0 AND place <= {SHARED}").select(F.col("conv_id").alias("donor"), "place", "id", "chars")
    taken = convs.where("have > 0").select("conv_id", "donor", "have").join(gifts, "donor").where("place <= have").select("conv_id", "place", "id", "chars")
    own = lookup(turns, convs.select("conv_id", "n", "h", "have"), ["conv_id"], "n").where("place > h")
    return taken.unionByName(own.select("conv_id", F.expr("place - h + have").alias("place"), "id", "chars"))


def pieces(turns: DataFrame, convs: DataFrame, size: int = TURNS) -> DataFrame:
    """Rows of at most ``size`` turns: conv_id, piece, ids, chars, and of the node where it begins depth, a, b and code points above (``over``).

    ``convs``: conv_id and ``length``, the number of turns. A conversation without turns is one empty piece.
    """
    bits = F.struct("place", "id", "chars")
    rows = turns.withColumn("piece", F.expr(f"(place - 1) DIV {size}")).groupBy("conv_id", "piece").agg(F.array_sort(F.collect_list(bits)).alias("t"))
    rows = rows.select("conv_id", "piece", F.expr("transform(t, x -> x.id)").alias("ids"), F.expr("transform(t, x -> x.chars)").alias("chars"))
    none = convs.where("length = 0").select("conv_id", F.lit(0).cast("long").alias("piece"), F.expr("CAST(array() AS array<binary>)").alias("ids"), F.expr("CAST(array() AS array<bigint>)").alias("chars"))
    schema = "conv_id bigint, piece bigint, ids binary, chars array<bigint>, own_a bigint, own_b bigint, own_chars bigint"

    def add_up(parts):
        for part in parts:
            ids, own_a, own_b, total = [], [], [], []
            for piece, t, chars in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                ids.append(b"".join(t))
                halves = np.frombuffer(ids[-1], ">u8").astype(np.uint64).reshape(-1, 2)
                a, b = names(halves, np.arange(len(t)) + piece * size)
                own_a.append(signed(int(a.sum(dtype=np.uint64))))
                own_b.append(signed(int(b.sum(dtype=np.uint64))))
                total.append(sum(chars))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(ids, pa.binary()), part.column(3), pa.array(own_a, pa.int64()), pa.array(own_b, pa.int64()), pa.array(total, pa.int64())],
                names=["conv_id", "piece", "ids", "chars", "own_a", "own_b", "own_chars"],
            )

    rows = materialize(rows.unionByName(none).mapInArrow(add_up, schema), "pieces")
    zero = F.lit(0).cast("long")
    short = rows.withColumns({"depth": zero, "a": zero, "b": zero, "over": zero})
    if not rows.where("piece > 0").limit(1).count():
        return short
    # Long conversations only: running sums over their pieces. The 64-bit sums run as two halves of 32 bits, so they do not overflow.
    long = rows.join(convs.where(f"length > {size}").select("conv_id"), "conv_id", "left_semi")
    halves = long.select("conv_id", "piece", "own_a", "own_b", "own_chars", *[e for x in ("a", "b") for e in (F.expr(f"own_{x} & 4294967295").alias(f"low_{x}"), F.expr(f"shiftrightunsigned(own_{x}, 32)").alias(f"high_{x}"))])
    sums = running(halves, ["conv_id"], ["piece"], {f"sum_{x}": x for x in ("low_a", "high_a", "low_b", "high_b", "own_chars")})
    joined = [F.expr(f"shiftleft((sum_high_{x} + shiftrightunsigned(sum_low_{x}, 32)) & 4294967295, 32) | (sum_low_{x} & 4294967295)") for x in ("a", "b")]
    starts = sums.select("conv_id", F.expr("piece + 1").alias("piece"), F.expr(f"(piece + 1) * {size}").alias("depth"), joined[0].alias("a"), joined[1].alias("b"), F.col("sum_own_chars").alias("over"))
    later = rows.where("piece > 0").join(starts, ["conv_id", "piece"])
    return materialize(short.where("piece = 0").unionByName(later), "pieces")


PLACES = "depth bigint, a bigint, b bigint, up_a bigint, up_b bigint, chars bigint, over bigint, n bigint, least bigint, x bigint, y bigint"


def radix_places(rows: DataFrame, most: int = BYTES) -> DataFrame:
    """Nodes of ``rows`` (depth, a, b, over, ids, chars and per conversation n, least, x, y) as trees see them: add up n, x and y, take the least ``least``."""

    def walk(tree: RadixTree, chars: dict, overs: dict):
        cols: list[list] = [[] for _ in range(11)]
        for key, (n, least, x, y) in tree.places(HEAD, WIDTH):
            head, ids = key[:HEAD], key[HEAD:]
            start = int.from_bytes(head[:8], "big")
            if start and not ids:
                continue  # the end of the piece before is this node
            halves = np.frombuffer(ids, ">u8").astype(np.uint64).reshape(-1, 2)
            da, db = names(halves, np.arange(len(halves)) + start)
            a0, b0 = int.from_bytes(head[8:16], "big"), int.from_bytes(head[16:], "big")
            up_a, up_b = a0 + int(da[:-1].sum(dtype=np.uint64)), b0 + int(db[:-1].sum(dtype=np.uint64))
            sizes = [chars[ids[k : k + WIDTH]] for k in range(0, len(ids), WIDTH)]
            last = [int(da[-1]), int(db[-1]), sizes[-1]] if sizes else [0, 0, 0]
            found = (start + len(sizes), signed(up_a + last[0]), signed(up_b + last[1]), signed(up_a), signed(up_b), last[2], overs[head] + sum(sizes[:-1]), n, least, x, y)
            for col, v in zip(cols, found, strict=True):
                col.append(v)
            if len(cols[0]) >= 20_000:
                yield batch(cols)
                cols = [[] for _ in range(11)]
        if cols[0]:
            yield batch(cols)

    def batch(cols: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[x.split()[0] for x in PLACES.split(", ")])

    def add(p, q):
        return p[0] + q[0], min(p[1], q[1]), p[2] + q[2], p[3] + q[3]

    def build(parts):
        tree, chars, overs, held = RadixTree(add), {}, {}, 0
        for part in parts:
            for depth, a, b, over, ids, sizes, n, least, x, y in zip(*(part.column(k).to_pylist() for k in range(10)), strict=True):
                head = depth.to_bytes(8, "big") + (a & (1 << 64) - 1).to_bytes(8, "big") + (b & (1 << 64) - 1).to_bytes(8, "big")
                overs[head] = over
                for k, size in enumerate(sizes):
                    chars[ids[k * WIDTH : (k + 1) * WIDTH]] = size
                tree.insert(head + ids, (n, least, x, y))
                held += HEAD + len(ids)
                if held > most:
                    yield from walk(tree, chars, overs)
                    tree, chars, overs, held = RadixTree(add), {}, {}, 0
        yield from walk(tree, chars, overs)

    wanted = rows.select("depth", "a", "b", "over", "ids", "chars", "n", "least", "x", "y")
    return wanted.repartitionByRange("depth", "a", "b", "ids").sortWithinPartitions("depth", "a", "b", "ids").mapInArrow(build, PLACES)


def equal_keys(rows: DataFrame, least: Column, x: Column, y: Column) -> DataFrame:
    """Pieces with equal keys as one row: added up before they are sorted, so no key is frequent."""
    return rows.groupBy("depth", "a", "b", "over", "ids", "chars").agg(F.count(F.lit(1)).alias("n"), F.min(least).alias("least"), F.sum(x).alias("x"), F.sum(y).alias("y"))


def nodes(rows: DataFrame) -> DataFrame:
    """Every node once: depth, a, b, up_a, up_b, chars of its last turn, code points above it, members, smallest member."""
    zero = F.lit(0).cast("long")
    found = radix_places(equal_keys(rows, F.col("conv_id"), zero, zero))
    return found.groupBy(*NODE).agg(F.first("up_a").alias("up_a"), F.first("up_b").alias("up_b"), F.first("chars").alias("chars"), F.first("over").alias("over"), F.sum("n").alias("n_convs"), F.min("least").alias("conv_id"))


def ends(rows: DataFrame, convs: DataFrame, size: int = TURNS, chunk: int = CHUNK) -> DataFrame:
    """A digest of the ids that end at each node. Ids are sorted over ranges and strung together there; a node's strings then pass one task as a
    stream, in order and a chunk at a time (a digest is sequential)."""
    last = rows.join(convs.select("conv_id", "length"), "conv_id").where(f"piece = greatest((length - 1) DIV {size}, 0)")

    def close(parts):
        for part in parts:
            cols: list[list] = [[], [], []]
            for depth, a, b, own_a, own_b, ids in zip(*(part.column(k).to_pylist() for k in range(1, 7)), strict=True):
                cols[0].append(depth + len(ids) // WIDTH)
                cols[1].append(signed(a + own_a))
                cols[2].append(signed(b + own_b))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), part.column(0)], names=["depth", "a", "b", "conv_id"])

    ending = last.select("conv_id", "depth", "a", "b", "own_a", "own_b", "ids").mapInArrow(close, "depth bigint, a bigint, b bigint, conv_id bigint")

    def string(parts):
        own, first, held, size = None, None, [], 0
        out: list[list] = [[], [], [], [], []]

        def give():
            for col, v in zip(out, (*own, first, ",".join(held)), strict=True):
                col.append(v)

        def batch():
            done = pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.string())], names=["depth", "a", "b", "first", "listed"])
            for c in out:
                c.clear()
            return done

        for part in parts:
            for row in zip(*(part.column(k).to_pylist() for k in range(4)), strict=True):
                if own is not None and (own != row[:3] or size > chunk):
                    give()
                    own, held, size = None, [], 0
                    if len(out[0]) >= 10_000 or sum(map(len, out[4][-20:])) > chunk:
                        yield batch()
                if own is None:
                    own, first = row[:3], row[3]
                held.append(str(row[3]))
                size += len(held[-1]) + 1
        if own is not None:
            give()
        if out[0]:
            yield batch()

    listed = ending.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").mapInArrow(string, "depth bigint, a bigint, b bigint, first bigint, listed string")

    def digest(parts):
        own, state, out = None, None, []

        def batch():
            return pa.RecordBatch.from_arrays([*(pa.array([r[0][k] for r in out], pa.int64()) for k in range(3)), pa.array([r[1] for r in out], pa.string())], names=["depth", "a", "b", "ends_sha256"])

        for part in parts:
            for *node, text in zip(*(part.column(k).to_pylist() for k in (0, 1, 2, 4)), strict=True):
                if own != node:
                    if own is not None:
                        out.append((own, state.hexdigest()))
                    own, state = node, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            if len(out) > 10_000:
                yield batch()
                out = []
        if own is not None:
            out.append((own, state.hexdigest()))
        if out:
            yield batch()

    return listed.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(digest, "depth bigint, a bigint, b bigint, ends_sha256 string")


def report(conversations: DataFrame, size: int = TURNS) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    turns = materialize(turn_rows(conversations), "turns")
    convs = materialize(shares(turns).withColumn("length", F.expr("have + greatest(n - h, 0)")), "convs")
    return trie(rebuilt(turns, convs), convs.select("conv_id", "length"), size)


def trie(turns: DataFrame, convs: DataFrame, size: int = TURNS) -> DataFrame:
    """Every node of the trie over ``turns`` (conv_id, place, id, chars) of ``convs`` (conv_id, length)."""
    rows = pieces(turns, convs, size)
    found = materialize(nodes(rows), "nodes")
    kids = found.where("depth > 0").groupBy(F.expr("depth - 1").alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    known = materialize(found.join(kids, NODE, "left").fillna(0, ["n_children"]), "nodes")
    # What a conversation bears: its first node's code points above, and whether its last node is a leaf.
    bears = known.groupBy("conv_id").agg(F.min(F.struct("depth", "over"))["over"].alias("e"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    total = rows.groupBy("conv_id").agg(F.sum("own_chars").alias("total"))
    own = convs.join(total, "conv_id").join(bears, "conv_id", "left")
    own = own.select("conv_id", F.expr(f"greatest((length - 1) DIV {size}, 0) + 1").alias("n_pieces"), F.coalesce("e", "total").alias("e"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    own = materialize(own, "bears")
    marked = lookup(rows, own, ["conv_id"], "n_pieces")
    sums = radix_places(equal_keys(marked, F.col("conv_id"), F.col("e"), F.col("leaf"))).groupBy(*NODE).agg(F.sum("x").alias("x"), F.sum("y").alias("n_leaves"))
    done = known.join(sums, NODE).join(ends(rows, convs, size), NODE, "left")
    done = done.join(own.select("conv_id", F.col("e").alias("bearer")), "conv_id")
    over = known.select(F.expr("depth + 1").alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"))
    done = done.join(over, ["depth", "up_a", "up_b"], "left")
    return done.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        F.expr("x - bearer - (n_convs - 1) * over").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


ORACLE = """
WITH turns AS (
  SELECT conv_id, COALESCE(role, '') AS role, COALESCE(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, COALESCE(role, ''), COALESCE(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, count(*) AS n, conv_id - conv_id % 100 AS donor,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda c, x: list_reduce(list_prepend(xor(c, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, z: xor(v >> 1, 3988292384 * (v & 1)) + z)), 4294967295) % 6 AS h
  FROM turns GROUP BY conv_id
), shares AS (
  SELECT c.*, least(c.h, COALESCE(d.n, 0)) AS have FROM convs c LEFT JOIN convs d ON d.conv_id = c.donor
), rebuilt AS (
  SELECT s.conv_id, t.place, t.role, t.text FROM shares s JOIN turns t ON t.conv_id = s.donor AND t.place <= s.have
  UNION ALL SELECT s.conv_id, t.place - s.h + s.have, t.role, t.text FROM shares s JOIN turns t ON t.conv_id = s.conv_id AND t.place > s.h
), paths AS (
  SELECT conv_id, place AS depth, length(text) AS chars,
    list(sha256(length(role)::VARCHAR || ':' || role || text)) OVER (PARTITION BY conv_id ORDER BY place) AS path FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, []::VARCHAR[] FROM shares
), nodes AS (
  SELECT path, min(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(chars) AS chars FROM paths GROUP BY path
), members AS (
  SELECT p.conv_id AS member, n.*, max(p.depth) OVER (PARTITION BY p.conv_id) = p.depth AS ending FROM paths p JOIN nodes n ON p.path = n.path
), ended AS (
  SELECT conv_id, depth, string_agg(member::VARCHAR, ',' ORDER BY member) AS listed FROM members WHERE ending GROUP BY conv_id, depth
), linked AS (
  SELECT n.*, p.conv_id AS parent_conv_id FROM nodes n LEFT JOIN members p ON p.member = n.conv_id AND p.depth = n.depth - 1
), kids AS (
  SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY 1, 2
), below AS (
  SELECT m.conv_id, m.depth, sum((v.n_convs - 1) * v.chars) AS saved_tokens, count(*) FILTER (WHERE k.n_children IS NULL) AS n_leaves
  FROM nodes v JOIN members m ON m.member = v.conv_id AND m.depth <= v.depth LEFT JOIN kids k ON k.conv_id = v.conv_id AND k.depth = v.depth
  GROUP BY 1, 2
)
SELECT l.conv_id, l.depth, l.parent_conv_id, l.n_convs, COALESCE(k.n_children, 0)::BIGINT AS n_children, b.n_leaves::BIGINT AS n_leaves,
  b.saved_tokens::BIGINT AS saved_tokens, sha256(COALESCE(e.listed, '')) AS ends_sha256
FROM linked l JOIN below b USING (conv_id, depth) LEFT JOIN kids k USING (conv_id, depth) LEFT JOIN ended e USING (conv_id, depth)
"""
