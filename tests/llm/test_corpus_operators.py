"""Phrase mining, mixing and the prefix tree against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from math import floor

import numpy as np
import pytest
from pyspark.sql import functions as F

from stocklane.llm import collocations, mixing, prefix_tree, queries

SF = "/root/testdata/sf0.001"
CONTRACTS = {
    "op11_collocations": "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint",
    "op12_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op13_prefix_tree": "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string",
}


@pytest.mark.parametrize("name", CONTRACTS)
def test_contract_columns(spark, name):
    assert set(CONTRACTS[name].split(", ")) <= {f"{c} {kind}" for c, kind in queries.QUERIES[name](spark, SF).dtypes}


# Collocations.


def mined(rows, least: int, top: int):
    """Every lang's phrases by the letter of the contract."""
    totals, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for width in range(1, 6):
                f[lang].update(tuple(words[i : i + width]) for i in range(len(words) - width + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        rows_of = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= 100 * a and inside(p, q) for q, b in candidates.items()):
                continue
            cuts = [(1000 * a * totals[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            rows_of.append((" ".join(p), a, counts[p[:k]], counts[p[k:]], totals[lang], score))
        rows_of.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        out += [(lang, rank, *r) for rank, r in enumerate(rows_of[:top], 1)]
    return sorted(out)


def phrase_rows():
    rng = random.Random(4)
    words = ["a", "B", "é", "cc", "Dd", "x\x00y", "ß", "q" * 70, "q" * 70 + "r", "10"]
    gaps, breaks = [" ", " ", " ", "\t", "  \t "], [". ", "\n", ",", " !? ", "\x0b"]
    rows = [(rng.choice(["en", "fr", None, "und", "", "a b"]), "".join(rng.choice(words) + rng.choice(gaps if rng.random() < 0.8 else breaks) for _ in range(rng.randint(0, 60)))) for _ in range(120)]
    rows += [("en", None), ("en", ""), ("en", " \t\n"), (None, "a a a a a a a a a a a a")] * 2
    return rows + [("long", "cc " * 3000 + "B é 10 " * 900), ("one", "n" * 5000)]


def test_collocations_against_brute_force(spark):
    """Nulls, ties, repeated rows, long pieces, clashing columns; whatever the sample holds and wherever texts are cut."""
    rows = phrase_rows()
    docs = spark.createDataFrame([(lang, text, k, k) for k, (lang, text) in enumerate(rows)], "lang string, text string, n long, phrase long").repartition(3)
    for least, options in ((6, {"share": 0.3}), (6, {"share": 0.0, "most": 50}), (9, {"share": 1.0, "most": 700})):
        got = sorted(map(tuple, collocations.mine(docs, least, 40, **options).collect()))
        assert got == mined(rows, least, 40) and len(got) > 30
    assert collocations.mine(docs.limit(0)).count() == 0


def test_words_that_share_a_hash_are_told_apart(monkeypatch):
    text = b"aa bb cc\naa bb"
    plain = collocations.Words(text, "en")
    monkeypatch.setattr(collocations.Words, "random", np.zeros(64 * 256, np.uint64))  # all words of a length are alike
    w = collocations.Words(text, "en")
    assert w.number.tolist() == plain.number[np.argsort(plain.number, kind="stable")].tolist() or len(set(w.number.tolist())) == 3
    assert w.phrases(w.shown, 1).to_pylist() == ["aa", "bb", "cc"] and w.phrases(np.array([0]), 3).to_pylist() == ["aa bb cc"]


def test_filter_holds_what_it_was_given(spark):
    hashes = spark.range(3000).select(F.xxhash64("id").alias("h"))
    words = collocations.filter_words(hashes, 1024)
    own = np.array([r.h for r in hashes.collect()], np.int64).view(np.uint64)
    assert collocations.holds(words, own).all() and collocations.holds(words, own + np.uint64(1)).mean() < 0.2
    assert collocations.filter_size(10**12) * 64 == collocations.MOST_BITS and not collocations.holds(None, own).any()


# Mixing.


def filled(sizes: dict, weights=(1, 2, 3), most=3) -> dict:
    """Targets as fractions: share by weight, cap, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, open_, left = {}, list(order), Fraction(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        capped = [s for s in open_ if left * weight[s] > most * sizes[s] * total]
        if not capped:
            return target | {s: left * weight[s] / total for s in open_}
        target |= {s: Fraction(most * sizes[s]) for s in capped}
        left -= sum(most * sizes[s] for s in capped)
        open_ = [s for s in open_ if s not in capped]
    return target


def test_mixing_against_brute_force(spark):
    rng = random.Random(8)
    sources = ["b", "a", None, "", "é", "\U0001f600", "z", "tiny", "empty"]
    rows = []
    for k in range(400):
        source = rng.choices(sources, [20, 5, 3, 8, 2, 9, 6, 0, 0])[0]
        rows.append((None if k % 50 == 0 else k, source, None if k % 37 == 0 else " \t".join(["w"] * int(rng.paretovariate(0.9)))))
    rows += [(7, "tiny", "one\x0btwo")] * 2 + [(8, "empty", " "), (9, "empty", None), (9, "b", "w " * 3000)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, source string, text string, size int, k int").repartition(5)
    sizes = defaultdict(int)
    for _, source, text in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = filled(sizes)
    assert sum(want.values()) == sum(sizes.values())
    got = mixing.report(docs).collect()
    again = mixing.report(docs.repartition(2)).collect()
    key = lambda r: (str(r.doc_id), str(r.source), r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    for source, size in sizes.items():
        own = sorted((r for r in got if r.source == source), key=lambda r: (r.size, -1 if r.doc_id is None else r.doc_id))
        assert all(r.source_size == size and abs(r.target - float(want[source])) < 1e-6 for r in own)
        rate = want[source] / size if size else Fraction(0)
        assert all(floor(rate) <= r.copies <= -(-rate.numerator // rate.denominator) and r.taken == r.copies * r.size for r in own)
        name = f"{mixing.SEED}:" + ("null" if source is None else f"={source}")
        drawn = Fraction(int(hashlib.md5(name.encode()).hexdigest()[:8], 16), 1 << 32)
        if size:
            step = lambda k: floor(k * rate + (0 if rate == 3 else floor(drawn * rate.denominator * (size * 10**6)) / Fraction(rate.denominator * (size * 10**6))))
            assert abs(sum(r.copies for r in own) - (step(len(own)) - step(0))) <= 1
        assert abs(sum(r.taken for r in own) - want[source]) <= max((r.size for r in own), default=0)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)
    assert mixing.report(docs.limit(0)).count() == mixing.mix(docs.limit(0)).count() == 0
    assert mixing.sums(mixing.report(docs)).count() == len(sizes)


# Prefix tree.


def trie_rows(rows):
    """Every node by the letter of the contract."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    digest = lambda r, t: hashlib.sha256(f"{len(r)}:{r}{t}".encode()).digest()[: prefix_tree.WIDTH]
    for own in turns.values():
        own.sort(key=lambda x: (x[0], x[1], x[2], digest(x[2], x[3])))
    plain = {c: [(r, t) for _, _, r, t in own] for c, own in turns.items()}
    made = {}
    for c, own in plain.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = plain.get(c - c % 100, [])[:h] + own[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, own in sorted(made.items()):
        for d in range(len(own) + 1):
            members[tuple(own[:d])].append(c)
        ends[tuple(own)].append(c)
    kids, leaves, saved = Counter(), Counter(), Counter()
    for path in members:
        if path:
            kids[path[:-1]] += 1
    for path, own in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += not kids[path]
            saved[path[:d]] += (len(own) - 1) * (len(path[-1][1]) if path else 0)
    return sorted(
        (own[0], len(path), members[path[:-1]][0] if path else -1, len(own), kids[path], leaves[path], saved[path], hashlib.sha256(",".join(map(str, ends[path])).encode()).hexdigest()) for path, own in members.items()
    )


def conversation_rows():
    rng = random.Random(6)
    said = ["", "a", "b", "é😀", None, "long " * 50]
    rows = []
    for c in [*range(100, 160), *range(300, 320), *range(401, 430), 777, 10**12]:
        for k in range(rng.randint(1, 9)):
            turn = None if rng.random() < 0.05 else k
            rows.append((c, turn, rng.choice(["user", "assistant", None]), said[min(int(rng.expovariate(0.8)), 5)]))
    rows += [(150, 0, "user", "a")] * 3 + [(None, 0, "user", "lost")]
    return rows + [(c, k, "user", f"{k % 5}") for c in (201, 202, 203) for k in range(150 + c % 3)] + [(201, 400, "user", "end")]


@pytest.mark.parametrize("size", [64, 3])
def test_prefix_tree_against_brute_force(spark, size):
    """Nulls, ties, repeated rows, absent and short donors, long conversations in several pieces, clashing columns."""
    rows = conversation_rows()
    frame = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "conv_id long, turn long, role string, text string, place int, id int, piece int").repartition(3)
    got = [tuple(-1 if x is None else x for x in r) for r in prefix_tree.report(frame, size).collect()]
    assert sorted(got) == trie_rows(rows)
    assert any(r[3] > 30 for r in got) and max(r[1] for r in got) > 140


def test_prefix_tree_of_an_empty_table(spark):
    rows = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_tree.report(rows).count() == 0
    one = spark.createDataFrame([(None, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    assert prefix_tree.report(one).count() == 0


def test_trees_that_give_out_early_add_up(spark, monkeypatch):
    rows = conversation_rows()
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = prefix_tree.radix_places
    monkeypatch.setattr(prefix_tree, "radix_places", lambda df: whole(df, most=200))
    monkeypatch.setattr(prefix_tree, "ends", lambda *x, f=prefix_tree.ends: f(*x, chunk=9))
    got = [tuple(-1 if x is None else x for x in r) for r in prefix_tree.report(frame, 8).collect()]
    assert sorted(got) == trie_rows(rows)


def test_radix_tree_against_a_dictionary():
    """All four layouts, split paths, keys that are beginnings of others, sums at every aligned depth."""
    rng = random.Random(1)
    for fan in (2, 5, 17, 60, 256):
        tree, want = prefix_tree.RadixTree(lambda a, b: a + b), Counter()
        keys = [b"HEAD" + b"".join(bytes((rng.randrange(fan), 0, rng.randrange(2))) for _ in range(rng.randint(0, 4))) for _ in range(600)]
        for key in keys:
            tree.insert(key, 1)
            for depth in range(4, len(key) + 1, 3):
                want[key[:depth]] += 1
        got = list(tree.places(4, 3))
        assert Counter(dict(got)) == want and len(got) == len(want)
        sizes, stack = set(), [tree.root]
        while stack:
            node = stack.pop()
            sizes.add(node.size)
            stack += [kid for _, kid in node.edges()]
        assert max(sizes) == {2: 4, 5: 16, 17: 48, 60: 256, 256: 256}[fan]
    assert list(prefix_tree.RadixTree(lambda a, b: a + b).places(4, 3)) == []
