from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from stocklane.llm import common, jaccard_join, line_dedup, topk
from stocklane.llm import components as components_module
from stocklane.llm.components import components


def union(n, pairs):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return [root(x) for x in range(n)]


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(300, 360)]
    want = union(361, pairs)
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert all(want[k] == v for k, v in got.items()) and set(got) == {x for a, b in pairs if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def near_copies():
    rng = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    texts = [None, "", " \t", "One", "one", "two words", "Two\nwords"]
    for _ in range(12):
        base = rng.choices(words, k=rng.choice([30, 80, 200]))
        for edits in (0, 0, 1, 1, 2, 3, 4, 6, 9):
            own = list(base)
            for _ in range(edits):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts.append(" ".join(own))
    passage = " ".join(rng.choices(words, k=60))
    return texts + [f"{passage} {' '.join(rng.choices(words, k=12))}" for _ in range(12)] + [texts[9].upper()]


def shingles(text, width):
    w = (text or "").lower().split()
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()}


def test_jaccard_join_against_brute_force(spark):
    texts = near_copies()
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)] + [(9, texts[9], 1)], "doc_id bigint, text string, n_shingles int")
    for width, percent in ((3, 90), (5, 80)):
        sets = [shingles(t, width) for t in texts]
        pairs = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
        want = union(len(texts), pairs)
        rows = jaccard_join.join(docs, width=width, percent=percent).collect()
        assert len(rows) == len(texts) + 1
        assert all((r.n_shingles, r.component_id) == (len(sets[r.doc_id]), want[r.doc_id]) for r in rows)
    kept = sorted(r.doc_id for r in jaccard_join.keep_one(docs).collect())
    assert kept == [k for k in range(len(texts)) if want[k] == k]
    assert jaccard_join.join(docs.limit(0)).count() == 0
    assert jaccard_join.join(spark.createDataFrame([(None, "a b c"), (1, "a b c")], "doc_id bigint, text string")).count() == 2


def test_trie_prunes_nothing_that_links():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(120)]
    trie = jaccard_join.Trie()
    for k, own in enumerate(sets):
        trie.add(k, own)
    for own in sets[:40]:
        want = {k for k, other in enumerate(sets) if 100 * len(np.intersect1d(own, other)) >= 60 * len(np.union1d(own, other))}
        assert set(trie.similar(own, 60)) == want


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(6)
    words = [f"word{k}" for k in range(300)]
    lines = []
    for _ in range(25):
        base = rng.choices(words, k=30)
        lines.append(" ".join(base))
        for _ in range(3):
            own = list(base)
            own[rng.randrange(30)] = rng.choice(words)
            lines.append(" ".join(own))
    texts = ["\n".join(rng.sample(lines, 6) + ["ok", "  "]) for _ in range(30)] + [None, "", "\n\n", "short\nshort"]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id bigint, text string, gone int")
    seen = [(i, k, line) for i, t in enumerate(texts) for k, line in line_dedup.eligible(t, 10)]
    grams = [{x[k : k + 9] for k in range(len(x) - 8)} for _, _, x in seen]
    pairs = [(a, b) for a in range(len(seen)) for b in range(a) if 100 * len(grams[a] & grams[b]) >= 80 * len(grams[a] | grams[b])]
    root = union(len(seen), pairs)
    want = {(i, k) for (i, k, _), r in zip(seen, root, strict=True) if seen[r][:2] != (i, k)}
    got = {(r.id, k) for r in line_dedup.dropped_lines(docs).collect() for k in r.gone}
    assert got <= want and len(got) >= 0.95 * len(want)
    out = {r.doc_id: r.text for r in line_dedup.dedup(docs).collect()}
    for i, t in enumerate(texts):
        assert out[i] == (t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in got))
    assert line_dedup.report(docs.limit(0)).count() == 0


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = [(k, [float(x) for x in rng.normal(0, 0.2, 8)]) for k in range(150)]
    rows += [(200 + k, rows[3][1]) for k in range(12)] + [(300, None), (301, [None] * 8), (302, [float("nan")] * 8), (303, []), (350, [1.0, 2.0]), (None, [0.1] * 8), (5, rows[5][1])]
    vectors = topk.integer_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.search(vectors, vectors.where("vec_id % 50 = 0"), block=2).collect()}
    usable = {k: np.floor(256 * np.array(v)).astype(int) for k, v in rows if k is not None and v and None not in v and np.isfinite(v).all()}
    want = {}
    for q, v in usable.items():
        if q % 50 == 0:
            scored = sorted((-int(v @ w), k) for k, w in usable.items() if k != q and len(w) == len(v))[:5]
            want |= {(q, n + 1): (k, -s) for n, (s, k) in enumerate(scored)}
    assert got == want
    assert topk.search(vectors.limit(0), vectors.limit(0)).count() == 0


def test_line_dedup_compares_every_pair_of_a_hot_band(spark):
    """Variants of one template (similarity 0.6 to 0.79) share bands; families of near copies inside them are all found."""
    rng = random.Random(12)
    letters = [chr(0x400 + k) for k in range(400)]
    template = "".join(rng.choices(letters, k=94))
    lines = []
    for size in [1] * 60 + [2] * 60 + [3] * 30 + [5] * 10:
        own = "".join(rng.choices(letters, k=4))
        lines += [template + own + "".join(rng.choices(letters, k=10)) for _ in range(size)]
    rng.shuffle(lines)
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "doc_id bigint, text string")
    keys = line_dedup.signatures(lines, 9, 6, 4)
    grams = [line_dedup.shingle_set(x, 9) for x in lines]
    pairs = [(a, b) for a in range(len(lines)) for b in range(a) if (keys[a] == keys[b]).any() and 100 * len(grams[a] & grams[b]) >= 80 * len(grams[a] | grams[b])]
    want = {k for k, r in enumerate(union(len(lines), pairs)) if r != k}
    assert {r.id for r in line_dedup.dropped_lines(docs).collect()} == want
    assert {r.id for r in line_dedup.dropped_lines(docs, crowd=20).collect()} == want


def test_line_sketches_bound_the_symmetric_difference():
    rng = random.Random(2)
    lines = ["".join(rng.choices("abc", k=rng.randint(9, 80))) for _ in range(60)] + ["=" * 12, "=" * 40]
    sizes, words = line_dedup.sketches(lines, 9)
    grams = [line_dedup.shingle_set(x, 9) for x in lines]
    assert sizes.tolist() == [len(x) for x in grams]
    for a in range(len(lines)):
        for b in range(a):
            assert np.unpackbits((words[a] ^ words[b]).view(np.uint8)).sum() <= len(grams[a] ^ grams[b])


def test_line_dedup_of_several_texts_under_one_id(spark):
    """Of equal lines the first stays, by id, digest of the text and number; a text loses no line that stands nowhere before."""
    a, b, c, d = "first line of them all", "another line, quite long", "something else entirely", "a last one without a twin"
    rows = [(1, a), (5, a), (5, f"{b}\n{c}"), (5, f"{c}\n{d}"), (5, f"{c}\n{d}"), (7, None), (7, ""), (7, f"{d}\n{d}"), (None, a), (8, b)]
    docs = spark.createDataFrame([(i, x, k) for k, (i, x) in enumerate(rows)], "doc_id long, text string, mark long")
    key = {r.text: r.k for r in docs.select("text", line_dedup.text_key("text").alias("k")).collect()}
    seen, lost = set(), {}
    for i, x in sorted({(i, x) for i, x in rows if i is not None and x}, key=lambda r: (r[0], key[r[1]])):
        for k, line in enumerate(x.split("\n")):
            if line in seen:
                lost.setdefault((i, x), set()).add(k)
            seen.add(line)
    want = [(i, x if x is None else "\n".join(line for k, line in enumerate(x.split("\n")) if k not in lost.get((i, x), ())), k) for k, (i, x) in enumerate(rows)]
    got = line_dedup.dedup(docs)
    assert got.columns == ["doc_id", "text", "mark", "gone"]
    assert sorted(((r.doc_id, r.text, r.mark) for r in got.collect()), key=lambda r: r[2]) == want
    assert len(lost) >= 4


def test_line_dedup_of_lines_with_equal_sets_and_unequal_lengths(spark):
    docs = spark.createDataFrame([(1, "=" * 12), (2, "=" * 40)], "doc_id bigint, text string")
    assert [(r.id, r.gone) for r in line_dedup.dropped_lines(docs).collect()] == [(2, [0])]


def test_jaccard_join_of_crowded_keys(spark, monkeypatch):
    """Keys dealt by size band and chunk lose no link."""
    monkeypatch.setattr(components_module, "CROWD", 3)
    texts = near_copies()
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    sets = [shingles(t, 3) for t in texts]
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    want = union(len(texts), pairs)
    assert {r.doc_id: r.component_id for r in jaccard_join.join(docs).collect()} == dict(enumerate(want))


def test_line_dedup_recall_just_above_the_threshold(spark):
    """Pairs at similarity 0.82 (one letter of a hundred differs)."""
    rng = random.Random(21)
    letters = [chr(0x400 + k) for k in range(200)]
    lines = []
    for _ in range(300):
        own = rng.choices(letters, k=100)
        lines.append("".join(own))
        own[rng.randrange(20, 80)] = "#"
        lines.append("".join(own))
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")
    gone = {r.id for r in line_dedup.dropped_lines(docs).collect()}
    assert gone <= set(range(1, 600, 2)) and len(gone) >= 0.9 * 300


def test_lookup_of_hot_keys(spark):
    rows = common.materialize(spark.range(9000).selectExpr("IF(id < 5000, 0, id) AS k", "id"), "rows")
    table = common.materialize(rows.where("k % 3 = 0").groupBy("k").agg(F.count(F.lit(1)).alias("copies")), "table")
    got = {r.id: r.copies for r in common.lookup(rows, table, ["k"], "copies").collect()}
    assert got == {k: 5000 if k < 5000 else 1 if k % 3 == 0 else None for k in range(9000)}


def test_shared_keys_over_batch_edges(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(40), rng.randrange(60)) for _ in range(4000)] + [(100, 7)] * 9 + [(101, 1), (101, 2), (101, 2)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = [tuple(r) for r in components_module.shared_keys(spark.createDataFrame(rows, "key bigint, node bigint")).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    nodes = {k: {n for q, n in rows if q == k} for k, _ in rows}
    assert sorted(got) == sorted((k, n, min(own)) for k, own in nodes.items() if len(own) > 1 for n in own)


def test_a_pair_that_shares_many_keys_is_made_once(spark):
    rng = random.Random(5)
    keys = [rng.getrandbits(62) for _ in range(80)]
    placed = spark.createDataFrame([(key, node, node, 100) for node in range(30) for key in keys[: 20 + 2 * node]], "key bigint, node bigint, component bigint, n int")
    rows = components_module.open_rows(placed)
    made = components_module.made_pairs(rows.join(components_module.first_keys(rows), "node"), "true", 90).collect()
    assert {frozenset((r.a, r.b)) for r in made} == {frozenset((a, b)) for a in range(30) for b in range(a)}
    assert len(made) == 435


def test_histograms_bound_the_symmetric_difference(spark):
    rng = np.random.default_rng(21)
    bases = [np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)) for n in (1000, 30000)]
    sets = [np.unique(rng.integers(0, 2**64, 3, dtype=np.uint64))]
    sets += [np.unique(np.concatenate([base[k:], rng.integers(0, 2**64, k, dtype=np.uint64)])) for base in bases for k in (0, 1, *(len(base) * x // 1000 for x in (10, 40, 50, 51, 52, 53, 60, 900)))]
    sized = spark.createDataFrame([(k, len(x), jaccard_join.histogram(x).tolist()) for k, x in enumerate(sets)], "node bigint, n bigint, hist array<tinyint>")
    met = sized.alias("l").join(sized.alias("r"), F.expr(jaccard_join.fits("l", "r", 90))).select("l.node", F.col("r.node").alias("b"))
    fit = {(r.node, r.b) for r in met.collect()}
    links = {(a, b) for a, x in enumerate(sets) for b, y in enumerate(sets) if 100 * len(np.intersect1d(x, y)) >= 90 * len(np.union1d(x, y))}
    assert links <= fit and (1, 10) not in fit and (11, 1) not in fit


def test_line_links_equal_those_of_the_shingles():
    rng = random.Random(31)
    lines = ["short", "short\0", "Short", "x" * 40, "x" * 41]
    for size in (9, 10, 30, 120, 600):
        base = [rng.choice("abcdefgh") for _ in range(size)]
        for edits in (0, 1, 2, 3, 5, 8, 13):
            own = list(base)
            for _ in range(edits):
                own[rng.randrange(size)] = rng.choice("ABxyz")
            lines.append("".join(own))
    pairs = [(a, b) for a in range(len(lines)) for b in range(a)]
    sets = [line_dedup.shingle_set(line.lower(), 9) for line in lines]
    want = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    got = line_dedup.jaccard_links([a for a, _ in pairs], [b for _, b in pairs], [lines[a] for a, _ in pairs], [lines[b] for _, b in pairs], 80, 9)
    assert [*got] == want
