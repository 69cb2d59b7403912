"""Fuzzy duplicates, cosine pairs and communities against brute force."""

import difflib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from termloom.operators import fuzzy, vectors


def brute_merge(rows, threshold):
    order = sorted((k for k in rows if k[1] is not None), key=lambda r: (r[1].encode(), r[0]))
    leader, out = [], {}
    for i, text, w in order:
        for j, other in leader:
            if difflib.SequenceMatcher(None, other.lower(), text.lower()).ratio() >= threshold:
                out[i] = j
                break
        else:
            leader.append((i, text))
            out[i] = i
    out |= {r[0]: r[0] for r in rows if r[1] is None}
    best = {}
    for n, (i, _, w) in enumerate(order + [r for r in rows if r[1] is None]):
        best.setdefault(out[i], []).append((-(w if w is not None else float("-inf")), n, i))
    kept = {min(x)[2] for x in best.values()}
    return {(i, out[i], i in kept) for i in out}


def keywords(n, seed):
    rng = random.Random(seed)
    words = ["купить", "насос", "дешево", "wilo", "цена", "москва", "для", "дома", "pump", "price", "a", "\U0001f600x"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 6))) for _ in range(n // 6)]
    out = ["", "", "a", "b", "ab", "abc", "Abc", "x" * 230, "x" * 229 + "y", "ab" * 150, "ab" * 149 + "ba"]
    while len(out) < n:
        t = list(rng.choice(base))
        for _ in range(rng.randrange(0, 4)):
            at = rng.randrange(len(t) + 1)
            t[at : at + rng.randrange(2)] = rng.choice("абвxyz ")
        out.append("".join(t).upper() if rng.random() < 0.1 else "".join(t))
    return [(k, t, rng.choice([None, 1.0, 2.0, 3.0, 3.0])) for k, t in enumerate(out)]


@pytest.mark.parametrize("threshold", [0.9])
def test_fuzzy_merge_equals_brute_force(spark, threshold):
    rows = [*keywords(220, 3), (900, None, 5.0)]
    got = fuzzy.merge_similar(spark.createDataFrame(rows, "row_id long, keyword string, frequency_exact double").repartition(4), threshold)
    assert {tuple(r) for r in got.collect()} == brute_merge(rows, threshold) and got.count() == len(rows)


def test_similar_texts_miss_no_pair(spark):
    texts = sorted({t.lower() for _, t, _ in keywords(260, 8)})
    got = {(r.a, r.b): r.ratio for r in fuzzy.similar_texts(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), 0.85).collect()}
    want = {(i, j): difflib.SequenceMatcher(None, x, y).ratio() for i, x in enumerate(texts) for j, y in enumerate(texts) if i < j}
    assert got == {k: r for k, r in want.items() if r >= 0.85} and got
    with pytest.raises(ValueError):
        fuzzy.similar_texts(spark.range(1).select("id", F.lit("a").alias("text")), 0.5)


def test_leaders_of_chains_and_hubs(spark):
    rng = random.Random(1)
    for edges in ([(i, i + 1) for i in range(7)], [(a, b) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(120)) if a < b], []):
        near, want = {}, {}
        for a, b in edges:
            near.setdefault(b, set()).add(a)
        for node in sorted({x for e in edges for x in e}):
            first = [a for a in sorted(near.get(node, ())) if want[a] == a]
            want[node] = first[0] if first else node
        assert {r.node: r.leader for r in fuzzy.leaders(spark.createDataFrame(edges, "a long, b long")).collect()} == want


def test_fuzzy_merge_of_an_empty_table(spark):
    assert fuzzy.merge_similar(spark.createDataFrame([], "row_id long, keyword string, frequency_exact double")).count() == 0


SHAPE = "vec_id long, embedding array<float>, v string"


def clustered(n, width, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, width))
    return [(i, [float(np.float32(x)) for x in centres[i % 9] + rng.normal(size=width) * 0.25], "clash") for i in range(n)]


@pytest.mark.parametrize(("threshold", "width"), [(0.5, 24), (0.97, 3), (-0.2, 5)])
def test_cosine_pairs_equal_brute_force(spark, monkeypatch, threshold, width):
    monkeypatch.setattr(vectors, "BLOCK", 40)
    rows = clustered(300, width, 5)
    given = spark.createDataFrame([*rows, (900, [0.0] * width, "zero"), (901, None, ""), (902, [float("nan")] * width, ""), (None, [1.0] * width, "")], SHAPE).repartition(3)
    got = {(r.a, r.b): r.cosine for r in vectors.cosine_pairs(given, threshold).collect()}
    m = np.array([r[1] for r in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    c = m @ m.T
    want = {(i, j): c[i, j] for i in range(300) for j in range(i + 1, 300) if c[i, j] >= threshold}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert vectors.cosine_pairs(given.limit(0)).count() == 0


def test_bounds_save_most_visits_of_clustered_vectors(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 40)
    made, without = vectors.cell_visits(spark.createDataFrame(clustered(400, 24, 6), SHAPE), 0.9)
    assert 0 < without and made < 0.35 * without


def test_visitors_of_a_block_are_split_and_no_pair_is_lost(spark, monkeypatch):
    """Nothing bounds random directions, so every row visits every later block; no task gets more than a few groups of them."""
    monkeypatch.setattr(vectors, "BLOCK", 20)
    monkeypatch.setattr(vectors, "PIVOTS", 4)
    monkeypatch.setattr(vectors, "SPAN", 2)
    v = np.random.default_rng(5).normal(size=(400, 6))
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
    placed = vectors._placed(vectors.checkpointed(vectors.unit_vectors(rows)))
    sent = placed[0].select("id", "v", "d", "home").mapInPandas(vectors._visits(*placed[1:], 2.0), "block long, part long, kind int, id long, v array<double>")
    sizes = {(r.block, r.part): r["count"] for r in sent.groupBy("block", "part").count().collect()}
    most = max(r["count"] for r in placed[0].groupBy("home").count().collect())
    assert len({b for b, _ in sizes}) >= 20 and max(sizes.values()) <= 3 * most
    u = v / np.linalg.norm(v, axis=1)[:, None]
    want = {(int(a), int(b)) for a, b in np.argwhere(u @ u.T >= 0.5) if a < b}
    assert {(r.a, r.b) for r in vectors.cosine_pairs(rows, 0.5).collect()} == want
