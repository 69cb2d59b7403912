"""Louvain, full-link and word-match clusters against sequential versions."""

import random
import re
from collections import Counter

import pytest

import __spark_entry__
from termloom.operators import cluster, communities, fulllink, graph, wordmatch
from termloom.plans import catalogue
from termloom.plans.roles import role

SF = "/root/testdata/sf0.001"


def modularity(edges, label, resolution=1.0):
    m2, total, inside = 0.0, Counter(), 0.0
    for a, b, w in edges:
        m2 += 2 * w
        total[label[a]] += w
        total[label[b]] += w
        inside += 2 * w * (label[a] == label[b])
    return inside / m2 - resolution * sum(t * t for t in total.values()) / m2**2


def sequential_louvain(edges):
    """Plain local moves and contraction, node by node."""
    near = {}
    for a, b, w in edges:
        near.setdefault(a, Counter())[b] += w
        near.setdefault(b, Counter())[a] += w
    m2 = 2 * sum(w for *_, w in edges)
    name = {n: n for n in near}
    while True:
        label, k = {n: n for n in near}, {n: sum(c.values()) for n, c in near.items()}
        tot, moved, any_move = dict(k), True, False
        while moved:
            moved = False
            for n in sorted(near):
                own = label[n]
                tot[own] -= k[n]
                links = Counter()
                for o, w in near[n].items():
                    if o != n:
                        links[label[o]] += w
                best = max([own, *links], key=lambda c: (round(links[c] - k[n] * tot[c] / m2, 9), c == own, -c))
                tot[best] += k[n]
                if best != own:
                    label[n], moved, any_move = best, True, True
        if not any_move:
            return name
        name = {n: label[c] for n, c in name.items()}
        again = {}
        for a, c in near.items():
            for b, w in c.items():
                again.setdefault(label[a], Counter())[label[b]] += w
        near = again


def planted(groups, size, inside, outside, seed):
    rng = random.Random(seed)
    out = []
    for a in range(groups * size):
        for b in range(a + 1, groups * size):
            if rng.random() < (inside if a // size == b // size else outside):
                out.append((a, b, rng.choice([0.5, 1.0, 2.0])))
    return out


def test_louvain_is_as_good_as_a_sequential_one(spark):
    edges = planted(4, 10, 0.6, 0.05, 3)
    got = communities.louvain(spark.createDataFrame(edges, "src long, dst long, weight double"))
    label = {r.node: r.community for r in got.collect()}
    want = sequential_louvain(edges)
    assert label.keys() == want.keys() and all(label[c] == c for c in label.values())
    assert modularity(edges, label) >= 0.99 * modularity(edges, want)
    links = communities.adjacency(spark.createDataFrame(edges, "src long, dst long, weight double"))
    assert abs(communities.modularity(links, got) - modularity(edges, label)) < 1e-9
    facts = {r.community: r for r in communities.community_facts(spark.createDataFrame(edges, "src long, dst long, weight double"), got).collect()}
    for c in set(label.values()):
        own = [n for n in label if label[n] == c]
        inner = [e for e in edges if label[e[0]] == c == label[e[1]]]
        assert facts[c].size == len(own) and abs(facts[c].inside - sum(e[2] for e in inner)) < 1e-9 and abs(facts[c].density - 2 * len(inner) / (len(own) * (len(own) - 1))) < 1e-9


def test_a_louvain_round_groups_edges_once(spark):
    """By node and community, with the node's own community among them; degrees that are known give the same modularity."""
    edges = communities.adjacency(spark.createDataFrame(planted(3, 6, 0.7, 0.1, 5), "src long, dst long, weight double"))
    links = spark.createDataFrame(edges.collect(), "src long, dst long, w double")
    degrees = links.groupBy(links.src.alias("node")).agg({"w": "sum"}).toDF("node", "k").selectExpr("node", "node div 6 * 6 AS community", "k").collect()
    labels = spark.createDataFrame(degrees, "node long, community long, k double")
    total = links.agg({"w": "sum"}).first()[0]
    moved = communities._moved(links, labels, total, 1.0, 0, 1)
    assert moved._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 3
    assert abs(communities.modularity(links, labels) - communities.modularity(links, labels.drop("k"))) < 1e-12
    assert {r.node for r in moved.collect()} == {r.node for r in labels.collect()}


def test_louvain_of_small_graphs(spark):
    two = [(1, 2), (2, 3), (1, 3), (4, 5), (5, 6), (4, 6), (3, 4), (9, 9), (None, 3)]
    got = {r.node: r.community for r in communities.louvain(spark.createDataFrame(two, "src long, dst long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 9: 9}
    assert communities.louvain(spark.createDataFrame([], "src long, dst long")).count() == 0


def sequential_full_link(pairs, order, cap, geo=None):
    near = {}
    for a, b in pairs:
        if geo is None or geo.get(a) == geo.get(b):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    members = []
    for q, _ in sorted(order, key=lambda r: (-(r[1] if r[1] is not None else float("-inf")), r[0])):
        for c in members:
            if len(c) < cap and all(m in near.get(q, ()) for m in c):
                c.append(q)
                break
        else:
            members.append([q])
    return {q: c[0] for c in members for q in c}


@pytest.mark.parametrize(("batch", "cap"), [(4000, 100), (7, 4)])
def test_full_link_equals_the_sequential_rule(spark, monkeypatch, batch, cap):
    monkeypatch.setattr(fulllink, "BATCH", batch)
    rng = random.Random(batch)
    order = [(q, rng.choice([None, 1.0, 5.0, 5.0, 9.0, float(q)])) for q in range(120)]
    pairs = [(a, b) for a in range(118) for b in range(a + 1, 118) if rng.random() < (0.7 if a // 12 == b // 12 else 0.02)]
    geo = {q: rng.choice([None, "x", "x", "x"]) for q in range(120)}
    frames = spark.createDataFrame(pairs, "q1 long, q2 long"), spark.createDataFrame(order, "q long, weight double")
    got = {r.q: r.cluster for r in fulllink.full_link_clusters(*frames, cap=cap).collect()}
    assert got == sequential_full_link(pairs, order, cap)
    if batch == 7:  # places as well
        places = spark.createDataFrame(list(geo.items()), "q long, geo string")
        assert {r.q: r.cluster for r in fulllink.full_link_clusters(*frames, cap=cap, places=places).collect()} == sequential_full_link(pairs, order, cap, geo)
        assert {r.q: r.cluster for r in fulllink.full_link_clusters(frames[0].limit(0), frames[1]).collect()} == {q: q for q, _ in order}


def sequential_word_match(rows, strength, least):
    sets = {q: {w for w in re.findall(r"\b[а-яёa-z0-9]+\b", (t or "").lower()) if w not in wordmatch.STOP_WORDS} for q, t, _ in rows}
    order = [q for q, _, w in sorted(rows, key=lambda r: (-(r[2] if r[2] is not None else float("-inf")), r[0]))]
    average = lambda q, c: sum(len(sets[q] & sets[m]) for m in c) / len(c)
    clusters = []
    for q in order:
        best, at = 0, None
        for k, c in enumerate(clusters):
            if (a := average(q, c)) >= strength and a > best:
                best, at = a, k
        if at is None:
            clusters.append([q])
        else:
            clusters[at].append(q)
    before, after = {c[0]: list(c) for c in clusters}, {c[0]: list(c) for c in clusters}
    for name, c in before.items():
        own = {q: sum(len(sets[q] & sets[m]) for m in c if m != q) / max(len(c) - 1, 1) for q in c}
        moves = {}
        for q in c if len(c) > 1 else []:
            best = max(((average(q, o), -n) for n, o in before.items() if n != name), default=(0, 0))
            if best[0] > own[q] + 1e-9:
                moves[q] = -best[1]
        if len(moves) == len(c):
            del moves[max(moves, key=lambda q: (own[q], q))]
        for q, to in moves.items():
            after[name].remove(q)
            after[to].append(q)
    kept = {n: c for n, c in after.items() if len(c) >= least}
    out = {q: n for n, c in kept.items() for q in c}
    for n, c in after.items():
        if n not in kept:
            for q in c:
                best = max(((average(q, o), -m) for m, o in kept.items()), default=(0, 0))
                out[q] = -best[1] if best[0] >= max(1, strength - 1) else -1
    return out


@pytest.mark.parametrize(("batch", "strength", "least"), [(20, 2, 2), (4000, 1, 3)])
def test_word_match_equals_the_sequential_rule(spark, monkeypatch, batch, strength, least):
    monkeypatch.setattr(fulllink, "BATCH", batch)
    rng = random.Random(7 * batch + strength)
    words = ["купить", "насос", "для", "дома", "цена", "pump", "красный", "синий", "wilo", "москва", "отзывы", "как", "выбрать", "лучший", "новый", "5"]
    rows = [(q, " ".join(rng.choices(words, k=rng.randrange(1, 6))), rng.choice([None, 1.0, 4.0, 4.0, float(q)])) for q in range(130)] + [(500, None, 9.0), (501, "", None), (502, "Одно-слово, ДОМА!", 2.0)]
    given = spark.createDataFrame(rows, "row_id long, keyword string, w double")
    got = wordmatch.word_match_clusters(given, strength=strength, least_size=least).collect()
    assert {r.row_id: r.cluster for r in got} == sequential_word_match(rows, strength, least) and len(got) == len(rows)
    heaviest = {}
    for q, t, w in rows:
        c = {r.row_id: r.cluster for r in got}[q]
        heaviest[c] = max(heaviest.get(c, (float("-inf"), -(10**9), None)), (w if w is not None else float("-inf"), -q, t), key=lambda x: x[:2])
    assert all(r.name == heaviest[r.cluster][2] for r in got if r.cluster != -1)
    details = wordmatch.cluster_details(given, wordmatch.word_match_clusters(given, strength=strength, least_size=least))
    assert all(2 * r.n >= r.size for r in details.collect())


@pytest.mark.parametrize("strength", [1, 2, 3])
def test_word_match_in_rounds_with_equal_word_sets(spark, monkeypatch, strength):
    """Rounds of 25 on queries of which many have equal word sets; profiles are carried from round to round."""
    monkeypatch.setattr(wordmatch, "BATCH", 25)
    rng = random.Random(strength)
    words = ["pump", "wilo", "red", "blue", "price", "shop", "7", "9"]
    rows = [(q, " ".join(rng.choices(words, k=rng.randrange(1, 5))), float(rng.randrange(6))) for q in range(110)] + [(200, "rare lonely words", 1.0), (201, "words rare lonely", 2.0)]
    got = wordmatch.word_match_clusters(spark.createDataFrame(rows, "row_id long, keyword string, w double"), strength=strength).collect()
    assert {r.row_id: r.cluster for r in got} == sequential_word_match(rows, strength, 2) and len(got) == len(rows)


def test_shared_url_pairs_shuffle_lists_and_no_pairs(spark):
    """Both sides of one join are shuffled, nothing after it: pairs that meet are neither grouped nor joined again."""
    plan = cluster.shared_url_pairs(spark.createDataFrame([(1, 1), (2, 1)], "q long, u long"), 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("SortMergeJoin") == 1 and "Aggregate" not in plan and "Broadcast" not in plan


@pytest.mark.parametrize("name", ["j7_shared_url_pairs", "l2_overlaps_in_clusters", "u1_common_urls", "u2_jaccard"])
def test_pairs_of_the_operator_equal_the_statement(spark, name):
    got = __spark_entry__.queries()[name](spark, SF)
    want = catalogue.apply(spark, name, serp=role(spark, SF, "serp"))
    assert got.select(*want.columns).exceptAll(want).isEmpty() and got.count() == want.count() > 0


def test_shared_url_pairs_by_prefix_equal_brute_force(spark):
    rng = random.Random(4)
    serp = [(q, u) for q in range(80) for u in {rng.choice([0, 1, rng.randrange(12), rng.randrange(60)]) for _ in range(rng.randrange(1, 15))}]
    sets = {}
    for q, u in serp:
        sets.setdefault(q, set()).add(u)
    for threshold in (1, 4):
        got = {(r.q1, r.q2): r.common for r in cluster.shared_url_pairs(spark.createDataFrame(serp + serp[:9], "q long, u long"), threshold).collect()}
        want = {(a, b): len(sets[a] & sets[b]) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= threshold}
        assert got == want


@pytest.mark.parametrize("chunk", [200, 35])
def test_louvain_by_blocks_is_louvain_of_one_task(spark, monkeypatch, chunk):
    """The same communities whether one task holds the graph, or tasks hold blocks of its links; with more nodes than a task may hold, they are as good."""
    edges = planted(4, 10, 0.6, 0.05, 3) + [(60, 60, 1.0)]
    frame = spark.createDataFrame(edges, "src long, dst long, weight double")
    want = {r.node: r.community for r in communities.louvain(frame, cycles=1).collect()}
    used, real = [], communities._settled_by_blocks
    monkeypatch.setattr(communities, "_settled_by_blocks", lambda *a: used.append(1) or real(*a))
    monkeypatch.setattr(graph, "CHUNK", chunk)
    got = {r.node: r.community for r in communities.louvain(frame, cycles=1).collect()}
    assert bool(used) == (chunk == 200) and got.keys() == want.keys() and all(got[c] == c for c in got.values()) and got[60] == 60
    assert got == want if used else modularity(edges, got) >= 0.95 * modularity(edges, want)


def test_louvain_of_a_small_graph_takes_few_tables(spark, monkeypatch):
    written, write = [], communities.checkpointed
    monkeypatch.setattr(communities, "checkpointed", lambda df: written.append(1) or write(df))
    edges = planted(4, 10, 0.6, 0.05, 3)
    got = communities.louvain(spark.createDataFrame(edges, "src long, dst long, weight double"))
    assert got.count() == 40 and len(written) <= 6
