"""Places, brands, hierarchies, linkage and factors against plain versions."""

import itertools
import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from termloom.operators import brands, factors, graph, hierarchy, linkage, places


def test_places_by_priority_place_and_length(spark):
    cities = spark.createDataFrame([("Москва", 1), ("Санкт-Петербург", 1), ("Нижний Новгород", 1), ("Новгород", 1), ("Химки", 2), ("химки", 5), ("", 1), (None, 1)], "city string, priority int")
    forms = spark.createDataFrame([("Москва", "москве"), ("Москва", "Москвы"), ("Санкт-Петербург", "санкт-петербурге"), ("Химки", "химках"), ("Нет", "нету")], "city string, form string")
    aliases = spark.createDataFrame([("МСК", "Москва"), ("спб", "Санкт-Петербург"), ("в мск", "москве"), ("ё", "Неизвестный")], "short string, full string")
    known = places.place_forms(cities, forms, aliases)
    got = {r.form: (r.base, r.priority, r.words) for r in known.collect()}
    assert got["мск"] == ("москва", 1, 1) and got["химках"] == ("химки", 2, 1) and got["нижний новгород"][2] == 2 and "ё" not in got and "нету" not in got and "" not in got
    rows = [(1, "скуд в МОСКВЕ"), (2, "купить в санкт-петербурге, спб"), (3, "нижний новгород окна"), (4, "химки или москва"), (5, "новгород и мск"), (6, "московский"), (7, None), (8, ""), (9, "химках  химки"), (10, "для москвы-реки")]
    found = {r.row_id: r.place for r in places.resolve_places(spark.createDataFrame(rows, "row_id long, keyword string"), known).collect()}
    assert found == {1: "москва", 2: "санкт-петербург", 3: "нижний новгород", 4: "москва", 5: "новгород", 6: None, 7: None, 8: None, 9: "химки", 10: None}
    assert {r.place for r in places.resolve_places(spark.createDataFrame(rows, "row_id long, keyword string"), known.limit(0)).collect()} == {None}


def test_places_with_many_spellings(spark):
    cities = spark.range(300_000).select(F.concat(F.lit("город"), F.col("id")).alias("city"), F.lit(1).alias("priority"))
    rows = spark.createDataFrame([(1, "окна город299999 дешево"), (2, "город300000")], "row_id long, keyword string")
    assert {r.row_id: r.place for r in places.resolve_places(rows, places.place_forms(cities)).collect()} == {1: "город299999", 2: None}


def test_brand_rules_in_their_order(spark):
    text = "Bosch wilo ABB iPhone WeLD x й Москва Красный Болид Иван иванов с2000м HЕ-1 мойДом Кпа-5 по Купить Сталь wi MacBook"
    places_, common = spark.createDataFrame([("москва",)], "word string"), spark.createDataFrame([("по",), ("купить",), ("красный",)], "word string")
    forms = spark.createDataFrame([("сталь", "красный", False), ("иванов", "иванов", True), ("иван", "иван", True)], "form string, lemma string, name boolean")
    rows = spark.createDataFrame([(1, text), (2, None), (3, " ")], "row_id long, keyword string")
    got = {r.word: (r.reason, r.confidence) for r in brands.brand_words(rows, places_, common, forms).collect()}
    assert got == {
        "Bosch": ("latin_capitalized", 0.9), "wilo": ("latin_lowercase", 0.75), "ABB": ("latin_capitalized", 0.9), "iPhone": ("camel_case", 0.85), "WeLD": ("latin_capitalized", 0.9), "Болид": ("cyrillic_capitalized", 0.7),
        "Иван": ("cyrillic_capitalized", 0.7), "иванов": ("morph_name", 0.7), "HЕ-1": ("mixed_script", 0.6), "мойДом": ("capitals_inside", 0.65), "Кпа-5": ("model_number", 0.75), "MacBook": ("latin_capitalized", 0.9),
    }


def test_brands_of_queries_with_organisations(spark):
    rows = spark.createDataFrame([(1, "купить мойДом wilo"), (2, "насос"), (3, "мойДом"), (4, "ничего")], "row_id long, keyword string")
    none = spark.createDataFrame([], "word string")
    words = brands.brand_words(rows, none, none)
    plain = {r.row_id: (r.brand, r.confidence, r.n, r.is_brand_query) for r in brands.query_brands(rows, words).collect()}
    assert plain == {1: ("мойДом", 0.75, 2, True), 2: (None, 0.0, 0, False), 3: ("мойДом", 0.65, 1, False), 4: (None, 0.0, 0, False)}
    orgs = spark.createDataFrame([(1, "Wilo se"), (3, "мойдом"), (4, "газпром")], "row_id long, org string")
    got = {r.row_id: (r.brand, r.confidence, r.n, r.is_brand_query) for r in brands.query_brands(rows, words, orgs).collect()}
    assert got == {1: ("мойДом", 0.95, 3, True), 2: (None, 0.0, 0, False), 3: ("мойДом", 0.85, 1, True), 4: ("газпром", 0.6, 1, False)}


def learned(rows, common, lemmas, share, least):
    total, facts = len(rows), {}
    for text in rows:
        w = (text or "").split()
        for i, form in enumerate(w):
            if len(form) > 2:
                f = facts.setdefault(form.lower(), {"n": 0, "forms": {}, "near": set(), "caps": 0})
                f["n"] += 1
                f["forms"][form] = f["forms"].get(form, 0) + 1
                f["caps"] += form[0].isupper()
                f["near"] |= {x.lower() for x in w[max(0, i - 1) : i] + w[i + 1 : i + 2]}
    topics = {w for w, f in facts.items() if f["n"] >= share * total}
    out = set()
    for w, f in facts.items():
        plain = w in common or lemmas.get(w) in common | topics
        if w in topics:
            continue
        rule = None
        if re.fullmatch(r"[a-z0-9\-]+", w):
            rule = None if w.isdigit() else "latin"
        elif len(w) <= 5 and sum(c in brands.VOWELS for c in w) <= 1 and f["n"] >= least:
            rule = "acronym" if not plain and len(f["forms"]) <= 3 and f["n"] >= 5 else None
        elif len(f["near"]) >= 3 and f["n"] >= 5 and f["caps"] and len(f["forms"]) <= 4 and not plain:
            rule = "contexts"
        if rule:
            out.add((w, min(f["forms"], key=lambda x: (-f["forms"][x], x.encode())), rule, f["n"]))
    return out


def test_learned_brands_equal_a_plain_version(spark):
    rng = random.Random(5)
    vocabulary = ["скуд", "болид", "Болид", "БОЛИД", "скд", "СКД", "скд", "дверь", "Дверь", "wilo", "Wilo", "2000", "ab-1", "купить", "цена", "Парсек", "парсек", "дом", "на", "скуда"]
    rows = [" ".join(rng.choices(vocabulary, k=rng.randrange(1, 5))) + (" скуд" if rng.random() < 0.6 else "") for _ in range(120)] + [None, "", "Один"]
    common, lemmas = {"дверь", "дом"}, {"скуда": "скуд", "цена": "дом"}
    given = spark.createDataFrame([(t,) for t in rows], "keyword string").repartition(3)
    got = brands.learn_brands(given, spark.createDataFrame([(c,) for c in common], "word string"), spark.createDataFrame(list(lemmas.items()), "form string, lemma string"))
    assert {tuple(r) for r in got.collect()} == learned(rows, common, lemmas, 0.5, 3) and got.count() > 3


def tree(rng, depth):
    return [{"level": rng.choice([None, depth]), "type": "category", "name": f"n{rng.randrange(99)}", "slug": f"s{depth}", "clusters": ["a", "b"], "children": tree(rng, depth + 1) if depth < 7 and rng.random() < 0.7 else rng.choice([[], None])} for _ in range(rng.randrange(1, 3))]


def flat(items, place=(), path=""):
    for at, x in enumerate(items):
        full = f"{path} > {x['name']}" if path else x["name"]
        yield (*place, at), x["level"] or 1, x["name"], x["slug"], full
        yield from flat(x["children"] or [], (*place, at), full)


def test_hierarchy_at_any_depth(spark):
    docs = {k: {"hierarchy": tree(random.Random(k), 1), "recommendations": ["one", "two"] if k % 2 else [], "seo_notes": "note" if k % 3 else ""} for k in range(8)}
    rows = [(k, json.dumps(d), "shop") for k, d in docs.items()] + [(90, None, None), (91, "{", None), (92, "{}", None), (93, '{"hierarchy": []}', None), (94, '{"hierarchy": [{"children": 5}, null]}', None)]
    given = spark.createDataFrame(rows, "cluster_id long, hierarchy string, context string")
    got = {(r.cluster_id, tuple(r.place)): (r.level, r.name, r.slug, r.path) for r in hierarchy.flatten_hierarchy(given).collect()}
    want = {(k, p): tuple(rest) for k, d in docs.items() for p, *rest in flat(d["hierarchy"])}
    assert got == want | {(94, (0,)): (1, "", "", "")}
    report = hierarchy.hierarchy_report(given).collect()
    assert {(r.cluster_id, r.path) for r in report if r.part == 1} == {(k, "one\ntwo") for k in docs if k % 2} and {r.cluster_id for r in report if r.part == 2} == {k for k in docs if k % 3}
    assert sum(r.part == 0 for r in report) == len(got) and {r.context for r in report} == {"shop", ""}


@pytest.mark.parametrize("seed", [1])
def test_single_linkage_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    nodes = list(range(40))
    edges = [(a, b, float(rng.randrange(1, 30))) for a, b in itertools.combinations(nodes, 2) if rng.random() < 0.15] + [(3, 3, 0.0), (5, 4, 2.0), (4, 5, 1.0), (None, 2, 1.0)]
    frames = spark.createDataFrame(edges, "src long, dst long, distance double"), spark.createDataFrame([(n,) for n in nodes], "node long")
    forest = linkage.spanning_forest(frames[0])
    label, chosen = {n: n for n in nodes}, []
    for w, a, b in sorted((w, min(a, b), max(a, b)) for a, b, w in edges if a is not None and a != b):
        if label[a] != label[b]:
            chosen.append((a, b, w))
            x, y = sorted((label[a], label[b]))
            label = {n: x if c == y else c for n, c in label.items()}
    assert {tuple(r) for r in forest.collect()} == set(chosen)
    for clusters in (5, 39):
        kept = chosen[: max(0, len(chosen) - max(0, clusters - (len(nodes) - len(chosen))))]
        label = {n: n for n in nodes}
        for a, b, _ in kept:
            x, y = sorted((label[a], label[b]))
            label = {n: x if c == y else c for n, c in label.items()}
        assert {r.node: r.cluster for r in linkage.cut(forest, frames[1], clusters).collect()} == label
    assert [r.height for r in linkage.dendrogram(forest).orderBy("step").collect()] == sorted(w for *_, w in chosen)
    assert linkage.spanning_forest(frames[0].limit(0)).count() == 0


def test_levels_divide_each_other_and_the_largest_jump_is_found(spark):
    points = [c * 100 + x for c in range(3) for x in (0, 1, 2, 3)]
    edges = spark.createDataFrame([(a, b, float(abs(a - b))) for a, b in itertools.combinations(points, 2)], "src long, dst long, distance double")
    nodes = spark.createDataFrame([(p,) for p in points], "node long")
    forest = linkage.spanning_forest(edges)
    assert linkage.best_number(forest, nodes) == 3
    levels = linkage.multilevel(forest, nodes, (3, 6)).collect()
    assert {r.level_3 for r in levels} == {0, 100, 200} and len({(r.level_3, r.level_6) for r in levels}) == 6


def test_factors_equal_a_numpy_version_and_the_loss_falls(spark):
    rng = np.random.default_rng(3)
    v = np.floor(rng.random((30, 12)) * 4) * (rng.random((30, 12)) < 0.4)
    cells = spark.createDataFrame([(i, f"t{j:02d}", float(v[i, j])) for i in range(30) for j in range(12) if v[i, j]], "id long, term string, value double")
    w0, h0 = factors.factorise(cells, 3, 0)
    ids, terms = [r.id for r in w0.orderBy("id").collect()], [r.term for r in h0.orderBy("term").collect()]
    w, h = np.array([r.f for r in w0.orderBy("id").collect()]), np.array([r.f for r in h0.orderBy("term").collect()]).T
    x = v[np.ix_(ids, [int(t[1:]) for t in terms])]
    losses = []
    for _ in range(2):
        h = h * (w.T @ x) / (w.T @ w @ h + 1e-12)
        w = w * (x @ h.T) / (w @ h @ h.T + 1e-12)
        losses.append(((x - w @ h) ** 2).sum())
    got_w, got_h = factors.factorise(cells, 3, 2)
    assert np.allclose(np.array([r.f for r in got_w.orderBy("id").collect()]), w, atol=1e-6) and np.allclose(np.array([r.f for r in got_h.orderBy("term").collect()]).T, h, atol=1e-6)
    assert abs(factors.loss(cells, got_w, got_h, 3) - losses[-1]) < 1e-6 and all(a >= b for a, b in zip(losses, losses[1:], strict=False))
    for r in factors.topic_assignments(got_w).collect():
        s = w[ids.index(r.id)] / w[ids.index(r.id)].sum()
        assert r.topic == (int(s.argmax()) if s.max() >= 0.3 else -1) and set(r.topics) == {k for k in range(3) if s[k] >= 0.15}
    names = {r.topic: r.name for r in factors.topic_names(got_h).collect()}
    assert all(names[k] == " + ".join(terms[j] for j in np.argsort(-h[k], kind="stable")[:3]) for k in names)
    assert factors.factorise(cells.limit(0), 3, 2)[0].count() == 0


def test_forest_of_rounds_with_ties_equals_kruskal(spark):
    """Several rounds with equal distances; edges between the same two parts are reduced to the least."""
    rng = random.Random(12)
    edges = [(a, b, float(rng.randrange(1, 4))) for a in range(60) for b in range(a + 1, 60) if rng.random() < 0.1] + [(100, 101, 2.0)]
    root = {n: n for e in edges for n in e[:2]}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    want = set()
    for a, b, h in sorted(edges, key=lambda e: (e[2], e[0], e[1])):
        if find(a) != find(b):
            root[find(a)] = find(b)
            want.add((a, b, h))
    assert {tuple(r) for r in linkage.spanning_forest(spark.createDataFrame(edges, "src long, dst long, distance double")).collect()} == want


def test_components_broadcast_nothing(spark, monkeypatch):
    plans, write = [], graph.checkpointed

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(graph, "checkpointed", seen)
    got = graph.components(spark.createDataFrame([(1, 2), (3, 2), (8, 9)], "src long, dst long")).collect()
    assert {tuple(r) for r in got} == {(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)} and not any("Broadcast" in p for p in plans)


@pytest.mark.parametrize("chunk", [8, 40, 1_000_000])
def test_forest_and_levels_by_chunks_equal_kruskal(spark, monkeypatch, chunk):
    """Long paths with ties, parallel edges and other nodes: whatever a task may hold, the forest is the same and so are the levels."""
    monkeypatch.setattr(graph, "CHUNK", chunk)
    rng = random.Random(7)
    edges = [(n, n + 1, float(rng.randrange(1, 4))) for n in range(90) if n != 50] + [(n, rng.randrange(91), 5.0) for n in range(20)] + [(4, 3, 0.5), (7, 7, 0.0), (None, 1, 0.0), (1, 2, None)]
    edges = [(a, b, h) for a, b, h in edges if None in (a, h) or (a <= 50) == (b <= 50)]
    frame = spark.createDataFrame(edges, "src long, dst long, distance double").repartition(3)
    forest = linkage.spanning_forest(frame)
    root, want = {n: n for n in range(91)}, []
    for h, a, b in sorted((h, min(a, b), max(a, b)) for a, b, h in edges if a is not None and h is not None and a != b):
        if root[a] != root[b]:
            want.append((a, b, h))
            root = {n: min(root[a], root[b]) if c in (root[a], root[b]) else c for n, c in root.items()}
    assert sorted(map(tuple, forest.collect())) == sorted(want)
    nodes = spark.createDataFrame([(n,) for n in range(5, 95)], "node long")
    levels = {r.node: r for r in linkage.multilevel(forest, nodes, (2, 9, 20)).collect()}
    assert len(levels) == 90
    for n in (2, 9, 20):
        assert {k: r[f"level_{n}"] for k, r in levels.items()} == {r.node: r.cluster for r in linkage.cut(forest, nodes, n).collect()}


def test_a_long_path_takes_few_tables(spark, monkeypatch):
    """The forest and three levels of a path of 3,000 nodes, which rounds alone would shrink in many steps."""
    written, write = [], graph.checkpointed
    for module in (graph, linkage):
        monkeypatch.setattr(module, "checkpointed", lambda df: written.append(1) or write(df))
    edges = spark.range(3000).selectExpr("id AS src", "id + 1 AS dst", "CAST(id % 97 AS DOUBLE) AS distance")
    levels = linkage.multilevel(linkage.spanning_forest(edges), spark.range(3001).toDF("node"))
    assert levels.agg({"level_30": "max"}).first()[0] > 0 and len(written) <= 8
