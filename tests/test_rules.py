import json

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from termloom.functions import rules
from termloom.operators import cluster, documents, lists, refine
from termloom.plans import rules as plans
from termloom.plans import rules_sql
from termloom.sources import groups

SF = "/root/testdata/sf0.001"


def test_sql_has_no_query_missing():
    assert set(rules_sql.SQL) <= set(plans.QUERIES) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["m25_difficulty_score", "c12_funnel_stage", "c8_recalculated", "c25_aggregate_phrases", "g1_normal_documents", "f7_stop_domain_filter"])
def test_functions_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("part", "lineitem", "orders", "events", "documents"):
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    mine = plans.QUERIES[name](spark, SF)
    theirs = con.sql(rules_sql.oracle_sql()[name]).df()
    rows = lambda df: sorted(map(str, df[sorted(mine.columns)].itertuples(index=False, name=None)))
    assert rows(mine.toPandas()) == rows(theirs)


def test_difficulty_at_the_limits(spark):
    """The rule's own numbers, on both sides of each limit."""
    rows = [(10_001, 0, 3, False, False, 40.0), (10_000, 0, 3, False, False, 30.0), (5_000, 0, 3, False, False, 20.0), (1_000, 0, 3, False, False, 10.0), (100, 0, 3, False, False, 5.0), (100, 50, 1, True, True, 60.0), (0, 0, 6, False, False, 0.0), (20_000, 20_000, 1, True, True, 100.0)]
    number = lambda rows, *at: [tuple(float(x) if k in at else x for k, x in enumerate(r)) for r in rows]
    got = spark.createDataFrame(number(rows, 0, 1), "w double, e double, n int, c boolean, b boolean, want double").select("want", rules.difficulty_score(F.col("w"), F.col("e"), F.col("n"), F.col("c"), F.col("b")).alias("v"))
    assert all(r.v == r.want for r in got.collect())
    plan = [(100, 0, True, "quick_wins"), (1000, 49, True, "quick_wins"), (1000, 50, True, "medium"), (99, 900, True, "long_tail"), (5001, 501, True, "competitive"), (5001, 99, False, "informational_easy"), (5000, 501, True, "medium")]
    got = spark.createDataFrame(number(plan, 0, 1), "w double, e double, c boolean, want string").select("want", rules.strategy(F.col("w"), F.col("e"), F.col("c")).alias("v"))
    assert all(r.v == r.want for r in got.collect())


def test_whole_words_in_scores_and_parts_in_flags(spark):
    rows = spark.createDataFrame([("купить опт",), ("закупить",), ("что такое опт",), (None,)], "k string")
    scores = rules.intent_scores(F.col("k"), ("купить", "опт"), ("что", "что такое"), ())
    got = rows.select(*[c.alias(n) for n, c in scores.items()], rules.contains_any(F.col("k"), ("купить",)).alias("flag")).collect()
    assert [tuple(r) for r in got[:3]] == [(6.0, 0.0, 0.0, True), (0.0, 0.0, 0.0, True), (3.0, 7.0, 0.0, False)]


def test_result_page_in_xml(spark):
    page = """<x><grouping><group id="1"><doc id="a"><url>http://www.Shop.ru/p</url><title>A <hl>b</hl> &amp; c</title><headline>head</headline><passages><passage>one</passage><passage>two <hl>x</hl></passage></passages></doc><doc><url>no</url></doc></group>
    <group><doc><url>http://z.org/</url><domain>z.org</domain><title/><properties><extended-text>long</extended-text></properties></doc></group><group></group></grouping></x>"""
    docs = spark.createDataFrame([(1, page), (2, None), (3, "<broken><group><doc>")], "q int, xml string").select("q", documents.xml_documents(F.col("xml")).alias("d")).collect()
    assert [d.asDict() for d in docs[0].d] == [
        {"position": 1, "url": "http://www.Shop.ru/p", "domain": "shop.ru", "title": "A b & c", "snippet": "head", "extended_text": "", "passages": "one two x", "is_commercial": True},
        {"position": 2, "url": "http://z.org/", "domain": "z.org", "title": "", "snippet": "long", "extended_text": "long", "passages": "", "is_commercial": False},
    ]
    assert docs[1].d == [] and docs[2].d == []
    titles, texts = spark.createDataFrame([(docs[0].d,)], "d array<struct<position:int,url:string,domain:string,title:string,snippet:string,extended_text:string,passages:string,is_commercial:boolean>>").select(*documents.texts_of(F.col("d"))).first()
    assert (titles, texts) == ("A b & c", "one two x ; long")


def test_stored_lists_of_all_forms(spark):
    forms = [None, "", "null", "[]", "{bad", "one", "http://a.ru | http://www.b.ru/x", "http://a.ru,http://c.ru", '["http://a.ru", " "]', '[{"url": "http://a.ru", "position": 0, "title": "t"}, {"title": "x"}, {"url": "u.ru", "position": 9}]']
    got = [[(d.position, d.url, d.domain, d.title) for d in r.d] for r in spark.createDataFrame([(k, f) for k, f in enumerate(forms)], "k int, f string").orderBy("k").select(documents.normal_documents(F.col("f")).alias("d")).collect()]
    assert got[:6] == [[]] * 6
    assert got[6] == [(1, "http://a.ru", "a.ru", ""), (2, "http://www.b.ru/x", "b.ru", "")] and [x[1] for x in got[7]] == ["http://a.ru", "http://c.ru"]
    assert got[8] == [(1, "http://a.ru", "a.ru", "")] and got[9] == [(1, "http://a.ru", "a.ru", "t"), (9, "u.ru", "u.ru", "")]


def test_adjacency_of_more_nodes_than_columns(spark, tmp_path):
    """6,000 suppliers, each linked with one of 97 parts: more nodes than a table can be wide."""
    rows = spark.range(6000).selectExpr("id + 1000 as l_suppkey", "id as l_partkey")
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    got = plans.QUERIES["k16_adjacency"](spark, str(tmp_path)).collect()
    want = {(k + 1000, k % 97 + 1) for k in range(6000)}
    assert {(r.node, r.other, r.links) for r in got} == {(a, b, 1) for a, b in want} | {(b, a, 1) for a, b in want} and len(got) == 12000


def test_a_lone_url_is_a_list_of_one(spark):
    forms = spark.createDataFrame([(0, " https://www.A.ru/x?y=1 "), (1, "just words"), (2, "a.ru")], "k int, f string")
    got = [[(d.position, d.url, d.domain) for d in r.d] for r in forms.orderBy("k").select(documents.normal_documents(F.col("f")).alias("d")).collect()]
    assert got == [[(1, "https://www.A.ru/x?y=1", "a.ru")], [], []]


def test_covered_phrases_go_and_chains_stay(spark):
    """A phrase that a removed one covers stays, as does one more than twice as frequent."""
    rows = [(1, "a b c d", 5, "t"), (1, "a b c", 30, "t"), (1, "b c d", 10, "s"), (1, "a b", 60, "t"), (1, "c d", 21, "t"), (1, "c d", 1, "s"), (2, "a b", 1, "t"), (1, " ", 9, "t"), (1, None, 9, "t")]
    got = documents.aggregate_phrases(spark.createDataFrame(rows, "cluster int, phrase string, frequency long, source string")).collect()
    want = {(1, "a b c d", 5), (1, "a b c", 30), (1, "c d", 22), (2, "a b", 1)}
    assert {(r.cluster, r.phrase, r.frequency) for r in got} == want
    assert {r.phrase: r["rank"] for r in got if r.cluster == 1} == {"a b c d": 1, "a b c": 2, "c d": 3}
    assert documents.aggregate_phrases(spark.createDataFrame([], "cluster int, phrase string, frequency long, source string")).count() == 0


def test_breadcrumbs_of_pages(spark):
    item = {"@type": "BreadcrumbList", "itemListElement": [{"position": 2, "name": "Pipes"}, {"position": 1, "item": {"name": "Home page"}}]}
    pages = [f'<script type="application/ld+json">{json.dumps(item)}</script>', '<ol itemtype="https://schema.org/BreadcrumbList"><span itemprop="name">Shop</span><span itemprop="name">Doors</span></ol>', '<ul class="my-breadcrumbs"><li><a href="/">Shop</a><a>&gt;</a><span>Oak</span></ul>', '<nav aria-label="Breadcrumb"><a>Shop</a><a>Ash</a></nav>', "<p>none</p>", None]
    got = [r.c for r in spark.createDataFrame(list(enumerate(pages)), "k int, h string").orderBy("k").select(documents.crumbs_of_html(F.col("h")).alias("c")).collect()]
    assert got == [["Home page", "Pipes"], ["Shop", "Doors"], ["Shop", "Oak"], ["Shop", "Ash"], None, None]


def test_groups_and_dictionaries(spark, tmp_path):
    (tmp_path / "скуд.csv").write_text("﻿Запрос;Частота\nдомофон;1 200\n", encoding="utf-8")
    (tmp_path / "old.csv").write_bytes("Запрос,Частота\nдверь,5\n".encode("cp1251"))
    for name in ("old_backup.csv", "~tmp.csv", ".hid.csv", "x.txt"):
        (tmp_path / name).write_text("a,b\n1,2\n")
    found = groups.discover_groups(spark, str(tmp_path))
    assert set(found) == {"скуд", "old"}
    assert groups.find_group(found, "OLD") == found["old"] and groups.find_group(found, "OLD", fuzzy=False) is None and groups.find_group(found, "nope") is None
    assert groups.find_group({"сор": "p"}, "cop") == "p"
    assert groups.load_queries(spark, found, "old").collect()[0].asDict() == {"Запрос": "дверь", "Частота": "5", "query_group": "old"}
    assert groups.read_csv_trying(spark, found["скуд"]).columns == ["Запрос", "Частота"]
    assert groups.read_csv_trying(spark, str(tmp_path / "absent.csv")).count() == 0
    (tmp_path / "Moscow.txt").write_text("﻿Москва\n\nмск\n", encoding="utf-8")
    assert {tuple(r) for r in groups.load_dictionaries(spark, str(tmp_path), groups.GEO_FILES).collect()} == {("Moscow", "москва"), ("Moscow", "мск")}
    (tmp_path / "a.xml").write_text('<aliases><alias short="спб" full="Санкт-Петербург"/><alias short="" full="x"/></aliases>', encoding="utf-8")
    assert [tuple(r) for r in groups.load_city_aliases(spark, str(tmp_path / "a.xml")).collect()] == [("спб", "Санкт-Петербург")]
    (tmp_path / "d.txt").write_text("# all\nhttps://www.A.ru (12)\nb.ru # note\n\n")
    assert {r.domain for r in groups.load_domains(spark, str(tmp_path / "d.txt")).collect()} == {"a.ru", "b.ru"}


def test_clusters_keep_places_apart_and_mark_queries_without_results(spark):
    serp = spark.createDataFrame([(q, u) for q in (1, 2, 3, 4) for u in range(10)], "q long, u long")
    places = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "a")], "q long, geo string")
    assert {r.q: r.cluster for r in cluster.iterative_clusters(serp, places=places).collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: -1}


def test_one_giant_cluster_is_split_and_singles_follow_in_order(spark):
    """A chain in one cluster; and single queries that only fit after lesser ones were placed."""
    serp = spark.createDataFrame([(q, u) for q in range(1, 31) for u in range(10 * (q // 5), 10 * (q // 5) + 6)] + [(q, 1000 + k) for q in range(1, 31) for k in range(3)], "q long, u long")
    out = {r.q: r.cluster for r in refine.split_clusters(serp, spark.createDataFrame([(q, 1) for q in range(1, 31)], "q long, cluster long"), cap=5).collect()}
    assert out == {q: max(1, 5 * (q // 5)) for q in range(1, 31)}
    links = {10: [0, 1, 2], 11: [0, 1, 2], 12: [0, 1, 2, 50, 51, 52], 13: [50, 51, 52, 70, 71, 72], 14: [70, 71, 72], 15: [90, 91, 92], 16: [90, 91, 92], 17: [99]}
    serp = spark.createDataFrame([(q, u) for q, us in links.items() for u in us], "q long, u long")
    members = spark.createDataFrame([(10, 1), (11, 1)] + [(q, q) for q in range(12, 18)], "q long, cluster long")
    back = lambda **kw: {r.q: r.cluster for r in refine.reattach_singletons(serp, members, base=3, **kw).collect()}
    assert back() == {10: 10, 11: 10, 12: 10, 13: 10, 14: 10, 15: 15, 16: 15, 17: 17}
    assert back(cap=3) == {10: 10, 11: 10, 12: 10, 13: 13, 14: 13, 15: 15, 16: 15, 17: 17}


def test_majority_and_lemmas(spark):
    members = spark.createDataFrame([(1, 1, "a"), (2, 1, "a"), (3, 1, None), (4, 2, "b")], "q long, cluster long, geo string")
    assert {r.q for r in lists.majority_apart(members).collect()} == {3}
    lemmas = spark.createDataFrame([("трубы", "труба")], "form string, lemma string")
    got = lists.lemmatised(spark.createDataFrame([(1, "Трубы в трубы дом"), (2, None), (3, "")], "row_id long, keyword string"), lemmas).collect()
    assert {(r.row_id, r.lemmas, r.normalized) for r in got} == {(1, "труба труба дом", "дом труба труба"), (2, "", ""), (3, "", "")}
