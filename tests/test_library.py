import re

import duckdb
import pytest

import __spark_entry__
from termloom.functions.metrics import calculate_all_metrics
from termloom.operators import cluster, graph, phrases, refine, topics
from termloom.plans import catalogue, statements
from termloom.plans.dialect import bind, spell, with_roles
from termloom.sources import tables
from termloom.streaming import status

SF = "/root/testdata/sf0.001"
SAMPLE = ["flagship", "w2_implicit_dedup", "j7_shared_url_pairs", "a15_cluster_ads", "x8_normalize_url", "m17_priority_score", "c2_main_intent", "l4_soft_clusters"]


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(statements.STATEMENTS) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_statement_equals_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("part", "lineitem", "orders", "events", "documents", "pages"):
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    mine = catalogue.queries()[name](spark, SF)
    cols = sorted(mine.columns)
    theirs = con.sql(catalogue.oracle_sql()[name]).df()
    rows = lambda df: sorted(map(str, df[cols].itertuples(index=False, name=None)))
    assert rows(mine.toPandas()) == rows(theirs)


def test_dialect():
    assert spell("LIST_FILTER(x, FN v: v > 1)[FIRST]", True) == "filter(x, v -> v > 1)[0]"
    assert spell("LIST_FILTER(x, FN v: v > 1)[FIRST]", False) == "list_filter(x, lambda v: v > 1)[1]"
    assert bind("SELECT '{2}' FROM kw", ["kw"]) == "SELECT '{{2}}' FROM {kw}"
    assert with_roles("WITH a AS (SELECT 1) SELECT * FROM a", {"kw": "SELECT 2"}) == "WITH kw AS (SELECT 2), a AS (SELECT 1) SELECT * FROM a"


def test_components_pagerank_and_empty(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 9), (9, 8)], "src long, dst long")
    assert {(r.node, r.component) for r in graph.components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7), (9, 7)}
    assert graph.components(edges.limit(0)).count() == 0
    assert abs(sum(r["rank"] for r in graph.pagerank(edges).collect()) - 1) < 1e-6


def test_iterative_clusters_partition_queries(spark):
    rows = [(q, u) for q, us in {1: range(10), 2: range(9), 3: range(8), 4: range(20, 30), 5: [99]}.items() for u in us]
    out = {r.q: r.cluster for r in cluster.iterative_clusters(spark.createDataFrame(rows, "q long, u long")).collect()}
    # 1 and 2 share nine URLs and are placed a round before 3 could be, which shares eight with each: their cluster is shut.
    assert out == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_iterative_clusters_within_one_round(spark):
    rows = [(q, u) for q, us in {1: range(8), 2: range(8), 3: [*range(8), 50], 11: range(100, 104), 12: range(100, 104), 13: [100, 101, 102, 110]}.items() for u in us]
    out = {r.q: r.cluster for r in cluster.iterative_clusters(spark.createDataFrame(rows, "q long, u long"), low=2, high=8).collect()}
    assert out == {1: 1, 2: 1, 3: 1, 11: 11, 12: 11, 13: 13}
    weak = [r for r in rows if r[0] > 3]
    out = {r.q: r.cluster for r in cluster.iterative_clusters(spark.createDataFrame(weak, "q long, u long"), low=2, high=2).collect()}
    assert out == {11: 11, 12: 11, 13: 13}  # 11 and 12 share twice the threshold, 13 only three URLs with either


def test_split_and_reattach(spark):
    serp = spark.createDataFrame([(q, u) for q, us in {1: range(9), 2: range(9), 3: [0, 1, 2, *range(20, 26)], 4: range(20, 26), 5: [0, 1, 2, 90]}.items() for u in us], "q long, u long")
    one = spark.createDataFrame([(q, 7) for q in range(1, 5)] + [(5, 9)], "q long, cluster long")
    split = lambda **kw: {r.q: r.cluster for r in refine.split_clusters(serp, one, **kw).collect()}
    assert split(cap=2, base=3, step=1, most=6) == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}
    assert split(cap=1, base=3, step=1, most=3) == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5}
    assert split(cap=4) == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5}
    back = {r.q: r.cluster for r in refine.reattach_singletons(serp, spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3), (5, 5)], "q long, cluster long"), base=3).collect()}
    assert back == {1: 1, 2: 1, 3: 3, 4: 3, 5: 1}
    geo = spark.createDataFrame([(1, 1, "x"), (2, 1, "x"), (3, 3, None), (4, 3, None), (5, 5, None)], "q long, cluster long, geo string")
    assert {r.q: r.cluster for r in refine.reattach_singletons(serp, geo, base=3).collect()}[5] == 3


def test_label_propagation(spark):
    edges = spark.createDataFrame([(a, b) for g in ((1, 2, 3, 4), (11, 12, 13, 14)) for a in g for b in g if a < b] + [(4, 11)], "src long, dst long")
    out = {r.node: r.community for r in graph.label_propagation(edges).collect()}
    assert len({out[k] for k in (1, 2, 3, 4)}) == 1 and len({out[k] for k in (11, 12, 13, 14)}) == 1 and out[1] != out[14]


def test_topics(spark):
    rows = [(k, "red steel pipe welded") for k in range(6)] + [(k + 10, "green garden hose long") for k in range(6)] + [(99, None)]
    weighed = topics.tf_idf(spark.createDataFrame(rows, "id long, text string"), least_docs=2, most_share=0.8)
    out = {r.id: r.cluster for r in topics.k_means(weighed, k=2).collect()}
    assert len({out[k] for k in range(6)}) == 1 and len({out[k + 10] for k in range(6)}) == 1 and out[0] != out[10]
    dense = {r.id: r.cluster for r in topics.density_clusters(weighed, eps=0.3, least=3).collect()}
    assert {dense[k] for k in range(6)} == {0} and {dense[k + 10] for k in range(6)} == {10} and dense[99] is None
    terms = {r.term for r in topics.top_terms(weighed, spark.createDataFrame(list(out.items()), "id long, cluster long"), k=30).collect() if r.cluster == out[0]}
    assert "steel" in terms and "hose" not in terms


def test_status_stream(spark, tmp_path):
    rows = [(1, "done", "2024-01-01 10:05:00"), (1, "done", "2024-01-01 10:05:00"), (2, "done", "2024-01-01 10:50:00"), (3, "error", "2024-01-01 11:10:00"), (4, "error", "2024-01-03 00:00:00")]
    frame = spark.createDataFrame(rows, "event_id long, status string, at string").selectExpr("event_id", "status", "cast(at as timestamp) as updated_at")
    frame.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    query = status.hourly_counts(status.without_repeats(stream)).writeStream.format("memory").queryName("counted").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(90)
    assert {(str(r.hour), r.status, r.n) for r in spark.table("counted").collect()} >= {("2024-01-01 10:00:00", "done", 2), ("2024-01-01 11:00:00", "error", 1)}


def test_phrases_and_metrics_of_constant_columns(spark):
    texts = spark.createDataFrame([(1, "red steel pipe and red steel pipe"), (2, None), (3, "a")], "id long, text string")
    assert ("red steel", 2) in {(r.phrase, r.frequency) for r in phrases.lsi_phrases(texts).collect()}
    kw = spark.createDataFrame([(1, 10.0, 5.0), (2, 10.0, 5.0)], "row_id long, w double, e double")
    assert {round(r.priority_score, 6) for r in calculate_all_metrics(kw).collect()} == {0.3 * 50 + 12.5 + 12.5 + 10}


def test_read_keywords(spark, tmp_path):
    (tmp_path / "k.csv").write_text("Запрос;Частота\nскуд купить;1 200\nдомофон;x\n", encoding="utf-8")
    rows = tables.read_keywords(spark, str(tmp_path / "k.csv")).collect()
    assert [(r.keyword, r.frequency_world, r.frequency_exact) for r in rows] == [("скуд купить", 1200, 0), ("домофон", 0, 0)]


def test_clean_text_reads_whole_texts(spark):
    """Against Python's re, whose white space also has the separators beyond ASCII."""
    from termloom.plans.roles import role

    odd = [(-1, "a" * 500 + " tail!"), (-2, "a\u00a0\u2003b\x1c\x0b\x85c"), (-3, " \u3000"), (-4, "ё_x-y, 5½ e\u0301 \U0001d4b3"), (-5, "")]
    texts = role(spark, SF, "texts").select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    got = {r.doc_id: r.cleaned for r in catalogue.apply(spark, "x1_clean_text", texts=texts).collect()}
    assert got == {r.doc_id: re.sub(r"[^\w\s\-]", " ", re.sub(r"\s+", " ", r.text)).strip() for r in texts.collect()}


def test_overlaps_of_all_queries(spark):
    """Ids far above 60 count, and every pair that isn't returned has nothing in common."""
    lists = {q: {(q * k) % 23 for k in range(q % 5)} | {q % 2 + 100} for q in (1, 2, 7, 60, 61, 75, 400, 9000)} | {9001: {555}}
    serp = spark.createDataFrame([(q, u) for q, us in lists.items() for u in us] + [(1, 101)], "q long, u long")
    common = {(a, b): len(lists[a] & lists[b]) for a in lists for b in lists if a < b and lists[a] & lists[b]}
    assert any(a > 60 for a, _ in common)
    assert {(r.q1, r.q2): r.common for r in catalogue.apply(spark, "u1_common_urls", serp=serp).collect()} == common
    assert {(r.q1, r.q2): r.jaccard for r in catalogue.apply(spark, "u2_jaccard", serp=serp).collect()} == {(a, b): pytest.approx(n / len(lists[a] | lists[b]), abs=1e-6) for (a, b), n in common.items()}


def test_geo_classes_of_all_keywords(spark):
    rows = [(1, 5, "x"), (2, 5, None), (401, 5, "x"), (402, 5, None), (403, 6, "x"), (404, 5, "y"), (9000, 6, "x"), (9001, None, "x"), (9002, None, "x")]
    place = {r.row_id: r["class"] for r in catalogue.apply(spark, "c22_geo_compatible", kw=spark.createDataFrame(rows, "row_id long, cluster_id long, geo string")).collect()}
    pairs = {(a, b) for a, c, g in rows for b, d, h in rows if a < b and c is not None and c == d and g == h}
    assert {(a, b) for a in place for b in place if a < b and place[a] == place[b]} == pairs
    assert set(place) == {r[0] for r in rows if r[1] is not None}


def test_edges_of_all_orders(spark):
    from termloom.plans.roles import role

    lines = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_suppkey", "l_partkey").collect()
    ends = [(r.l_suppkey, r.l_partkey % 97 + 1) for r in lines]
    assert {tuple(r) for r in role(spark, SF, "edges").collect()} == {(min(e), max(e)) for e in ends if e[0] != e[1]}


def cluster_links():
    """Queries' words and URLs, with the clusters' links by three URLs and, of other pairs, by two words."""
    words = {1: "red steel pipe", 4: "red steel", 9: "blue steel red green", 16: "blue large", 25: "blue red pipe", 36: "green large", 49: "steel blue"}
    urls = {1: {1, 2, 3}, 2: {4, 14}, 4: {1, 2, 14}, 9: {8, 16, 24}, 10: {1, 2}, 16: {8, 16}, 25: {24, 16, 8}, 36: {8}}
    cu, cw = {}, {}
    for q, us in urls.items():
        cu.setdefault(int(q**0.5), set()).update(us)
    for q, text in words.items():
        cw.setdefault(int(q**0.5), set()).update(set(text.split()) - {"green", "large"})
    pairs = [(a, b) for a in range(1, 8) for b in range(a + 1, 8)]
    by_url = {(a, b): n for a, b in pairs if (n := len(cu.get(a, set()) & cu.get(b, set()))) >= 3}
    by_word = {(a, b): n for a, b in pairs if (a, b) not in by_url and (n := len(cw[a] & cw[b])) >= 2}
    assert by_url and by_word and any(len(cw[a] & cw[b]) >= 2 for a, b in by_url)
    return words, [(q, u) for q, us in urls.items() for u in us], by_url, by_word


def test_cluster_links_equal_brute_force(spark):
    words, serp, by_url, by_word = cluster_links()
    frames = {"kw": spark.createDataFrame(list(words.items()), "row_id long, keyword string"), "serp": spark.createDataFrame(serp, "q long, u long")}
    assert {(r.c1, r.c2): r.strength for r in catalogue.apply(spark, "j9_cluster_url_links", **frames).collect()} == by_url
    assert {(r.c1, r.c2): r.words for r in catalogue.apply(spark, "j10_cluster_word_links_anti", **frames).collect()} == by_word


def test_related_clusters_have_word_links(spark):
    words, serp, by_url, by_word = cluster_links()
    frames = {"kw": spark.createDataFrame(list(words.items()), "row_id long, keyword string"), "serp": spark.createDataFrame(serp, "q long, u long")}
    links = [(-n, kind, *p) for kind, found in enumerate((by_url, by_word)) for (a, b), n in found.items() for p in ((a, b), (b, a))]
    best = {(c, x[3], -x[0]) for c in range(1, 8) for x in sorted(x for x in links if x[2] == c)[:5]}
    assert {tuple(r) for r in catalogue.apply(spark, "c27_related_clusters", **frames).collect()} == best
    assert any((min(a, b), max(a, b)) in by_word for a, b, _ in best)
