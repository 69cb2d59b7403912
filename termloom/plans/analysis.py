"""Queries of similarity, clustering, place, brand and hierarchy operators, and SQL written apart from them where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.operators import brands, cluster, communities, factors, fulllink, fuzzy, hierarchy, linkage, places, topics, vectors, wordmatch

from .dialect import bind, spell
from .roles import ROLES, TABLES, role, used
from .rules import PHRASES

#: Keywords of several words, some with capitals, models and numbers.
NAMED = "SELECT p_partkey AS row_id, concat(p_name, ' ', p_brand, ' ', CASE WHEN p_size % 2 = 0 THEN p_type ELSE lower(p_type) END) AS keyword, p_size % 13 * 1e0 AS w, CAST(p_size % 7 AS DOUBLE) AS frequency_exact FROM part"
#: Queries with a place in one of its spellings, two of them, or none.
PLACED = """SELECT c_custkey AS q, CASE c_custkey % 6 WHEN 0 THEN concat('pumps in ', n_name) WHEN 1 THEN concat(lower(n_name), ', ', r_name, ' shop') WHEN 2 THEN concat('buy near ', substr(n_name, 1, 3), substr(n_name, 7))
  WHEN 3 THEN concat('best ', r_name) WHEN 4 THEN 'pumps of a nation' END AS keyword FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey"""
#: Keywords in Cyrillic and Latin letters, every other one with a capital first.
SPELLED = f"SELECT row_id, CASE WHEN row_id % 2 = 0 THEN concat(upper(substr(keyword, 1, 1)), substr(keyword, 2)) ELSE keyword END AS keyword FROM ({PHRASES}) p"


def frame(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A statement of both dialects on roles and tables."""
    frames = {r: role(spark, sf_dir, r) for r in used(text, ROLES)} | {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used(text, TABLES)}
    return spark.sql(bind(spell(text, spark=True), list(frames)), **frames)


def _embeddings(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet")


def _words(spark, *words):
    return spark.createDataFrame([(w,) for w in words], "word string")


def j11_cosine_pairs(spark, d):
    return vectors.cosine_pairs(_embeddings(spark, d), 0.5).select("a", "b", F.round("cosine", 6).alias("cosine"))


def l16_similarity_graph(spark, d):
    return vectors.similarity_graph(_embeddings(spark, d), similarity_threshold=0.3).withColumn("weight", F.round("weight", 6))


def j12_fuzzy_merge(spark, d):
    return fuzzy.merge_similar(frame(spark, d, NAMED), 0.9)


def l3_full_link(spark, d):
    serp = role(spark, d, "serp")
    return fulllink.full_link_clusters(cluster.shared_url_pairs(serp, 4), serp.groupBy("q").agg(F.sum("u").cast("double").alias("weight")))


def l8_word_match(spark, d):
    return wordmatch.word_match_clusters(frame(spark, d, NAMED))


def l9_word_match_details(spark, d):
    return wordmatch.cluster_details(frame(spark, d, NAMED), l8_word_match(spark, d))


def l17_louvain(spark, d):
    return communities.louvain(vectors.similarity_graph(_embeddings(spark, d), similarity_threshold=0.3))


def l19_community_facts(spark, d):
    edges = role(spark, d, "edges")
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    return communities.community_facts(edges, nodes.withColumn("community", F.col("node") % 7)).withColumn("density", F.round("density", 6))


def l14_nmf_topics(spark, d):
    cells = topics.tf_idf(role(spark, d, "kw").select(F.col("row_id").alias("id"), F.col("keyword").alias("text")))
    cells = cells.select("id", F.explode(F.arrays_zip("terms", "weights")).alias("t")).select("id", F.col("t.terms").alias("term"), F.col("t.weights").alias("value"))
    rows, terms = factors.factorise(cells, topics=5, rounds=10)
    named = factors.topic_assignments(rows).join(factors.topic_names(terms), "topic", "left")
    return named.select(F.col("id").alias("row_id"), "topic", "name", F.round("share", 4).alias("share"))


def l15_linkage_levels(spark, d):
    rows = _embeddings(spark, d)
    edges = vectors.similarity_graph(rows, similarity_threshold=0.3).select("src", "dst", (1 - F.col("weight")).alias("distance"))
    return linkage.multilevel(linkage.spanning_forest(edges), rows.select(F.col("vec_id").alias("node")))


def _places(spark, d):
    nations, regions = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("nation", "region"))
    cities = nations.select(F.col("n_name").alias("city"), F.lit(1).alias("priority")).unionByName(regions.select(F.col("r_name").alias("city"), F.lit(2).alias("priority")))
    # Short names: two nations may share one.
    aliases = nations.select(F.concat(F.substring("n_name", 1, 3), F.substring("n_name", 7, 9)).alias("short"), F.col("n_name").alias("full"))
    return places.resolve_places(frame(spark, d, PLACED), places.place_forms(cities, aliases=aliases), key="q")


def c21_places_of_queries(spark, d):
    return _places(spark, d)


def l1_clusters_by_place(spark, d):
    return cluster.iterative_clusters(role(spark, d, "serp"), low=3, high=10, places=_places(spark, d).select("q", F.col("place").alias("geo")))


def _brand_words(spark, d):
    forms = spark.createDataFrame([("hot", "hot", True), ("cold", "cold", False)], "form string, lemma string, name boolean")
    return brands.brand_words(frame(spark, d, NAMED), _words(spark, "bolt", "gear"), _words(spark, "small", "large", "promo"), forms)


def c14_brand_tokens(spark, d):
    return _brand_words(spark, d)


def c15_query_brands(spark, d):
    return brands.query_brands(frame(spark, d, NAMED).select("row_id"), _brand_words(spark, d))


def c17_learned_brands(spark, d):
    return brands.learn_brands(frame(spark, d, SPELLED), _words(spark, "труба", "купить"), topic_share=0.3)


def _trees(spark, d):
    """A tree for each region: its nations, their market segments, and in those their customers."""
    region, nation, customer = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("region", "nation", "customer"))
    item = lambda level, kind, name, slug, children: F.struct(F.lit(level).alias("level"), F.lit(kind).alias("type"), F.col(name).alias("name"), slug.alias("slug"), F.array(F.col(name)).alias("clusters"), children.alias("children"))
    none = F.array().cast("array<string>")
    leaves = customer.groupBy("c_nationkey", "c_mktsegment").agg(F.sort_array(F.collect_list(F.struct("c_custkey", item(4, "page", "c_name", F.col("c_custkey").cast("string"), none).alias("i")))).alias("x"))
    parts = leaves.groupBy("c_nationkey").agg(F.sort_array(F.collect_list(F.struct("c_mktsegment", item(3, "subcategory", "c_mktsegment", F.lower("c_mktsegment"), F.transform("x", lambda y: y.i)).alias("i")))).alias("x"))
    nations = nation.join(parts, F.col("n_nationkey") == F.col("c_nationkey")).select("n_regionkey", F.struct("n_nationkey", item(2, "subcategory", "n_name", F.lower("n_name"), F.transform("x", lambda y: y.i)).alias("i")).alias("n"))
    tops = region.join(nations.groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n")).alias("x")), F.col("r_regionkey") == F.col("n_regionkey"))
    tree = F.array(item(1, "category", "r_name", F.lower("r_name"), F.transform("x", lambda y: y.i)))
    advice = F.when(F.col("r_regionkey") % 2 == 0, F.array(F.concat(F.lit("merge "), "r_name"), F.lit("add pages")))
    return tops.select(F.col("r_regionkey").cast("long").alias("cluster_id"), F.to_json(F.struct(tree.alias("hierarchy"), advice.alias("recommendations"), F.when(F.col("r_regionkey") > 1, F.col("r_name")).alias("seo_notes"))).alias("hierarchy"), F.lower("r_name").alias("context"))


def g6_hierarchy_rows(spark, d):
    return hierarchy.flatten_hierarchy(_trees(spark, d)).select("cluster_id", F.array_join(F.col("place").cast("array<string>"), ".").alias("place"), "depth", "level", "type", "name", "slug", "path")


def z17_hierarchy_report(spark, d):
    return hierarchy.hierarchy_report(_trees(spark, d)).select("cluster_id", "context", "part", F.array_join(F.col("place").cast("array<string>"), ".").alias("place"), "level", "name", "slug", "path")


QUERIES = {n: f for n, f in list(globals().items()) if callable(f) and n[0] in "cgjlz" and n[1:2].isdigit()}

SQL: dict[str, str] = {}
_COSINE = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
SQL["j11_cosine_pairs"] = f"SELECT a.vec_id AS a, b.vec_id AS b, round({_COSINE}, 6) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {_COSINE} >= 0.5"
SQL["l16_similarity_graph"] = f"SELECT a.vec_id AS src, b.vec_id AS dst, round({_COSINE}, 6) AS weight FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {_COSINE} >= 0.3"
SQL["l19_community_facts"] = """WITH ends AS (SELECT src AS node, dst AS other FROM edges UNION ALL SELECT dst, src FROM edges),
  k AS (SELECT node, node % 7 AS c, count(*) AS k, count(*) FILTER (WHERE other % 7 = node % 7) AS i FROM ends GROUP BY node),
  s AS (SELECT c AS community, count(*) AS size, CAST(sum(k) AS DOUBLE) AS degree, sum(i) / 2e0 AS inside, max_by(node, k * 1000000 - node) AS hub FROM k GROUP BY c)
  SELECT community, size, inside, degree, round(CASE WHEN size > 1 THEN 2 * inside / (size * (size - 1)) ELSE 0 END, 6) AS density, hub FROM s"""
SQL["c21_places_of_queries"] = rf"""WITH queries AS ({PLACED}),
  forms AS (SELECT lower(n_name) AS form, lower(n_name) AS base, 1 AS p FROM nation UNION ALL SELECT lower(r_name), lower(r_name), 2 FROM region UNION ALL SELECT lower(concat(substr(n_name, 1, 3), substr(n_name, 7))), lower(n_name), 1 FROM nation),
  spelled AS (SELECT q, concat(' ', array_to_string(regexp_extract_all(lower(keyword), '[\p{{L}}\p{{N}}_]+'), ' '), ' ') AS t FROM queries),
  asked AS (SELECT form, min(p) AS p, min(base) AS base FROM forms GROUP BY form),
  hits AS (SELECT q, base, p, strpos(t, concat(' ', form, ' ')) AS pos, length(form) AS n FROM spelled JOIN asked ON contains(t, concat(' ', form, ' '))),
  best AS (SELECT q, base, row_number() OVER (PARTITION BY q ORDER BY p, pos, n DESC) AS r FROM hits)
  SELECT q.q, b.base AS place FROM queries q LEFT JOIN best b ON b.q = q.q AND b.r = 1"""
_WORDS = f"""WITH named AS ({NAMED}), w AS (SELECT row_id, unnest(string_split(keyword, ' ')) AS word, generate_subscripts(string_split(keyword, ' '), 1) - 1 AS i FROM named),
  r AS (SELECT row_id, CAST(i AS INTEGER) AS "at", word, CASE WHEN length(word) < 2 OR lower(word) IN ('bolt', 'gear', 'small', 'large', 'promo') THEN NULL
    WHEN regexp_full_match(word, '[A-Z][a-zA-Z0-9-]+') THEN 'latin_capitalized' WHEN regexp_full_match(word, '[a-z]+[a-z0-9-]*') AND length(word) >= 4 THEN 'latin_lowercase'
    WHEN regexp_matches(word, '^[A-Z][a-z]+[A-Z]|^i[A-Z][a-z]+') THEN 'camel_case' WHEN word = 'hot' THEN 'morph_name' WHEN regexp_matches(word, '^[A-Z][a-zA-Z]*[0-9-]+') THEN 'model_number' END AS reason FROM w),
  b AS (SELECT row_id, "at", word, reason, CASE reason WHEN 'latin_capitalized' THEN 0.9e0 WHEN 'camel_case' THEN 0.85e0 WHEN 'morph_name' THEN 0.7e0 ELSE 0.75e0 END AS confidence FROM r WHERE reason IS NOT NULL)"""
SQL["c14_brand_tokens"] = f"{_WORDS} SELECT * FROM b"
SQL["c15_query_brands"] = f"{_WORDS} SELECT n.row_id, min_by(word, \"at\") AS brand, coalesce(max(confidence), 0) AS confidence, count(word) AS n, coalesce(max(confidence), 0) >= 0.7 AS is_brand_query FROM named n LEFT JOIN b ON b.row_id = n.row_id GROUP BY n.row_id"
SQL["c17_learned_brands"] = f"""WITH spelled AS ({SPELLED}), w AS (SELECT list_filter(string_split_regex(trim(keyword), '\\s+'), lambda x: x <> '') AS w FROM spelled),
  e AS (SELECT w, unnest(w) AS form, generate_subscripts(w, 1) AS i FROM w),
  t AS (SELECT lower(form) AS word, form, CASE WHEN i > 1 THEN lower(w[i - 1]) END AS before, lower(w[i + 1]) AS after FROM e WHERE length(form) > 2),
  f AS (SELECT word, form, count(*) AS k FROM t GROUP BY word, form),
  c AS (SELECT word, sum(k) AS n, count(*) AS spellings, coalesce(sum(k) FILTER (WHERE upper(form[1]) = form[1] AND lower(form[1]) <> form[1]), 0) AS capitals, first(form ORDER BY k DESC, encode(form)) AS brand FROM f GROUP BY word),
  x AS (SELECT word, count(DISTINCT o) AS contexts FROM (SELECT word, before AS o FROM t UNION ALL SELECT word, after FROM t) y GROUP BY word),
  m AS (SELECT c.*, contexts, length(c.word) - length(translate(c.word, 'аеёиоуыэюя', '')) AS vowels, c.word IN ('труба', 'купить') AS plain FROM c JOIN x USING (word) WHERE n < 0.3 * (SELECT count(*) FROM spelled)),
  r AS (SELECT word, brand, CAST(n AS BIGINT) AS n, CASE WHEN regexp_full_match(word, '[a-z0-9-]+') THEN CASE WHEN NOT regexp_full_match(word, '[0-9]+') THEN 'latin' END
    WHEN length(word) <= 5 AND vowels <= 1 AND n >= 3 THEN CASE WHEN NOT plain AND spellings <= 3 AND n >= 5 THEN 'acronym' END
    WHEN contexts >= 3 AND n >= 5 AND capitals > 0 AND spellings <= 4 AND NOT plain THEN 'contexts' END AS rule FROM m)
  SELECT word, brand, rule, n FROM r WHERE rule IS NOT NULL"""
_TREE = """WITH s AS (SELECT c_nationkey, c_mktsegment, c_custkey, c_name, dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) - 1 AS si, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) - 1 AS ci FROM customer),
  n AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS ni FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer)),
  r AS (SELECT * FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM n)),
  tree AS (
    SELECT r_regionkey AS k, '0' AS place, 1 AS level, 'category' AS type, r_name AS name, lower(r_name) AS slug, r_name AS path FROM r
    UNION ALL SELECT r_regionkey, concat('0.', ni), 2, 'subcategory', n_name, lower(n_name), concat(r_name, ' > ', n_name) FROM r JOIN n ON n_regionkey = r_regionkey
    UNION ALL SELECT DISTINCT r_regionkey, concat('0.', ni, '.', si), 3, 'subcategory', c_mktsegment, lower(c_mktsegment), concat(r_name, ' > ', n_name, ' > ', c_mktsegment) FROM r JOIN n ON n_regionkey = r_regionkey JOIN s ON c_nationkey = n_nationkey
    UNION ALL SELECT r_regionkey, concat('0.', ni, '.', si, '.', ci), 4, 'page', c_name, CAST(c_custkey AS VARCHAR), concat(r_name, ' > ', n_name, ' > ', c_mktsegment, ' > ', c_name) FROM r JOIN n ON n_regionkey = r_regionkey JOIN s ON c_nationkey = n_nationkey)"""
SQL["g6_hierarchy_rows"] = f"{_TREE} SELECT CAST(k AS BIGINT) AS cluster_id, place, CAST(level AS INTEGER) AS depth, CAST(level AS INTEGER) AS level, type, name, slug, path FROM tree"
SQL["z17_hierarchy_report"] = f"""{_TREE}, x AS (SELECT k, 0 AS part, place, level, name, slug, path FROM tree
    UNION ALL SELECT r_regionkey, 1, '', NULL, 'РЕКОМЕНДАЦИИ', '', concat('merge ', r_name, chr(10), 'add pages') FROM r WHERE r_regionkey % 2 = 0
    UNION ALL SELECT r_regionkey, 2, '', NULL, 'SEO ЗАМЕТКИ', '', r_name FROM r WHERE r_regionkey > 1)
  SELECT CAST(k AS BIGINT) AS cluster_id, lower(r_name) AS context, CAST(part AS INTEGER) AS part, place, CAST(level AS INTEGER) AS level, name, slug, path FROM x JOIN r ON r_regionkey = k"""


def oracle_sql() -> dict[str, str]:
    """The SQL with the roles that it reads in front."""
    from .dialect import with_roles

    return {name: with_roles(text, {n: spell(ROLES[n], spark=False) for n in used(text, ROLES)}).replace(" AS STRING)", " AS VARCHAR)") for name, text in SQL.items()}
