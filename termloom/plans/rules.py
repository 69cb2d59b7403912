"""Queries of the operators that are functions with parameters, and their SQL, written apart from the functions.

Their keywords are those of the role kw with words of the rules put in, and frequencies on both sides of every limit.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from termloom.functions import rules
from termloom.operators import documents, graph, lists

from .roles import ROLES, role, used

# What stands for each word of the test table, so that the rules' own words occur.
WORDS = (
    ("anvil", "труба"), ("blue", "что такое"), ("bolt", "насос wilo"), ("cold", "обзор"), ("gear", "виды окон"), ("gizmo", "насос 300"), ("hot", "как"), ("large", "цена"), ("new", "заказать"), ("old", "отзывы"),
    ("plate", "плитка или камень"), ("red", "купить"), ("ring", "кольцо опт"), ("rod", "дешево арматура"), ("small", "срочно"), ("widget", "стоимость двери"),
)
_SWAPPED = "keyword"
for _a, _b in WORDS:
    _SWAPPED = f"replace({_SWAPPED}, '{_a}', '{_b}')"
#: row_id, cluster_id, keyword, w, e, commercial, brand, main_intent
PHRASES = f"""SELECT row_id, cluster_id, group_name, {_SWAPPED} AS keyword, w * (1 + row_id % 23) AS w, w * (row_id % 12) / 10 AS e,
  main_intent LIKE 'commercial%' AS commercial, brand > 0 AS brand, main_intent, m, t, CASE row_id % 3 WHEN 0 THEN 'москва' WHEN 1 THEN 'тверь' END AS geo FROM kw"""
LINKS = "SELECT q, u, position, url, domain, CASE u % 5 WHEN 0 THEN 'commercial' WHEN 1 THEN 'informational' END AS class FROM serp"
COMMERCIAL, INFORMATIONAL, NAVIGATIONAL = ("купить", "заказать", "цена", "опт"), ("что", "как", "обзор", "что такое"), ("сайт", "wilo")


def _frame(spark, sf_dir: str, text: str):
    names = used(text, ROLES)
    for name in names:
        role(spark, sf_dir, name).createOrReplaceTempView(f"termloom_{name}")
    for name in names:
        text = text.replace(f"FROM {name}", f"FROM termloom_{name}")
    return spark.sql(text)


def phrases(spark, d):
    return _frame(spark, d, PHRASES)


def links(spark, d):
    return _frame(spark, d, LINKS)


def _n_words(c):
    return F.size(F.split(c, " +"))


def _scores(c):
    return rules.intent_scores(c, COMMERCIAL, INFORMATIONAL, NAVIGATIONAL)


def m25_difficulty_score(spark, d):
    return phrases(spark, d).select("row_id", F.round(rules.difficulty_score(F.col("w"), F.col("e"), _n_words(F.col("keyword")), F.col("commercial"), F.col("brand")), 6).alias("v"))


def m26_difficulty_level(spark, d):
    return m25_difficulty_score(spark, d).select("row_id", rules.difficulty_level(F.col("v")).alias("level"))


def m27_strategy(spark, d):
    return phrases(spark, d).select("row_id", rules.strategy(F.col("w"), F.col("e"), F.col("commercial")).alias("strategy"))


def o4_opportunities(spark, d):
    scored = phrases(spark, d).join(m25_difficulty_score(spark, d), "row_id").where(rules.strategy(F.col("w"), F.col("e"), F.col("commercial")) == "quick_wins")
    return scored.select("row_id", "w", "v").orderBy(F.desc("w"), "v", "row_id").limit(50)


def c12_funnel_stage(spark, d):
    return phrases(spark, d).select("row_id", rules.funnel_stage(F.col("keyword")).alias("f")).select("row_id", "f.stage", "f.confidence")


def c18_structure_pattern(spark, d):
    return phrases(spark, d).select("row_id", rules.structure_pattern(F.col("keyword")).alias("pattern"))


def c19_structure_flags(spark, d):
    flags = rules.structure_flags(F.col("keyword"), COMMERCIAL, INFORMATIONAL)
    return phrases(spark, d).select("row_id", *[c.alias(n) for n, c in flags.items()])


def c20_modifiers(spark, d):
    return phrases(spark, d).select("row_id", F.explode(rules.modifier_classes(F.col("keyword"))).alias("modifier"))


def c1_intent_scores(spark, d):
    return phrases(spark, d).select("row_id", *[c.alias(n) for n, c in _scores(F.col("keyword")).items()])


def c2_main_intent(spark, d):
    return phrases(spark, d).select("row_id", rules.main_intent(_scores(F.col("keyword")), F.col("geo").isNotNull()).alias("i")).select("row_id", "i.intent", "i.score")


def c3_flags(spark, d):
    return phrases(spark, d).select("row_id", *[rules.contains_any(F.col("keyword"), w).alias(n) for n, w in (("is_commercial", COMMERCIAL), ("is_informational", INFORMATIONAL), ("is_navigational", NAVIGATIONAL))])


def c4_geo_extract(spark, d):
    text = F.concat_ws(" ", "keyword", F.when(F.col("row_id") % 3 == 1, "твери").when(F.col("row_id") % 3 == 2, "мск"))
    got = rules.geo_extract(text, {"твери": "Тверь", "тверь": "Тверь"}, ("мск", "москва"), {"Kazakhstan": ("труба",), "Belarus": ("окон",)}, ("арматура",))
    return phrases(spark, d).select("row_id", got.alias("g")).select("row_id", F.col("g.type").alias("kind"), "g.country", "g.city", "g.location")


def c6_override(spark, d):
    serp = F.when(F.col("m") >= 14, "commercial").when(F.col("m") <= 5, "informational")
    return phrases(spark, d).select("row_id", rules.intent_override(F.col("keyword"), ("купить", "опт"), serp, F.col("main_intent")).alias("intent"))


def c8_recalculated(spark, d):
    serp = F.when(F.col("row_id") % 5 == 0, "commercial").when(F.col("row_id") % 5 == 1, "informational")
    now = F.when(F.col("row_id") % 7 > 0, F.col("main_intent"))
    got = rules.recalculated(now, F.col("t"), 10 - F.col("t"), serp, F.col("m") / 20, 1 - F.col("m") / 20)
    return phrases(spark, d).select("row_id", got.alias("r")).select("row_id", "r.intent", F.round("r.commercial", 6).alias("commercial"), F.round("r.informational", 6).alias("informational"))


def c9_content_intent(spark, d):
    return role(spark, d, "texts").select("doc_id", rules.content_intent(F.col("text"), ("tion", "shop"), ("ing", "heit")).alias("c")).select("doc_id", "c.commercial", "c.informational", "c.intent", F.round("c.confidence", 6).alias("confidence"))


def c11_domain_intent(spark, d):
    rows = links(spark, d)
    classes = rows.groupBy("domain").agg(F.max("class").alias("class"))
    return lists.domain_intent(rows, classes).withColumn("confidence", F.round("confidence", 3))


def c16_brand_query_type(spark, d):
    return phrases(spark, d).select("row_id", rules.brand_query_type(F.col("keyword"), F.col("brand"), COMMERCIAL, INFORMATIONAL).alias("kind"))


def c23_majority_apart(spark, d):
    return lists.majority_apart(phrases(spark, d).select(F.col("row_id").alias("q"), F.floor(F.col("row_id") / 4).alias("cluster"), "geo")).select(F.col("q").alias("row_id"))


def m21_traffic_at_position(spark, d):
    return role(spark, d, "ads").select("row_id", F.round(rules.traffic_at_position(F.col("shows"), F.col("premium_ctr"), F.col("position")), 6).alias("v"))


def m19_missing_serp_defaults(spark, d):
    from termloom.functions.metrics import with_defaults

    return with_defaults(phrases(spark, d).select("row_id", "w", "m"), ("d", "m", "t")).select("row_id", "d", "m", "t")


def a25_cluster_summary(spark, d):
    main = F.max_by("keyword", F.struct("w", -F.col("row_id")))
    return phrases(spark, d).groupBy("cluster_id").agg(F.count("*").alias("n"), F.sum("w").cast("long").alias("total"), F.round(F.avg("w"), 4).alias("mean"), main.alias("main_keyword"))


def k16_adjacency(spark, d):
    return graph.adjacency_cells(role(spark, d, "edges"))


def l20_graph_export(spark, d):
    e = role(spark, d, "edges")
    return graph.graph_export(e, graph.node_features(e).select("node", "degree"))


def l19_node_features(spark, d):
    return graph.node_features(role(spark, d, "edges")).withColumn("share", F.round("share", 6))


def o5_hubs(spark, d):
    return graph.hubs(role(spark, d, "edges")).select("node", F.round("rank", 5).alias("rank"))


def f1_stop_word_filter(spark, d):
    return lists.stop_word_filter(phrases(spark, d), lists.words_of(spark, ("купить", "wilo", "опт"))).select("row_id", "keyword")


def f1_blocked_rows(spark, d):
    return lists.blocked_rows(phrases(spark, d), lists.words_of(spark, ("купить", "wilo", "опт"))).select("row_id", "keyword", "found")


def f3_low_frequency(spark, d):
    return lists.low_frequency_filter(role(spark, d, "kw")).select("row_id", "keyword", "frequency_world")


def f4_frequency_ratio(spark, d):
    rows = role(spark, d, "kw").withColumn("frequency_world", F.col("frequency_world") * (1 + F.col("row_id") % 97))
    return lists.frequency_ratio_filter(rows).select("row_id", "keyword", "frequency_world", "frequency_exact")


def f5_short_queries(spark, d):
    rows = role(spark, d, "kw").withColumn("keyword", F.when(F.col("row_id") % 9 == 0, F.substring("keyword", 1, 1)).otherwise(F.col("keyword")))
    return lists.short_query_filter(rows).select("row_id", "keyword")


def f7_stop_domain_filter(spark, d):
    stop = spark.createDataFrame([("site3.example.com",), ("WWW.site7.example.com",), ("site9.Example.com",)], "domain string")
    return lists.stop_domain_filter(role(spark, d, "serp").withColumn("domain", F.when(F.col("u") % 2 == 0, F.concat(F.lit("www."), "domain")).when(F.col("u") % 3 == 0, F.concat(F.lit("m."), "domain")).otherwise(F.col("domain"))), stop).select("q", "u", "domain")


_LEMMAS = (("насосы", "насос"), ("трубы", "труба"), ("трубу", "труба"), ("окон", "окно"), ("двери", "дверь"), ("цена", "цена"), ("цены", "цена"))


def _lemmas(spark):
    return spark.createDataFrame(list(_LEMMAS), "form string, lemma string")


def x3_lemmatise(spark, d):
    return lists.lemmatised(phrases(spark, d), _lemmas(spark)).select("row_id", "lemmas", "normalized")


def f2_expanded_stop_words(spark, d):
    return lists.expanded_stop_words(lists.words_of(spark, ("трубы", "цены", "wilo")), _lemmas(spark))


def j18_city_names(spark, d):
    aliases = spark.createDataFrame([("спб", "Санкт-Петербург"), ("МОСКВА", "Москва")], "short string, full string")
    return lists.city_names(phrases(spark, d).select("row_id", F.coalesce("geo", F.lit("спб")).alias("city")), aliases).select("row_id", F.col("full").alias("city"))


def j14_domain_priority(spark, d):
    rows = role(spark, d, "domains")
    observed = rows.where("total_docs >= 750").select(F.concat("domain", F.lit(".example.com")).alias("domain"), F.when(F.col("offers") > 30, "commercial").otherwise("informational").alias("class"))
    one = lambda *names: spark.createDataFrame([(n,) for n in names], "domain string")
    return lists.domain_classes(role(spark, d, "serp"), observed, one("site1.example.com", "site5.example.com"), one("site1.example.com", "site2.example.com"))


def j15_domain_priority_shared(spark, d):
    rows = role(spark, d, "domains")
    shared = rows.select(F.concat("domain", F.lit(".example.com")).alias("domain"), F.lit("commercial").alias("class"), (F.col("offers") / F.greatest(F.col("total_docs"), F.lit(1))).alias("confidence"))
    none = spark.createDataFrame([], "domain string, class string")
    one = lambda *names: spark.createDataFrame([(n,) for n in names], "domain string")
    return lists.domain_classes(role(spark, d, "serp"), none, one("site1.example.com"), one("site2.example.com"), shared, least=0.45)


def j13_dictionary_semi_join(spark, d):
    return phrases(spark, d).where(rules.contains_any(F.col("keyword"), ("насос", "камень", "wilo"))).select("row_id", "keyword")


def w3_first_by_group(spark, d):
    rank = F.row_number().over(Window.partitionBy("keyword").orderBy("group_name", "event_id"))
    return role(spark, d, "status_log").withColumn("r", rank).where("r = 1").select("keyword", "group_name", "event_id")


def x6_signature_clean(spark, d):
    bare = F.regexp_replace("text", "[^а-яёА-ЯЁa-zA-Z0-9\\s]", " ")
    return role(spark, d, "texts").select("doc_id", F.lower(F.trim(F.regexp_replace(bare, r"\s+", " "))).alias("cleaned"))


def x31_capped_list(spark, d):
    return role(spark, d, "serp").groupBy("q").agg(F.array_join(F.slice(F.array_sort(F.collect_list("u")), 1, 5), ", ").alias("urls"))


def u3_common_of_group(spark, d):
    rows = role(spark, d, "serp").select(F.floor(F.col("q") / 2).alias("c"), "q", "u").distinct()
    n = rows.groupBy("c").agg(F.countDistinct("q").alias("queries"))
    return rows.groupBy("c", "u").agg(F.countDistinct("q").alias("k")).join(n, "c").where("k = queries AND queries > 1").select("c", "u")


def o7_top_priority(spark, d):
    from termloom.functions.metrics import calculate_all_metrics

    return calculate_all_metrics(role(spark, d, "kw")).select("row_id", F.round("priority_score", 6).alias("v")).orderBy(F.desc("v"), "row_id").limit(100)


def _stored(spark, d):
    """Result lists in their stored forms."""
    rows = role(spark, d, "serp").groupBy("q").agg(F.array_sort(F.collect_list("url")).alias("urls"))
    kind = F.col("q") % 4
    objects = F.to_json(F.transform("urls", lambda u: F.struct(u.alias("url"), F.lit("t").alias("title"))))
    return rows.select("q", F.when(kind == 0, objects).when(kind == 1, F.to_json("urls")).when(kind == 2, F.array_join("urls", "|")).otherwise(F.concat(F.array_join("urls", ", "), F.lit(","))).alias("stored"), "urls")


def g1_normal_documents(spark, d):
    got = _stored(spark, d).select("q", F.explode(documents.normal_documents(F.col("stored"))).alias("x"))
    return got.select("q", "x.position", "x.url", "x.domain")


def _stored_phrases(spark, d):
    rows = role(spark, d, "kw").select("row_id", F.col("cluster_id").alias("cluster"), F.split("keyword", " ").alias("w"), "frequency_world")
    objects = F.to_json(F.array(F.struct(F.concat_ws(" ", "w").alias("phrase"), F.col("frequency_world").alias("frequency"), F.lit("title").alias("source")), F.struct(F.get("w", F.lit(0)).alias("phrase"), F.col("frequency_world").alias("frequency"), F.lit("snippet").alias("source"))))
    return rows.select("row_id", "cluster", F.when(F.col("row_id") % 3 == 0, F.to_json(F.col("w"))).when(F.col("row_id") % 7 == 0, F.lit("null")).otherwise(objects).alias("stored"))


def _flat_phrases(spark, d):
    return _stored_phrases(spark, d).select("row_id", "cluster", F.explode(documents.normal_phrases(F.col("stored"))).alias("p")).select("row_id", "cluster", "p.phrase", "p.frequency", "p.source")


def g2_normal_phrases(spark, d):
    return _flat_phrases(spark, d).select("row_id", "phrase", "frequency", "source")


def f10_has_phrases(spark, d):
    return _stored_phrases(spark, d).select("row_id", documents.has_phrases(F.col("stored")).alias("valid"))


def a17_cluster_phrases(spark, d):
    sources = _flat_phrases(spark, d).groupBy("cluster", "phrase", "source").agg(F.count("*").alias("k"), F.sum("frequency").alias("f"))
    return sources.groupBy("cluster", "phrase").agg(F.sum("f").alias("frequency"), F.sum("k").alias("queries_count"), F.min(F.struct((-F.col("k")).alias("k"), "source")).source.alias("main_source"))


def c25_aggregate_phrases(spark, d):
    return documents.aggregate_phrases(_flat_phrases(spark, d)).select("cluster", "phrase", "frequency", "queries_count", "main_source", "relevance", "rank")


def z18_phrase_text(spark, d):
    return documents.phrase_text(documents.aggregate_phrases(_flat_phrases(spark, d), top=30))


def j5_phrases_of_results(spark, d):
    return _flat_phrases(spark, d).join(role(spark, d, "serp").groupBy(F.col("q").alias("row_id")).agg(F.count("*").alias("urls")), "row_id").select("row_id", "phrase", "frequency", "urls")


def k4_top_csv(spark, d):
    return role(spark, d, "kw").orderBy(F.desc("frequency_world"), "row_id").limit(20).select("row_id", "keyword", "frequency_world")


def k10_keyword_objects(spark, d):
    return documents.keyword_objects(phrases(spark, d).select("row_id", "keyword", "geo"))


def k19_update_intents(spark, d):
    old = phrases(spark, d).where("row_id % 3 > 0").select("row_id", "main_intent")
    new = phrases(spark, d).where("row_id % 2 = 0").select("row_id", F.lit("changed").alias("fresh"))
    return old.join(new, "row_id", "full").select("row_id", F.coalesce("fresh", "main_intent").alias("main_intent"))


def k20_status_updates(spark, d):
    old = role(spark, d, "status_log").select("event_id", "status", "req_id")
    new = old.where("event_id % 5 = 0").select("event_id", F.lit("completed").alias("s"), F.lit(None).cast("string").alias("r"))
    return old.join(new, "event_id", "left").select("event_id", F.coalesce("s", "status").alias("status"), F.coalesce("r", "req_id").alias("req_id"))


def z1_cluster_report(spark, d):
    rows = phrases(spark, d)
    shared = role(spark, d, "serp").join(rows.select(F.col("row_id").alias("q"), "cluster_id"), "q").groupBy("cluster_id", "u").agg(F.countDistinct("q").alias("k")).where("k >= 2").groupBy("cluster_id").agg(F.count("*").alias("popular_urls"))
    return rows.groupBy("cluster_id").agg(F.count("*").alias("n"), F.sum("w").cast("long").alias("total"), F.max_by("keyword", F.struct("w", -F.col("row_id"))).alias("main_keyword")).join(shared, "cluster_id", "left").na.fill(0, ["popular_urls"])


def z13_top_domains(spark, d):
    rows = links(spark, d).where("class IS NOT NULL").groupBy("class", "domain").agg(F.count("*").alias("n"))
    return rows.withColumn("r", F.row_number().over(Window.partitionBy("class").orderBy(F.desc("n"), "domain"))).where("r <= 30").drop("r")


def z14_pages_of_query(spark, d):
    return role(spark, d, "serp").where("position <= 3").select("url", "q", "position")


def z19_ngram_set(spark, d):
    from termloom.operators.phrases import ngrams

    return role(spark, d, "kw").select("row_id", F.array_join(F.array_sort(F.array_distinct(ngrams(F.split("keyword", " "), 1, 2))), "|").alias("grams"))


def _crumbs(spark, d):
    rows = role(spark, d, "serp")
    path = F.when(F.col("u") % 4 == 0, F.array(F.lit("Главная"), F.lit("404"), F.lit("x"), F.lit("y"))).when(F.col("u") % 4 == 1, F.array(F.lit("Каталог"), F.concat(F.lit("Раздел "), (F.col("u") % 10).cast("string")))).when(F.col("u") % 4 == 2, F.array(F.lit("Каталог"), F.lit("Трубы"), F.concat(F.lit("Вид "), (F.col("u") % 10).cast("string")))).otherwise(F.array().cast("array<string>"))
    return rows.select("q", "position", path.alias("crumbs"))


def w11_best_breadcrumbs(spark, d):
    return documents.best_breadcrumbs(_crumbs(spark, d)).select("q", F.array_join("crumbs", " > ").alias("crumbs"))


def z15_unique_breadcrumbs(spark, d):
    return w11_best_breadcrumbs(spark, d).select("crumbs").distinct()


QUERIES = {n: f for n, f in list(globals().items()) if callable(f) and n[0] in "acfgjklmouwxz" and n[1:2].isdigit()}
