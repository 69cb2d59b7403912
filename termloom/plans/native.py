"""Queries whose operators are DataFrame code rather than statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from termloom.functions.metrics import calculate_all_metrics
from termloom.operators import cluster, graph, phrases, refine, topics
from termloom.sources.tables import cluster_json
from termloom.streaming import status

from .roles import role


def _words(spark, d):
    return topics.tf_idf(role(spark, d, "kw").select(F.col("row_id").alias("id"), F.col("keyword").alias("text")))


QUERIES = {
    # Pairs that statements join on every URL and group; their SQL stays.
    "j7_shared_url_pairs": lambda spark, d: cluster.shared_url_pairs(role(spark, d, "serp"), 3),
    "l2_overlaps_in_clusters": lambda spark, d: cluster.shared_url_pairs(role(spark, d, "serp"), 1, F.col("q") % 40),
    "u1_common_urls": lambda spark, d: cluster.shared_url_pairs(role(spark, d, "serp"), 1),
    "u2_jaccard": lambda spark, d: cluster.jaccard_pairs(role(spark, d, "serp")).withColumn("jaccard", F.round("jaccard", 6)),
    "l1_iterative_clusters": lambda spark, d: cluster.iterative_clusters(role(spark, d, "serp"), low=3, high=10),
    "l4_soft_clusters": lambda spark, d: cluster.soft_clusters(role(spark, d, "serp"), threshold=3),
    "l5_split_clusters": lambda spark, d: refine.split_clusters(s := role(spark, d, "serp"), cluster.soft_clusters(s, threshold=2), cap=100, base=2, most=6),
    "l6_reattach_singletons": lambda spark, d: refine.reattach_singletons(s := role(spark, d, "serp"), cluster.iterative_clusters(s, low=5, high=10), base=4),
    "l10_tf_idf": lambda spark, d: _words(spark, d).select(F.col("id").alias("row_id"), F.explode(F.arrays_zip("terms", "weights")).alias("t")).select("row_id", F.col("t.terms").alias("term"), F.round("t.weights", 5).alias("weight")),
    "l11_k_means": lambda spark, d: topics.k_means(_words(spark, d)),
    "l12_density_clusters": lambda spark, d: topics.density_clusters(_words(spark, d)),
    "l13_cluster_terms": lambda spark, d: topics.top_terms(_words(spark, d), role(spark, d, "kw").select(F.col("row_id").alias("id"), F.col("cluster_id").alias("cluster"))),
    "l14_lda_topics": lambda spark, d: topics.lda_topics(role(spark, d, "kw").select(F.col("row_id").alias("id"), F.col("keyword").alias("text")), topics=5).select("id", "topic", F.round("share", 4).alias("share")),
    "l17_label_propagation": lambda spark, d: graph.label_propagation(role(spark, d, "edges")),
    "l18_pagerank": lambda spark, d: graph.pagerank(role(spark, d, "edges")).select("node", F.round("rank", 5).alias("rank")),
    "c24_lsi_phrases": lambda spark, d: phrases.lsi_phrases(role(spark, d, "kw").select(F.col("cluster_id").alias("id"), F.col("keyword").alias("text"))),
    "m_all_metrics": lambda spark, d: calculate_all_metrics(role(spark, d, "kw")).select("row_id", F.round("priority_score", 5).alias("priority_score"), F.round("kei_synergy", 5).alias("kei_synergy")),
    "k6_cluster_json": lambda spark, d: cluster_json(role(spark, d, "kw").select("cluster_id", "row_id", "keyword")),
    "s_hourly_status_counts": lambda spark, d: status.hourly_counts(role(spark, d, "status_log")).select(F.date_format("hour", "yyyy-MM-dd HH:mm").alias("hour"), "status", "n"),
}

SQL = {
    "l4_soft_clusters": """WITH RECURSIVE p AS (SELECT a.q AS q1, b.q AS q2 FROM serp a JOIN serp b ON a.u = b.u AND a.q < b.q GROUP BY a.q, b.q HAVING count(*) >= 3),
      l AS (SELECT q1 AS a, q2 AS b FROM p UNION ALL SELECT q2, q1 FROM p), r AS (SELECT DISTINCT q, q AS seen FROM serp UNION SELECT r.q, l.b FROM r JOIN l ON l.a = r.seen)
      SELECT q, min(seen) AS cluster FROM r GROUP BY q""",
    "s_hourly_status_counts": "SELECT strftime(date_trunc('hour', updated_at), '%Y-%m-%d %H:%M') AS hour, status, count(*) AS n FROM status_log GROUP BY date_trunc('hour', updated_at), status",
}
