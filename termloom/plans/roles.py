"""The engine's input roles, made from the test tables by statements of both dialects."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .dialect import bind, spell

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

ROLES = {
    # Keywords with frequencies and result-page facts; w, e, d, m, t as doubles for the metrics.
    "kw": """
        SELECT p_partkey AS row_id, lower(p_name) AS keyword, p_brand AS group_name, CAST(p_partkey % 40 AS BIGINT) AS cluster_id, p_size % 12 + 1 AS month,
          CAST(coalesce(w, 0) AS BIGINT) AS frequency_world, CAST(coalesce(e, 0) AS BIGINT) AS frequency_exact,
          coalesce(w, 0e0) AS w, coalesce(e, 0e0) AS e, CAST(coalesce(n, 0) * 1000 AS DOUBLE) AS d, CAST(p_size % 21 AS DOUBLE) AS m, CAST(p_size % 11 AS DOUBLE) AS t,
          CAST(p_size % 9 AS DOUBLE) AS cs, CASE WHEN p_size % 3 = 0 THEN 1e0 ELSE 0e0 END AS geo, CASE WHEN p_size % 5 = 0 THEN 1e0 ELSE 0e0 END AS brand,
          CASE p_size % 4 WHEN 0 THEN 'commercial' WHEN 1 THEN 'informational' WHEN 2 THEN 'navigational' ELSE 'commercial_geo' END AS main_intent,
          CASE p_size % 5 WHEN 0 THEN 'awareness' WHEN 1 THEN 'interest' WHEN 2 THEN 'consideration' WHEN 3 THEN 'decision' ELSE 'purchase' END AS funnel
        FROM part LEFT JOIN (SELECT l_partkey, sum(l_quantity) AS w, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0e0 END) AS e, count(*) AS n FROM lineitem GROUP BY l_partkey) f ON l_partkey = p_partkey""",
    # Result pages: up to 20 URLs of a query.
    "serp": """
        SELECT q, u, position, concat('https://www.Site', CAST(u % 50 AS STRING), '.example.com/p/', CAST(u AS STRING), '/?x=1#top') AS url, concat('site', CAST(u % 50 AS STRING), '.example.com') AS domain
        FROM (SELECT q, u, CAST(row_number() OVER (PARTITION BY q ORDER BY u) AS INT) AS position FROM (SELECT DISTINCT o_custkey AS q, l_partkey AS u FROM orders JOIN lineitem ON l_orderkey = o_orderkey) x) y WHERE position <= 20""",
    "offers": "SELECT l_orderkey AS q, CAST(l_linenumber AS INT) AS position, concat('site', CAST(l_suppkey % 50 AS STRING)) AS domain, l_extendedprice AS price, CASE WHEN l_discount > 0.05e0 THEN l_extendedprice * 1.1e0 END AS oldprice, l_discount * 100 AS discount, CASE WHEN l_linestatus = 'O' THEN 'RUB' ELSE 'USD' END AS currency FROM lineitem",
    "ads": """
        SELECT p_partkey AS row_id, lower(p_name) AS keyword, CAST(p_partkey % 40 AS BIGINT) AS cluster_id, CAST(n * (p_size % 7) * 10 AS DOUBLE) AS shows, n * 1e0 AS clicks, CAST(p_size % 10 AS DOUBLE) AS ctr, CAST(p_size % 6 AS DOUBLE) AS premium_ctr,
          CASE WHEN p_size % 8 = 0 THEN 0e0 ELSE round(p / 400, 2) END AS cpc, p_size % 12 AS position, CASE p_size % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'unknown' END AS competition
        FROM part JOIN (SELECT l_partkey, count(*) AS n, avg(l_extendedprice) AS p FROM lineitem GROUP BY l_partkey) f ON l_partkey = p_partkey""",
    "status_log": """
        SELECT event_id, concat('query ', CAST(user_id % 500 AS STRING)) AS keyword, concat('group ', CAST(user_id % 7 AS STRING)) AS group_name,
          CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'error' ELSE event_type END AS status,
          CASE WHEN event_id % 3 = 0 THEN concat('req', CAST(event_id AS STRING)) END AS req_id, CASE WHEN event_type = 'error' THEN concat('code ', CAST(event_id % 9 AS STRING)) END AS message,
          CASE WHEN event_id % 4 = 0 THEN value END AS found, ts AS updated_at, props FROM events""",
    "domains": "SELECT concat('site', CAST(l_suppkey % 80 AS STRING)) AS domain, count(*) AS total_docs, CAST(sum(CASE WHEN l_discount > 0.06e0 THEN 1 ELSE 0 END) AS BIGINT) AS offers FROM lineitem GROUP BY l_suppkey % 80",
    "texts": "SELECT doc_id, lang, source, lower(coalesce(text, '')) AS text FROM documents",
    "edges": "SELECT DISTINCT least(l_suppkey, l_partkey % 97 + 1) AS src, greatest(l_suppkey, l_partkey % 97 + 1) AS dst FROM lineitem WHERE l_suppkey <> l_partkey % 97 + 1",
}


def used(text: str, names) -> list[str]:
    return [n for n in names if re.search(rf"\b(?:FROM|JOIN)\s+{n}\b", text)]


def role(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A role as a DataFrame."""
    text = spell(ROLES[name], spark=True)
    tables = used(text, TABLES)
    return spark.sql(bind(text, tables), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})
