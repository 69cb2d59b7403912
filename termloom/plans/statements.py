"""Relational operators as statements of both dialects (see dialect.py). Names start with the survey's identifiers."""

from __future__ import annotations

from termloom.functions.metrics import METRICS, normalised

STATEMENTS: dict[str, str] = {}
_S = STATEMENTS

# --- Filters ---------------------------------------------------------------------------------------------------------
_STOP = "('green', 'large', 'small')"

_S["f6_filter_chain"] = f"SELECT row_id, keyword FROM kw WHERE LIST_SIZE(LIST_FILTER(regexp_extract_all(keyword, RX'[a-zа-яё]+', 0), FN x: x IN {_STOP})) = 0 AND frequency_world >= 1 AND e > 0 AND w <= 51 * e AND length(keyword) >= 2"
_S["f8_gui_filter"] = "SELECT row_id, keyword, main_intent, frequency_world FROM kw WHERE STRPOS(keyword, 'e') > 0 AND main_intent = 'commercial' AND frequency_world BETWEEN 100 AND 900"
_S["f9_has_serp_urls"] = """SELECT event_id, CASE WHEN props IS NULL OR trim(props) IN ('', '[]', 'null', 'NULL', 'None') THEN FALSE ELSE JSON_GET(props, '$.k') IS NOT NULL END AS has_urls FROM status_log"""
_S["f11_pending_work"] = "SELECT DISTINCT keyword, group_name FROM status_log WHERE status = 'pending' OR status IS NULL OR (status = 'processing' AND req_id IS NULL) OR (status = 'error' AND message IS NULL) OR (status = 'completed' AND found IS NULL)"
_S["f12_presence_counts"] = "SELECT count(*) AS total, count_if(length(props) > 2) AS with_props, count_if(length(coalesce(message, '')) > 2) AS with_message FROM status_log"
_S["f13_filter_sort_limit"] = "SELECT row_id, keyword, frequency_world FROM kw WHERE main_intent = 'commercial' AND frequency_world > 100 ORDER BY frequency_world DESC, row_id LIMIT 50"
_S["f14_column_pruning"] = "SELECT keyword, frequency_world, frequency_exact FROM kw"
_S["f15_derived_columns"] = "SELECT row_id, CAST(coalesce(d, 0e0) AS BIGINT) AS serp_docs_count, CAST(coalesce(m, 0e0) AS BIGINT) AS serp_main_pages, CAST(AT_LEAST_ZERO(coalesce(t, 0e0) - coalesce(m, 0e0)) AS BIGINT) AS serp_internal_pages FROM kw"

# --- Joins -----------------------------------------------------------------------------------------------------------
_S["j1_left_join_defaults"] = "SELECT row_id, k.keyword, coalesce(n, 0) AS urls FROM kw k LEFT JOIN (SELECT q, count(*) AS n FROM serp GROUP BY q) s ON k.row_id = s.q"
_S["j2_ads_join"] = "SELECT k.row_id, k.keyword, coalesce(a.shows, 0e0) AS shows, coalesce(a.cpc, 0e0) AS cpc, coalesce(a.competition, 'unknown') AS competition FROM kw k LEFT JOIN (SELECT * FROM ads WHERE shows > 500) a ON k.row_id = a.row_id"
_S["j3_cluster_attributes"] = "SELECT k.row_id, k.cluster_id, c.size, c.total FROM kw k LEFT JOIN (SELECT cluster_id, count(*) AS size, CAST(sum(frequency_world) AS BIGINT) AS total FROM kw GROUP BY cluster_id) c ON k.cluster_id = c.cluster_id"
_S["j4_forms_default"] = "SELECT k.row_id, coalesce(f.form, k.keyword) AS form FROM kw k LEFT JOIN (SELECT row_id, concat('of ', keyword) AS form FROM (SELECT row_id, keyword, row_number() OVER (ORDER BY frequency_world DESC, row_id) AS r FROM kw) x WHERE r <= 1000) f ON k.row_id = f.row_id"
_S["j6_results_documents"] = "SELECT o.o_orderkey, l.l_linenumber, o.o_orderstatus FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey"
_PAIRS = "SELECT a.q AS q1, b.q AS q2, count(*) AS common FROM serp a JOIN serp b ON a.u = b.u AND a.q < b.q GROUP BY a.q, b.q"
_S["j7_shared_url_pairs"] = f"{_PAIRS} HAVING count(*) >= 3"
_S["j8_candidates_of_query"] = "SELECT b.q AS candidate, count(*) AS common FROM serp a JOIN serp b ON a.u = b.u AND a.q <> b.q WHERE a.q = 1 GROUP BY b.q HAVING count(*) >= 1"
# Clusters of unlike sizes, about as many as the root of the queries: large ones share URLs, small ones often only words.
_CLUSTER_URLS = "SELECT DISTINCT CAST(floor(sqrt(q)) AS BIGINT) AS c, u FROM serp"
_CLUSTER_LINKS = f"cu AS ({_CLUSTER_URLS}), linked AS (SELECT a.c AS c1, b.c AS c2, count(*) AS strength FROM cu a JOIN cu b ON a.u = b.u AND a.c < b.c GROUP BY a.c, b.c HAVING count(*) >= 3)"
_S["j9_cluster_url_links"] = f"WITH {_CLUSTER_LINKS} SELECT c1, c2, strength FROM linked"
_CLUSTER_WORDS = "SELECT DISTINCT cluster_id AS c, word FROM (SELECT cluster_id, EXPLODE(SPLIT_RX(keyword, ' +')) AS word FROM kw) x WHERE word NOT IN ('green', 'large')"
_KEYWORD_WORDS = _CLUSTER_WORDS.replace("cluster_id AS c", "CAST(floor(sqrt(row_id)) AS BIGINT) AS c").replace("SELECT cluster_id", "SELECT row_id")
_WORD_LINKS = f"cw AS ({_KEYWORD_WORDS}), worded AS (SELECT a.c AS c1, b.c AS c2, count(*) AS words FROM cw a JOIN cw b ON a.word = b.word AND a.c < b.c WHERE NOT EXISTS (SELECT 1 FROM linked l WHERE l.c1 = a.c AND l.c2 = b.c) GROUP BY a.c, b.c HAVING count(*) >= 2)"
_S["j10_cluster_word_links_anti"] = f"WITH {_CLUSTER_LINKS}, {_WORD_LINKS} SELECT c1, c2, words FROM worded"
_S["j16_batch_lookup"] = "SELECT keyword, group_name, status FROM (SELECT keyword, group_name, status, row_number() OVER (PARTITION BY keyword ORDER BY group_name, event_id) AS r FROM status_log WHERE keyword IN ('query 1', 'query 2', 'query 77', 'query 499')) x WHERE r = 1"
_S["j17_missing_from_cache"] = "SELECT row_id FROM kw k WHERE NOT EXISTS (SELECT 1 FROM ads a WHERE a.row_id = k.row_id AND a.shows > 500)"
_S["j19_copy_between_stores"] = "SELECT keyword, 'a' AS origin FROM kw WHERE row_id % 2 = 0 UNION ALL SELECT keyword, 'b' AS origin FROM ads WHERE row_id % 2 = 1"

# --- Aggregates ------------------------------------------------------------------------------------------------------
_S["a1_group_statistics"] = "SELECT group_name, count(*) AS total, CAST(sum(CASE WHEN cs > 0 THEN 1 ELSE 0 END) AS BIGINT) AS with_score, round(avg(w), 6) AS avg_world, round(avg(e), 6) AS avg_exact FROM kw GROUP BY group_name"
_S["a2_status_statistics"] = "SELECT count(*) AS total, count_if(status = 'completed') AS completed, count_if(status = 'error') AS failed, round(100e0 * count_if(status = 'completed') / count(*), 6) AS completion_rate FROM status_log"
_S["a3_status_share"] = "SELECT status, count(*) AS n, round(100e0 * count(*) / (SELECT count(*) FROM status_log), 6) AS percentage FROM status_log GROUP BY status"
_S["a4_top_errors"] = "SELECT message, count(*) AS n FROM status_log WHERE message IS NOT NULL GROUP BY message ORDER BY n DESC, message LIMIT 20"
_S["a5_count_by_group"] = "SELECT group_name, count(*) AS n FROM status_log GROUP BY group_name"
_S["a6_distinct_groups"] = "SELECT count(DISTINCT group_name) AS n FROM status_log"
_S["a7_group_exists"] = "SELECT g.group_name, count(k.row_id) > 0 AS found FROM (SELECT group_name FROM kw UNION SELECT group_name FROM status_log) g LEFT JOIN kw k ON k.group_name = g.group_name GROUP BY g.group_name"
_S["a8_unique_keywords"] = "SELECT count(DISTINCT keyword) AS n FROM kw"
_S["a9_metric_summary"] = f"WITH x AS (SELECT {METRICS['kei_standard']} AS v FROM kw) SELECT round(avg(v), 4) AS mean, round(median(v), 4) AS middle, round(stddev_samp(v), 4) AS std, round(min(v), 4) AS least, round(max(v), 4) AS most FROM x"
_S["a10_price_statistics"] = "SELECT q, round(avg(price), 4) AS mean, min(price) AS least, max(price) AS most, round(median(price), 4) AS middle, min_by(currency, position * 1000000 + price) AS currency, count(*) AS n, count(oldprice) AS discounts, round(avg(CASE WHEN oldprice IS NOT NULL THEN discount END), 4) AS mean_discount FROM offers GROUP BY q"
_S["a11_offer_domain_counts"] = "SELECT q, count_if(oldprice IS NOT NULL) AS offers, count(DISTINCT CASE WHEN domain IN ('site1', 'site2', 'site3', 'site4', 'site5') THEN domain END) AS commercial_domains FROM offers WHERE position <= 5 GROUP BY q"
_S["a12_domain_offer_ratio"] = "SELECT domain, total_docs, offers, round(offers * 1e0 / total_docs, 6) AS ratio FROM domains"
_S["a13_domain_class"] = "SELECT domain, CASE WHEN STRPOS(domain, 'site7') > 0 THEN 'informational' WHEN offers * 1e0 / total_docs >= 0.3e0 OR offers >= 50 THEN 'commercial' ELSE 'informational' END AS class, round(least(1e0, total_docs / 1000e0), 6) AS confidence FROM domains WHERE total_docs >= 50"
_S["a14_domain_commercial_counts"] = "SELECT domain, oldprice IS NOT NULL AS is_commercial, count(*) AS n FROM offers GROUP BY domain, oldprice IS NOT NULL"
_S["a15_cluster_ads"] = """WITH r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY cpc, row_id) - 1 AS i, count(*) OVER (PARTITION BY cluster_id) AS n FROM ads),
  mode AS (SELECT cluster_id, competition, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, competition) AS r FROM ads GROUP BY cluster_id, competition)
  SELECT r.cluster_id, sum(shows) AS shows, sum(clicks) AS clicks, round(sum(cpc * shows) / greatest(sum(shows), 1e-9), 4) AS mean_cpc, max(CASE WHEN i = floor(n / 2) THEN cpc END) AS median_cpc, max(m.competition) AS competition
  FROM r JOIN mode m ON m.cluster_id = r.cluster_id AND m.r = 1 GROUP BY r.cluster_id"""
_S["a16_auction_bids"] = "SELECT q, min(price) AS least, round(avg(price), 4) AS mean, max(price) AS most, min_by(price, position * 1000000 + price) AS recommended FROM offers GROUP BY q"
_S["a18_cluster_top_urls"] = "SELECT c, u, n FROM (SELECT q % 40 AS c, u, count(*) AS n, row_number() OVER (PARTITION BY q % 40 ORDER BY count(*) DESC, u) AS r FROM serp GROUP BY q % 40, u) x WHERE r <= 20"
_MODE = "(SELECT cluster_id, {0} AS v, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, {0}) AS r FROM kw GROUP BY cluster_id, {0})"
_S["a19_cluster_profile"] = f"SELECT k.cluster_id, count(*) AS size, CAST(sum(frequency_world) AS BIGINT) AS total, CAST(floor(avg(w)) AS BIGINT) AS mean, max(f.v) AS funnel, max(i.v) AS intent FROM kw k JOIN {_MODE.format('funnel')} f ON f.cluster_id = k.cluster_id AND f.r = 1 JOIN {_MODE.format('main_intent')} i ON i.cluster_id = k.cluster_id AND i.r = 1 GROUP BY k.cluster_id"
_S["a20_commercial_factors"] = "SELECT cluster_id, CAST(sum(cs + m) AS BIGINT) AS factors, CASE WHEN sum(cs + m) >= 12 THEN 'commercial' ELSE 'informational' END AS class FROM kw GROUP BY cluster_id"
_S["a21_pure_intent_clusters"] = "SELECT cluster_id, max(main_intent) AS intent FROM (SELECT row_id % 700 AS cluster_id, main_intent FROM kw) x GROUP BY cluster_id HAVING count(DISTINCT main_intent) = 1"
_COMM = "CASE WHEN main_intent LIKE 'commercial%' THEN 1e0 ELSE 0e0 END"
_S["a22_dominant_clusters"] = f"SELECT cluster_id, round(avg({_COMM}), 6) AS share FROM (SELECT row_id % 300 AS cluster_id, main_intent FROM kw) x GROUP BY cluster_id HAVING avg({_COMM}) > 0.7e0"
_S["a23_mixed_clusters"] = f"SELECT cluster_id, round(avg({_COMM}), 6) AS share FROM kw GROUP BY cluster_id HAVING avg({_COMM}) >= 0.3e0 AND avg({_COMM}) <= 0.7e0 AND avg(CASE WHEN main_intent = 'informational' THEN 1e0 ELSE 0e0 END) > 0"
_S["a24_intent_summary"] = "SELECT main_intent, count(*) AS n, CAST(sum(frequency_world) AS BIGINT) AS total FROM kw GROUP BY main_intent"
_S["a26_cluster_prices"] = "WITH p AS (SELECT q, avg(price) AS mean, min(price) AS least, max(price) AS most, count(oldprice) AS discounts FROM offers GROUP BY q) SELECT q % 40 AS cluster_id, round(avg(mean), 4) AS mean, min(least) AS least, max(most) AS most, round(100e0 * count_if(discounts > 0) / count(*), 4) AS discount_share FROM p GROUP BY q % 40"
_S["a27_cluster_ads_coverage"] = "SELECT cluster_id, count_if(shows > 0) AS covered, round(100e0 * count_if(shows > 0) / count(*), 4) AS coverage, round(avg(CASE WHEN cpc > 0 THEN cpc END), 4) AS mean_cpc FROM ads GROUP BY cluster_id"
_S["a28_cluster_url_shares"] = "WITH n AS (SELECT q % 300 AS c, count(DISTINCT q) AS queries FROM serp GROUP BY q % 300), u AS (SELECT q % 300 AS c, u, count(*) AS n, row_number() OVER (PARTITION BY q % 300 ORDER BY count(*) DESC, u) AS r FROM serp GROUP BY q % 300, u) SELECT u.c, u.u, u.n, u.n = n.queries AS common_to_all, round(100e0 * u.n / n.queries, 4) AS percentage FROM u JOIN n ON n.c = u.c WHERE u.n >= 2 AND u.r <= 15"
_S["a29_overall_statistics"] = "SELECT count(*) AS total, CAST(sum(frequency_world) AS BIGINT) AS frequency, round(avg(w), 4) AS mean, count(DISTINCT cluster_id) AS clusters, round(100e0 * avg(brand), 4) AS brand_share, round(100e0 * avg(geo), 4) AS geo_share FROM kw"
_S["a30_cluster_cards"] = "SELECT cluster_id, row_id, frequency_world FROM (SELECT cluster_id, row_id, frequency_world, row_number() OVER (PARTITION BY cluster_id ORDER BY frequency_world DESC, row_id) AS r FROM kw) x WHERE r <= 30"
_S["a31_word_frequency"] = "SELECT word, count(*) AS n, count(DISTINCT row_id) AS docs FROM (SELECT row_id, EXPLODE(SPLIT_RX(keyword, ' +')) AS word FROM kw) x GROUP BY word"
_S["a32_capitalised_words"] = "SELECT word, count(*) AS n FROM (SELECT EXPLODE(regexp_extract_all(text, '[A-Z][a-z]{3,}', 0)) AS word FROM documents) x GROUP BY word HAVING count(*) >= 5"
_S["a33_neighbour_words"] = "WITH x AS (SELECT row_id, SPLIT_RX(keyword, ' +') AS ws FROM kw), p AS (SELECT DISTINCT ws[FIRST] AS word, ws[SECOND] AS neighbour FROM x WHERE LIST_SIZE(ws) >= 2) SELECT word, count(*) AS contexts FROM p GROUP BY word"
_S["a34_value_distribution"] = "SELECT funnel, count(*) AS n FROM kw GROUP BY funnel"
_S["a35_cluster_sizes"] = "SELECT count(*) AS clusters, round(avg(n), 4) AS mean, min(n) AS least, max(n) AS most, count_if(n = 1) AS singles FROM (SELECT row_id % 777 AS c, count(*) AS n FROM kw GROUP BY row_id % 777) x"
_S["a36_cluster_words"] = f"SELECT c, LIST_JOIN(LIST_SORT(COLLECT(word)), ' ') AS words FROM ({_CLUSTER_WORDS}) x GROUP BY c"
_S["a37_lsi_coverage"] = "SELECT count_if(n > 0) AS with_urls, count_if(n = 0) AS without_urls, round(avg(n), 4) AS mean FROM (SELECT k.row_id, count(s.u) AS n FROM kw k LEFT JOIN serp s ON s.q = k.row_id GROUP BY k.row_id) x"
_S["a38_contingency"] = "SELECT count_if(found IS NOT NULL AND req_id IS NOT NULL) AS both_there, count_if(found IS NOT NULL AND req_id IS NULL) AS first_only, count_if(found IS NULL AND req_id IS NOT NULL) AS second_only, count_if(found IS NULL AND req_id IS NULL) AS none_there FROM status_log"
_S["a39_intent_shares"] = "SELECT main_intent, count(*) AS n, round(count(*) * 1e0 / (SELECT count(*) FROM kw), 6) AS share FROM kw GROUP BY main_intent"
_S["a40_commercial_price"] = "SELECT round(avg(price), 4) AS mean, count(*) AS n FROM offers WHERE oldprice IS NOT NULL"

# --- Windows, orders, sets -------------------------------------------------------------------------------------------
_S["w1_exact_dedup"] = "SELECT keyword, row_id, frequency_exact FROM (SELECT keyword, row_id, frequency_exact, row_number() OVER (PARTITION BY keyword ORDER BY frequency_exact DESC, row_id) AS r FROM kw) x WHERE r = 1"
_SIGNED = "SELECT row_id, keyword, frequency_exact, LIST_JOIN(LIST_SORT(LIST_SET(LIST_FILTER(SPLIT_RX(lower(trim(regexp_replace(regexp_replace(keyword, RX'[^a-zа-яёA-ZА-ЯЁ0-9 ]', ' ' ALL_G), ' +', ' ' ALL_G))), ' '), FN x: length(x) >= 2 AND x NOT IN ('and', 'the')))), ' ') AS signature FROM kw"
_S["x7_signature"] = _SIGNED
_S["w2_implicit_dedup"] = f"""WITH s AS ({_SIGNED}), g AS (SELECT *, max(frequency_exact) OVER (PARTITION BY signature) AS top, min(frequency_exact) OVER (PARTITION BY signature) AS low, count(*) OVER (PARTITION BY signature) AS n,
  row_number() OVER (PARTITION BY signature ORDER BY row_id) AS first_row, row_number() OVER (PARTITION BY signature ORDER BY frequency_exact DESC, row_id) AS first_top FROM s),
  h AS (SELECT *, sum(CASE WHEN frequency_exact = top THEN 1 ELSE 0 END) OVER (PARTITION BY signature) AS tops FROM g)
  SELECT row_id, keyword, signature FROM h WHERE signature = '' OR n = 1 OR (top = low AND first_row > 1) OR (top > low AND tops > 1 AND first_top > 1) OR (top > low AND tops = 1 AND frequency_exact = top)"""
_S["w4_duplicate_rank"] = f"WITH s AS ({_SIGNED}) SELECT row_id, signature, CAST(row_number() OVER (PARTITION BY signature ORDER BY frequency_exact DESC, row_id) AS INT) AS rank, frequency_exact = max(frequency_exact) OVER (PARTITION BY signature) AS is_max FROM s WHERE signature <> ''"
_S["w5_top_k_per_group"] = "SELECT group_name, row_id FROM (SELECT group_name, row_id, row_number() OVER (PARTITION BY group_name ORDER BY frequency_world DESC, row_id) AS r FROM kw) x WHERE r <= 10"
_S["w6_cluster_name"] = "SELECT cluster_id, keyword AS name FROM (SELECT cluster_id, keyword, row_number() OVER (PARTITION BY cluster_id ORDER BY frequency_world DESC, row_id) AS r FROM kw) x WHERE r = 1"
_S["w7_cluster_first_name"] = "SELECT cluster_id, min_by(keyword, row_id) AS name FROM kw GROUP BY cluster_id"
_S["w8_min_max"] = f"SELECT row_id, round({normalised('w')}, 6) AS normalised FROM kw CROSS JOIN (SELECT min(w) AS lo_w, max(w) AS hi_w FROM kw) x"
_S["w9_normalise_with_median"] = f"WITH v AS (SELECT row_id, CASE WHEN m = 0 THEN NULL ELSE w / m END AS x FROM kw), c AS (SELECT median(x) AS mid FROM v), f AS (SELECT row_id, coalesce(x, mid) AS x FROM v CROSS JOIN c), r AS (SELECT min(x) AS lo_x, max(x) AS hi_x FROM f) SELECT row_id, round({normalised('x')}, 6) AS normalised FROM f CROSS JOIN r"
_S["w10_positions"] = "SELECT q, u, position FROM serp"
_S["w12_first_per_url"] = "SELECT u, min_by(q, position * 1000000 + q) AS first_query FROM serp GROUP BY u"
_S["o1_largest"] = f"SELECT row_id, round({METRICS['kei_effectiveness']}, 6) AS v FROM kw ORDER BY v DESC, row_id LIMIT 25"
_S["o2_cluster_frequency_order"] = "SELECT cluster_id, row_id, coalesce(frequency_world, 0) AS frequency FROM kw ORDER BY cluster_id, frequency DESC, row_id"
_S["o3_load_order"] = "SELECT row_id, frequency_world FROM kw WHERE group_name = 'Brand#11' ORDER BY frequency_world DESC, row_id"
_S["o8_top_brands"] = "SELECT group_name, count(*) AS n FROM kw WHERE brand > 0 GROUP BY group_name ORDER BY n DESC, group_name LIMIT 10"
_S["o9_clusters_by_frequency"] = "SELECT cluster_id, CAST(sum(frequency_world) AS BIGINT) AS total FROM kw GROUP BY cluster_id ORDER BY total DESC, cluster_id"
_S["o10_top_15"] = "SELECT row_id, frequency_world FROM kw ORDER BY frequency_world DESC, row_id LIMIT 15"
_S["o11_recent_updates"] = "SELECT event_id, keyword, status FROM status_log ORDER BY updated_at DESC, event_id LIMIT 5"
_S["o12_top_domains_by_class"] = "SELECT class, domain, total_docs FROM (SELECT CASE WHEN offers > 280 THEN 'commercial' ELSE 'informational' END AS class, domain, total_docs, row_number() OVER (PARTITION BY CASE WHEN offers > 280 THEN 'commercial' ELSE 'informational' END ORDER BY total_docs DESC, domain) AS r FROM domains) x WHERE r <= 10"
# All pairs of queries with a URL in common; a pair that isn't returned has none, and similarity 0.
_S["u1_common_urls"] = "WITH s AS (SELECT DISTINCT q, u FROM serp) SELECT a.q AS q1, b.q AS q2, count(*) AS common FROM s a JOIN s b ON a.u = b.u AND a.q < b.q GROUP BY a.q, b.q"
_S["u2_jaccard"] = "WITH s AS (SELECT q, u, count(*) OVER (PARTITION BY q) AS n FROM (SELECT DISTINCT q, u FROM serp) x) SELECT a.q AS q1, b.q AS q2, round(count(*) * 1e0 / (min(a.n) + min(b.n) - count(*)), 6) AS jaccard FROM s a JOIN s b ON a.u = b.u AND a.q < b.q GROUP BY a.q, b.q"
_S["u4_difference"] = "SELECT row_id, LIST_JOIN(LIST_FILTER(SPLIT_RX(keyword, ' +'), FN x: x NOT IN ('green', 'large')), ' ') AS rest FROM kw"
_S["u5_subset"] = "SELECT row_id, LIST_SIZE(LIST_FILTER(SPLIT_RX(keyword, ' +'), FN x: NOT LIST_HAS(SPLIT_RX('green large red steel', ' '), x))) = 0 AS subset FROM kw"
_S["u6_union_of_lists"] = "SELECT c, count(*) AS urls FROM (SELECT DISTINCT q % 40 AS c, u FROM serp) x GROUP BY c"
_S["u7_upsert"] = "WITH new AS (SELECT row_id, keyword, frequency_world FROM kw WHERE row_id % 3 = 0), old AS (SELECT row_id, keyword, CAST(7 AS BIGINT) AS frequency_world FROM kw WHERE row_id % 2 = 0) SELECT row_id, keyword, frequency_world FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY o) AS r FROM (SELECT *, 0 AS o FROM new UNION ALL SELECT *, 1 AS o FROM old) x) y WHERE r = 1"
_S["u8_list_distinct"] = "SELECT row_id, CAST(LIST_SIZE(LIST_SET(SPLIT_RX(concat(keyword, ' ', keyword), ' +'))) AS BIGINT) AS n FROM kw"
_S["u9_select_distinct"] = "SELECT DISTINCT group_name, status FROM status_log"

# --- Text and URL functions ------------------------------------------------------------------------------------------
_S["x1_clean_text"] = "SELECT doc_id, trim(regexp_replace(regexp_replace(text, RX'[\\x09-\\x0d\\x1c-\\x20\\x85\\p{Z}]+', ' ' ALL_G), RX'[^\\p{L}\\p{N}_ -]', ' ' ALL_G)) AS cleaned FROM texts"
_S["x2_tokenize"] = "SELECT doc_id, CAST(LIST_SIZE(LIST_FILTER(SPLIT_RX(trim(regexp_replace(text, RX'[^\\p{L}\\p{N}_-]+', ' ' ALL_G)), ' +'), FN x: length(x) > 1)) AS BIGINT) AS tokens FROM texts"
_S["x4_normalized"] = "SELECT row_id, LIST_JOIN(LIST_SORT(SPLIT_RX(keyword, ' +')), ' ') AS normalized FROM kw"
_S["x5_word_facts"] = "SELECT doc_id, CAST(LIST_SIZE(SPLIT_RX(trim(text), RX'\\s+')) AS BIGINT) AS words, MATCHES(text, '[a-zA-Z]') AS has_latin, MATCHES(text, '[0-9]') AS has_numbers, LIST_JOIN(regexp_extract_all(text, '[0-9]+', 0), ',') AS numbers FROM texts"
_HOST = "lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1))"
_S["x8_normalize_url"] = "SELECT page_id, lower(regexp_replace(regexp_replace(replace(replace(replace(url, 'https://', ''), 'http://', ''), 'www.', ''), '[?#].*$', ''), '/+$', '')) AS normalised FROM pages"
_S["x9_normalize_url_anchored"] = "SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^https?://', ''), RX'^www[.]', ''), '[?#].*$', ''), '/+$', '') AS normalised FROM pages"
_S["x10_normalize_url_legacy"] = "SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(url), '^https?://(www[.])?', ''), ' .*$', ''), '/$', '') AS normalised FROM pages"
_S["x11_domain"] = f"SELECT page_id, {_HOST} AS host, regexp_replace({_HOST}, '^www[.]', '') AS domain FROM pages"
_S["x12_is_root_url"] = "SELECT page_id, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) IN ('', '/') AS is_root FROM pages"
_S["x13_commercial_domain"] = f"SELECT page_id, MATCHES({_HOST}, 'shop|store|market|tion') AS is_commercial, MATCHES({_HOST}, 'wiki|blog|news') AS is_info FROM pages"
_S["x14_strip_tags"] = "SELECT page_id, length(trim(regexp_replace(lower(regexp_replace(html, '<[^>]*>', ' ' ALL_G)), RX'[^\\p{L}\\p{N}]+', ' ' ALL_G))) AS chars FROM pages"
_S["x15_inner_text"] = "SELECT page_id, md5(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', '' ALL_G), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')) AS text_md5 FROM pages"
_S["x16_slug"] = "SELECT row_id, CASE WHEN slug = '' THEN 'page' ELSE substr(slug, 1, 100) END AS slug FROM (SELECT row_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(keyword, ' +', '-' ALL_G), '[^a-z0-9_-]', '' ALL_G), '-+', '-' ALL_G), '^-|-$', '' ALL_G) AS slug FROM kw) x"
_S["x17_slug_dashes"] = "SELECT row_id, regexp_replace(regexp_replace(keyword, '[^a-z0-9]+', '-' ALL_G), '^-|-$', '' ALL_G) AS slug FROM kw"
_S["x18_url_template"] = "SELECT row_id, CASE main_intent WHEN 'commercial' THEN concat('/catalog/', replace(keyword, ' ', '-')) WHEN 'informational' THEN concat('/blog/', replace(keyword, ' ', '-')) ELSE concat('/', replace(keyword, ' ', '-')) END AS page_url FROM kw"
_S["x19_homoglyphs"] = "SELECT row_id, translate(group_name, 'aceopxyACEOPXY', 'асеорхуАСЕОРХУ') AS folded FROM kw"
_S["x22_cache_key"] = "SELECT row_id, md5(concat(lower(trim(keyword)), '_', '213')) AS cache_key FROM kw"
_S["x23_match_tokens"] = "SELECT row_id, LIST_JOIN(LIST_SORT(LIST_SET(LIST_FILTER(regexp_extract_all(keyword, RX'[а-яёa-z0-9]+', 0), FN x: x NOT IN ('and', 'for', 'the')))), ' ') AS tokens FROM kw"
_S["x25_sublist"] = "SELECT row_id, STRPOS(concat(' ', keyword, ' '), ' red steel ') > 0 AS has_phrase FROM kw"
_S["x26_address"] = "SELECT doc_id, regexp_extract(text, RX'([\\p{L}]+ (?:street|road)),? ?([0-9]+)', 1) AS street FROM texts"
_S["x27_breadcrumb_split"] = "SELECT page_id, CASE WHEN LIST_SIZE(SPLIT_RX(p, '>')) >= 2 THEN LIST_JOIN(SPLIT_RX(p, '>'), '|') WHEN LIST_SIZE(SPLIT_RX(p, '/')) >= 2 THEN LIST_JOIN(SPLIT_RX(p, '/'), '|') END AS parts FROM (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS p FROM pages) x"
_S["x28_breadcrumb_clean"] = "SELECT page_id, CASE WHEN LIST_SIZE(parts) >= 2 THEN LIST_JOIN(parts, ' > ') END AS crumbs FROM (SELECT page_id, LIST_FILTER(SPLIT_RX(regexp_replace(url, '^[a-z]+://', ''), '[/?#]'), FN x: length(x) >= 2 AND x NOT IN ('home', 'main')) AS parts FROM pages) x"
_S["x29_html_facts"] = "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS h1, length(html) AS html_length FROM pages"

# --- Metrics ---------------------------------------------------------------------------------------------------------
_AD = "(SELECT k.*, a.shows, a.ctr, a.cpc, a.premium_ctr, a.position, 50e0 AS difficulty FROM kw k LEFT JOIN ads a ON a.row_id = k.row_id)"
for _k, (_name, _text) in enumerate(METRICS.items(), 1):
    _S[f"metric_{_name}"] = f"SELECT row_id, round({_text}, 6) AS v FROM {_AD} x"
_MADE = ", ".join(f"{_t} AS {_n}" for _n, _t in METRICS.items())
_S["m10_potential_revenue"] = f"SELECT row_id, round(kei_potential_traffic * kei_cost_per_visit, 6) AS v FROM (SELECT row_id, {_MADE} FROM {_AD} x) y"
_S["m11_synergy"] = f"SELECT row_id, round(kei_effectiveness * kei_popularity / (kei_competition + 1), 6) AS v FROM (SELECT row_id, {_MADE} FROM {_AD} x) y"
_S["m13_effectiveness_coefficient"] = f"SELECT row_id, round(kei_effectiveness * kei_effectiveness / (1 + kei_competition / 1000), 6) AS v FROM (SELECT row_id, {_MADE} FROM {_AD} x) y"
_S["m17_priority_score"] = f"WITH k AS (SELECT row_id, w, cs, {METRICS['kei_effectiveness']} AS f FROM kw), r AS (SELECT min(w) AS lo_w, max(w) AS hi_w, min(cs) AS lo_cs, max(cs) AS hi_cs, min(f) AS lo_f, max(f) AS hi_f FROM k) SELECT row_id, round(0.3e0 * ({normalised('w')}) + 0.25e0 * 50 + 0.25e0 * ({normalised('cs')}) + 0.2e0 * ({normalised('f')}), 6) AS v FROM k CROSS JOIN r"
_S["m20_ads_competition"] = "SELECT k.row_id, round(CASE WHEN shows = 0 THEN w ELSE w / CASE WHEN shows = 0 THEN 1e0 ELSE shows END END * CASE WHEN cpc = 0 THEN 100e0 ELSE 100 / CASE WHEN cpc = 0 THEN 1e0 ELSE cpc END END, 6) AS v FROM kw k JOIN ads a ON a.row_id = k.row_id"
_S["m22_click_budget"] = "SELECT row_id, round(100 * cpc, 6) AS v FROM ads"
_S["m23_monthly_budget"] = "SELECT row_id, round(shows * (50e0 / 100) * (ctr / 100) * cpc, 6) AS v FROM ads"
_S["m24_seasonality"] = "SELECT row_id, CASE WHEN month IN (12, 1, 2) THEN 1.2e0 WHEN month IN (6, 7, 8) THEN 0.9e0 ELSE 1e0 END AS v FROM kw"
_S["m28_serp_difficulty"] = "SELECT row_id, round(least(100e0, least(d / 1e6 * 50, 50e0) + least(1.5e0 * m, 25e0) + least(0.8e0 * t, 15e0) + least(0.5e0 * cs, 10e0)), 6) AS v FROM kw"
_S["m29_competition_level"] = "SELECT row_id, CASE WHEN cpc = 0 OR shows < 100 THEN 'low' WHEN cpc < 50 THEN CASE WHEN shows > 1000 THEN 'medium' ELSE 'low' END WHEN cpc < 150 THEN 'medium' ELSE 'high' END AS level FROM ads"
_S["m30_lsi_relevance"] = "SELECT row_id, round(w * (1 + 0.1e0 * t) * (1 + 0.3e0 * (LIST_SIZE(SPLIT_RX(keyword, ' +')) - 2)), 6) AS v FROM kw"
_S["m31_offer_confidence"] = "SELECT q, CASE WHEN k >= 7 THEN 'commercial' ELSE 'informational' END AS intent, CASE WHEN k >= 7 THEN least(k / 10e0, 1e0) ELSE greatest(1 - k / 10e0, 0.5e0) END AS confidence FROM (SELECT q, count(oldprice) + count(DISTINCT domain) AS k FROM offers GROUP BY q) x"
_S["m32_round"] = "SELECT row_id, round(w / 7, 3) AS v FROM kw"

# --- JSON, dates, classification ------------------------------------------------------------------------------------
_S["g4_offer_json"] = "SELECT event_id, CAST(JSON_GET(props, '$.k') AS BIGINT) AS k, JSON_GET(props, '$.absent') IS NOT NULL AS has_discount FROM status_log"
_S["g7_url_list"] = "SELECT q, LIST_JOIN(LIST_SORT(COLLECT(url)), '|') AS urls FROM serp WHERE position <= 20 GROUP BY q"
_S["t1_ttl"] = "SELECT event_id, updated_at >= TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 30 DAYS AS fresh FROM status_log"
_S["c7_domain_adjustment"] = "SELECT row_id, CASE WHEN m / 20 >= 0.6e0 THEN 'commercial' WHEN 1 - m / 20 >= 0.6e0 THEN 'informational' ELSE main_intent END AS intent, round(greatest(m / 20, 1 - m / 20) * 10, 6) AS score FROM kw"
_S["c13_page_type"] = "SELECT row_id, CASE WHEN main_intent = 'informational' THEN 'article' WHEN brand > 0 AND main_intent LIKE 'commercial%' THEN 'product' WHEN main_intent LIKE 'commercial%' THEN CASE WHEN w > 700 THEN 'category' ELSE 'filter' END WHEN main_intent = 'navigational' THEN 'main' ELSE 'other' END AS page_type FROM kw"
# Two keywords are compatible if they are in one class, named by its least row_id; a keyword without a cluster is in none.
_S["c22_geo_compatible"] = "SELECT k.row_id, k.cluster_id, k.geo, c.class FROM kw k JOIN (SELECT cluster_id, geo, min(row_id) AS class FROM kw GROUP BY cluster_id, geo) c ON c.cluster_id = k.cluster_id AND c.geo IS NOT DISTINCT FROM k.geo"
# Of links equally strong, those by URLs come first.
_S["c27_related_clusters"] = f"""WITH {_CLUSTER_LINKS}, {_WORD_LINKS}, links AS (SELECT c1, c2, strength, 0 AS kind FROM linked UNION ALL SELECT c1, c2, words AS strength, 1 AS kind FROM worded),
  p AS (SELECT c1, c2, strength, kind FROM links UNION ALL SELECT c2 AS c1, c1 AS c2, strength, kind FROM links)
  SELECT c1, c2, strength FROM (SELECT *, row_number() OVER (PARTITION BY c1 ORDER BY strength DESC, kind, c2) AS r FROM p) x WHERE r <= 5"""
_S["l2_overlaps_in_clusters"] = f"WITH p AS ({_PAIRS}) SELECT q1, q2, common FROM p WHERE q1 % 40 = q2 % 40"
_S["l7_renumber"] = "SELECT row_id, CAST(dense_rank() OVER (ORDER BY cluster_id) AS BIGINT) AS cluster_number FROM kw"
_S["l19_graph_statistics"] = "WITH n AS (SELECT src AS x FROM edges UNION SELECT dst FROM edges) SELECT (SELECT count(*) FROM n) AS nodes, count(*) AS links, round(2e0 * count(*) / ((SELECT count(*) FROM n) * ((SELECT count(*) FROM n) - 1e0)), 8) AS density FROM edges"
_S["l19_degrees"] = "SELECT x AS node, count(*) AS degree FROM (SELECT src AS x FROM edges UNION ALL SELECT dst FROM edges) y GROUP BY x"

# --- Small operators -------------------------------------------------------------------------------------------------
_S["z2_ads_statistics"] = "SELECT count_if(shows > 0) AS enriched, sum(shows) AS shows, sum(clicks) AS clicks, round(avg(CASE WHEN cpc > 0 THEN cpc END), 4) AS mean_cpc FROM ads"
_S["z3_preload_batches"] = "SELECT row_id, CAST(floor((r - 1) / 100e0) AS BIGINT) AS batch FROM (SELECT row_id, row_number() OVER (ORDER BY row_id) AS r FROM kw WHERE LIST_SIZE(SPLIT_RX(keyword, ' +')) <= 6) x"
_S["z4_route_rows"] = "SELECT event_id, CASE WHEN found IS NOT NULL THEN 'local' WHEN req_id IS NOT NULL AND updated_at >= TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 10 MINUTES THEN 'request' ELSE 'api' END AS route FROM status_log"
_S["z7_domain_observations"] = "SELECT domain, count(*) AS n, CAST(sum(CASE WHEN main_intent LIKE 'commercial%' OR cs >= 5 THEN 1 ELSE 0 END) AS BIGINT) AS commercial FROM serp s JOIN kw k ON k.row_id = s.q GROUP BY domain"
_S["z8_completed_by_day"] = "SELECT CAST(CAST(updated_at AS DATE) AS STRING) AS day, count(*) AS n FROM status_log WHERE status = 'completed' GROUP BY CAST(updated_at AS DATE)"
_S["z9_latest_lengths"] = "SELECT event_id, length(props) AS n FROM status_log ORDER BY updated_at DESC, event_id LIMIT 10"
_S["z10_processing_empty"] = "SELECT event_id FROM status_log WHERE status = 'processing' AND req_id IS NULL"
_S["z11_stuck_reset"] = "SELECT event_id, CASE WHEN status = 'processing' AND updated_at < TIMESTAMP '2024-01-15 00:00:00' THEN 'pending' ELSE status END AS status FROM status_log"
_S["z12_failed_reset"] = "SELECT event_id, CASE WHEN status = 'error' AND message IS NULL THEN 'pending' ELSE status END AS status FROM status_log"
_S["z20_duplicate_listing"] = "SELECT keyword, LIST_JOIN(LIST_SORT(COLLECT(CAST(row_id AS STRING))), ',') AS ids FROM kw GROUP BY keyword HAVING count(*) > 1"
_S["z22_classifier_counters"] = "SELECT CASE WHEN offers > 280 THEN 'commercial' ELSE 'informational' END AS class, count(*) AS n FROM domains GROUP BY CASE WHEN offers > 280 THEN 'commercial' ELSE 'informational' END"
_S["z23_cluster_tree"] = "SELECT cluster_id, main_intent, count(*) AS n, round(avg(w), 4) AS mean FROM kw GROUP BY cluster_id, main_intent"
_S["z25_restore"] = "SELECT k.row_id, coalesce(a.cpc, o.cpc, 0e0) AS cpc FROM kw k LEFT JOIN (SELECT row_id, cpc FROM ads WHERE row_id % 2 = 0) a ON a.row_id = k.row_id LEFT JOIN (SELECT row_id, cpc FROM ads WHERE row_id % 3 = 0) o ON o.row_id = k.row_id"
_S["k3_cluster_csv"] = "SELECT cluster_id, count(*) AS n, min_by(keyword, row_id) AS first_keyword, CAST(sum(frequency_world) AS BIGINT) AS total FROM kw GROUP BY cluster_id"
_S["k18_coalescing_upsert"] = "SELECT coalesce(n.row_id, o.row_id) AS row_id, coalesce(nullif(n.cpc, 0e0), o.cpc) AS cpc FROM (SELECT row_id, cpc FROM ads WHERE row_id % 2 = 0) n FULL JOIN (SELECT row_id, shows AS cpc FROM ads WHERE row_id % 3 = 0) o ON n.row_id = o.row_id"
_S["k24_round_stored"] = "SELECT row_id, round(w / 3, 3) AS w, round(e / 3, 3) AS e FROM kw"
_S["flagship"] = f"""WITH s AS ({_SIGNED}), g AS (SELECT *, max(frequency_exact) OVER (PARTITION BY signature) AS top FROM s), k AS (SELECT b.* FROM kw b JOIN g ON g.row_id = b.row_id WHERE g.frequency_exact = g.top AND b.e > 0 AND b.w <= 51 * b.e)
  SELECT row_id, keyword, round({METRICS['kei_standard']}, 6) AS kei_standard, round({METRICS['kei_effectiveness']}, 6) AS kei_effectiveness, round({METRICS['ctr_potential']}, 6) AS ctr_potential FROM k ORDER BY kei_effectiveness DESC, row_id LIMIT 20"""
