"""DuckDB SQL of the queries in rules.py, written from the operators' descriptions and for DuckDB alone."""

from __future__ import annotations

from .dialect import spell, with_roles
from .roles import ROLES, used
from .rules import LINKS, PHRASES

SQL: dict[str, str] = {}
_WORDS = "len(string_split_regex(keyword, ' +'))"
_SCORE = f"""greatest(0, least(100, (CASE WHEN w > 10000 THEN 40 WHEN w > 5000 THEN 30 WHEN w > 1000 THEN 20 WHEN w > 100 THEN 10 ELSE 5 END)
  + (CASE WHEN e > 0 THEN 20 * e / greatest(w, 1) ELSE 0 END) + (CASE {_WORDS} WHEN 1 THEN 20 WHEN 2 THEN 10 WHEN 3 THEN 0 WHEN 4 THEN 0 ELSE -10 END)
  + (CASE WHEN commercial THEN 15 ELSE 0 END) + (CASE WHEN brand THEN 10 ELSE 0 END)))"""
_STRATEGY = """CASE WHEN w >= 100 AND w <= 1000 AND e < 50 THEN 'quick_wins' WHEN w < 100 THEN 'long_tail' WHEN w > 5000 AND e > 500 THEN 'competitive'
  WHEN NOT commercial AND e < 100 THEN 'informational_easy' ELSE 'medium' END"""
SQL["m25_difficulty_score"] = f"SELECT row_id, round({_SCORE}, 6) AS v FROM phrases"
SQL["m26_difficulty_level"] = f"""SELECT row_id, CASE WHEN v < 20 THEN 'very_easy' WHEN v < 40 THEN 'easy' WHEN v < 60 THEN 'medium' WHEN v < 75 THEN 'hard' ELSE 'very_hard' END AS level
  FROM (SELECT row_id, round({_SCORE}, 6) AS v FROM phrases) x"""
SQL["m27_strategy"] = f"SELECT row_id, {_STRATEGY} AS strategy FROM phrases"
SQL["o4_opportunities"] = f"SELECT row_id, w, round({_SCORE}, 6) AS v FROM phrases WHERE {_STRATEGY} = 'quick_wins' ORDER BY w DESC, v, row_id LIMIT 50"
SQL["c12_funnel_stage"] = """WITH hits AS (
  SELECT row_id, r.stage, r.o, r.weight FROM phrases, (VALUES ('Awareness', 1, 5, 'что такое'), ('Awareness', 1, 5, 'расшифровка'), ('Awareness', 1, 5, 'определение'), ('Interest', 2, 4, 'виды'), ('Interest', 2, 4, 'как работает'),
    ('Interest', 2, 4, 'принцип'), ('Consideration', 3, 3, 'обзор'), ('Consideration', 3, 3, 'сравнение'), ('Consideration', 3, 3, 'отзывы'), ('Intent', 4, 2, 'цена'), ('Intent', 4, 2, 'стоимость'),
    ('Purchase', 5, 1, 'купить'), ('Purchase', 5, 1, 'заказать')) r(stage, o, weight, word) WHERE contains(keyword, r.word)),
  scored AS (SELECT row_id, stage, o, sum(weight) AS s FROM hits GROUP BY row_id, stage, o),
  best AS (SELECT row_id, stage, s FROM scored QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY s DESC, o) = 1)
  SELECT p.row_id, coalesce(stage, 'Interest') AS stage, CASE WHEN s IS NULL THEN 0.3e0 ELSE least(s / 10e0, 1e0) END AS confidence FROM phrases p LEFT JOIN best b ON b.row_id = p.row_id"""
SQL["c18_structure_pattern"] = r"""SELECT row_id, CASE WHEN regexp_matches(keyword, '^(купить|заказать)\s+[а-яё\s-]+') THEN 'action_product' WHEN regexp_matches(keyword, '^(как|где|что)\s+') THEN 'question'
  WHEN regexp_matches(keyword, 'или|vs|против|сравнение|отличи') THEN 'comparison' WHEN regexp_matches(keyword, '[а-яё\s-]+\s+(цена|стоимость|прайс)') THEN 'product_price'
  WHEN regexp_matches(keyword, '[а-яё\s-]+\s+[а-яё]+') THEN 'product_modifier' WHEN regexp_matches(keyword, '^[а-яё\s-]+$') THEN 'product' ELSE 'other' END AS pattern FROM phrases"""
_HAS = "(len(list_filter([{0}], lambda x: contains(keyword, x))) > 0)"
_COMM, _INFO, _NAVI = "'купить', 'заказать', 'цена', 'опт'", "'что', 'как', 'обзор', 'что такое'", "'сайт', 'wilo'"
SQL["c19_structure_flags"] = f"""SELECT row_id, {_HAS.format(_COMM)} AS has_action, {_HAS.format(_INFO)} AS has_question, {_HAS.format("'цена', 'стоимость', 'прайс'")} AS has_price,
  {_HAS.format("'или', 'vs', 'против', 'сравнение'")} AS has_comparison, {_HAS.format("'дешево', 'дорого', 'качественн', 'лучш'")} AS has_modifier FROM phrases"""
SQL["c20_modifiers"] = f"""WITH m AS (SELECT row_id, unnest([CASE WHEN {_HAS.format("'дешево', 'дорого', 'цена', 'стоимость', 'премиум', 'бюджетн'")} THEN 'price' END, CASE WHEN {_HAS.format("'лучший', 'качественный', 'надежный', 'проверенный', 'профессиональн'")} THEN 'quality' END,
  CASE WHEN {_HAS.format("'срочно', 'быстро', 'экспресс', 'немедленно', 'сегодня', 'завтра'")} THEN 'time' END, CASE WHEN {_HAS.format("'рядом', 'около', 'близко', 'метро', 'район'")} THEN 'location' END,
  CASE WHEN {_HAS.format("'опт', 'розница', 'б/у', 'новый', 'подержанн'")} THEN 'format' END]) AS modifier FROM phrases), f AS (SELECT * FROM m WHERE modifier IS NOT NULL)
  SELECT row_id, modifier FROM f UNION ALL SELECT row_id, 'no_modifier' AS modifier FROM phrases WHERE row_id NOT IN (SELECT row_id FROM f)"""
# Words stand between spaces, so a whole word is one of the split ones; 'что такое' is taken before 'что'.
_IS = "len(list_filter(string_split(keyword, ' '), lambda x: x IN ({0})))"
_I = f"({_IS.format("'что', 'как', 'обзор'")})"
SQL["c1_intent_scores"] = f"SELECT row_id, {_IS.format(_COMM)} * 3e0 AS commercial, {_I} * 7e0 AS informational, {_IS.format(_NAVI)} * 4e0 AS navigational FROM phrases"
SQL["c2_main_intent"] = f"""SELECT row_id, CASE WHEN c + i + n = 0 THEN 'informational' || g WHEN c >= i AND c >= n THEN 'commercial' || g WHEN i >= n THEN 'informational' || g ELSE 'navigational' END AS intent,
  CASE WHEN c + i + n = 0 THEN 1e0 ELSE greatest(c, i, n) END AS score FROM (SELECT row_id, {_IS.format(_COMM)} * 3e0 AS c, {_I} * 7e0 AS i, {_IS.format(_NAVI)} * 4e0 AS n, CASE WHEN geo IS NULL THEN '' ELSE '_geo' END AS g FROM phrases) x"""
SQL["c3_flags"] = f"SELECT row_id, {_HAS.format(_COMM)} AS is_commercial, {_HAS.format(_INFO)} AS is_informational, {_HAS.format(_NAVI)} AS is_navigational FROM phrases"
SQL["c4_geo_extract"] = """SELECT row_id, CASE WHEN row_id % 3 > 0 THEN 'city' WHEN k OR b THEN 'country' WHEN r THEN 'region' END AS kind, CASE WHEN row_id % 3 > 0 THEN 'Russia' WHEN k THEN 'Kazakhstan' WHEN b THEN 'Belarus' END AS country,
  CASE row_id % 3 WHEN 1 THEN 'Тверь' WHEN 2 THEN 'Москва' END AS city, CASE WHEN row_id % 3 = 1 THEN 'Тверь' WHEN row_id % 3 = 2 THEN 'мск' WHEN k THEN 'труба' WHEN b THEN 'окон' WHEN r THEN 'арматура' END AS location
  FROM (SELECT row_id, contains(keyword, 'труба') AS k, contains(keyword, 'окон') AS b, contains(keyword, 'арматура') AS r FROM phrases) x"""
SQL["c6_override"] = """SELECT row_id, CASE WHEN contains(keyword, 'купить') OR contains(keyword, 'опт') OR m >= 14 THEN 'commercial' || g WHEN m <= 5 THEN 'informational' || g ELSE main_intent END AS intent
  FROM (SELECT *, CASE WHEN suffix(main_intent, '_geo') THEN '_geo' ELSE '' END AS g FROM phrases) x"""
SQL["c8_recalculated"] = """WITH x AS (SELECT row_id, CASE WHEN row_id % 7 > 0 THEN main_intent END AS now, t AS cs, 10 - t AS ins, CASE row_id % 5 WHEN 0 THEN 'commercial' WHEN 1 THEN 'informational' END AS serp, m / 20 AS c, 1 - m / 20 AS i FROM phrases),
  k AS (SELECT *, CASE WHEN serp IS NOT NULL THEN serp WHEN now = 'informational' AND c >= 0.6e0 THEN 'turn_c' WHEN now = 'commercial' AND i >= 0.6e0 THEN 'turn_i' WHEN now IS NULL THEN 'none' ELSE 'stay' END AS what FROM x)
  SELECT row_id, CASE what WHEN 'commercial' THEN 'commercial' WHEN 'informational' THEN 'informational' WHEN 'turn_c' THEN 'commercial' WHEN 'turn_i' THEN 'informational' WHEN 'stay' THEN now ELSE CASE WHEN c < 0.6e0 AND i >= 0.6e0 THEN 'informational' ELSE 'commercial' END END AS intent,
    round(CASE what WHEN 'commercial' THEN greatest(cs, 10 * c) WHEN 'informational' THEN cs / 2 WHEN 'turn_c' THEN 10 * c WHEN 'turn_i' THEN cs / 2 WHEN 'stay' THEN CASE WHEN now = 'informational_geo' THEN cs ELSE greatest(cs, 10 * c) END ELSE 10 * c END, 6) AS commercial,
    round(CASE what WHEN 'commercial' THEN ins / 2 WHEN 'informational' THEN greatest(ins, 10 * i) WHEN 'turn_c' THEN ins / 2 WHEN 'turn_i' THEN 10 * i WHEN 'stay' THEN CASE WHEN now = 'commercial_geo' THEN ins ELSE greatest(ins, 10 * i) END ELSE 10 * i END, 6) AS informational FROM k"""
SQL["c9_content_intent"] = r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS w FROM texts),
  s AS (SELECT doc_id, count_if(contains(w, 'tion') OR contains(w, 'shop')) AS c, count_if(contains(w, 'ing') OR contains(w, 'heit')) AS i FROM w GROUP BY doc_id),
  a AS (SELECT t.doc_id, coalesce(c, 0) AS c, coalesce(i, 0) AS i FROM texts t LEFT JOIN s ON s.doc_id = t.doc_id)
  SELECT doc_id, c AS commercial, i AS informational, CASE WHEN i > c THEN 'informational' ELSE 'commercial' END AS intent, round(CASE WHEN c = i THEN 0.5e0 ELSE greatest(c, i) * 1e0 / (c + i) END, 6) AS confidence FROM a"""
SQL["c11_domain_intent"] = """WITH k AS (SELECT domain, max(class) AS class FROM links GROUP BY domain),
  s AS (SELECT q, round(count(*) FILTER (WHERE k.class = 'commercial') * 1e0 / count(*), 3) AS c, round(count(*) FILTER (WHERE k.class = 'informational') * 1e0 / count(*), 3) AS i FROM links l LEFT JOIN k ON k.domain = l.domain WHERE position <= 10 GROUP BY q)
  SELECT q, c AS commercial, i AS informational, CASE WHEN c >= 0.5e0 THEN 'commercial' WHEN i >= 0.5e0 THEN 'informational' ELSE 'unknown' END AS intent, CASE WHEN c >= 0.5e0 THEN c WHEN i >= 0.5e0 THEN i ELSE greatest(c, i) END AS confidence FROM s"""
SQL["c16_brand_query_type"] = f"""SELECT row_id, CASE WHEN NOT brand THEN 'non_brand' WHEN {_HAS.format(_COMM)} THEN 'brand_commercial' WHEN {_HAS.format(_INFO)} THEN 'brand_info'
  WHEN {_HAS.format("'сайт', 'официальный', 'контакты'")} THEN 'brand_navigational' WHEN regexp_matches(keyword, '[0-9]') THEN 'brand_model' ELSE 'brand_pure' END AS kind FROM phrases"""
SQL["c23_majority_apart"] = """SELECT a.row_id FROM phrases a JOIN phrases b ON a.row_id // 4 = b.row_id // 4 AND a.row_id <> b.row_id GROUP BY a.row_id HAVING avg(CASE WHEN a.geo IS DISTINCT FROM b.geo THEN 1e0 ELSE 0e0 END) > 0.5e0"""
SQL["m21_traffic_at_position"] = "SELECT row_id, round(shows * premium_ctr * (CASE position WHEN 1 THEN 1e0 WHEN 2 THEN 0.75e0 WHEN 4 THEN 0.45e0 WHEN 5 THEN 0.35e0 WHEN 6 THEN 0.25e0 WHEN 7 THEN 0.18e0 WHEN 8 THEN 0.12e0 WHEN 9 THEN 0.08e0 WHEN 10 THEN 0.05e0 ELSE 0.6e0 END) / 100, 6) AS v FROM ads"
SQL["m19_missing_serp_defaults"] = "SELECT row_id, 1000 * w AS d, m, 15e0 AS t FROM phrases"
SQL["a25_cluster_summary"] = """SELECT cluster_id, count(*) AS n, CAST(trunc(sum(w)) AS BIGINT) AS total, round(avg(w), 4) AS mean, any_value(main_keyword) AS main_keyword
  FROM (SELECT *, first_value(keyword) OVER (PARTITION BY cluster_id ORDER BY w DESC, row_id) AS main_keyword FROM phrases) x GROUP BY cluster_id"""
SQL["k16_adjacency"] = "SELECT node, other, count(*) AS links FROM (SELECT src AS node, dst AS other FROM edges UNION ALL SELECT dst, src FROM edges) x GROUP BY node, other"
SQL["l19_node_features"] = """WITH b AS (SELECT src AS node, dst AS other FROM edges UNION ALL SELECT dst, src FROM edges)
  SELECT node, count(DISTINCT other) AS degree, count(*) * 1e0 AS weighted_degree, round(count(DISTINCT other) * 1e0 / ((SELECT count(DISTINCT node) FROM b) - 1), 6) AS share FROM b GROUP BY node"""
_STOPPED = "list_filter(string_split(keyword, ' '), lambda x: x IN ('купить', 'wilo', 'опт'))"
SQL["f1_stop_word_filter"] = f"SELECT row_id, keyword FROM phrases WHERE len({_STOPPED}) = 0"
SQL["f1_blocked_rows"] = f"SELECT row_id, keyword, {_STOPPED}[1] AS found FROM phrases WHERE len({_STOPPED}) > 0"
SQL["f3_low_frequency"] = "SELECT row_id, keyword, frequency_world FROM kw WHERE NOT frequency_world < 1"
SQL["f4_frequency_ratio"] = "SELECT row_id, keyword, w2 AS frequency_world, frequency_exact FROM (SELECT *, frequency_world * (1 + row_id % 97) AS w2 FROM kw) x WHERE frequency_exact > 0 AND w2 / frequency_exact <= 51"
SQL["f5_short_queries"] = "SELECT row_id, k AS keyword FROM (SELECT row_id, CASE WHEN row_id % 9 = 0 THEN left(keyword, 1) ELSE keyword END AS k FROM kw) x WHERE length(k) > 1"
SQL["f7_stop_domain_filter"] = """WITH h AS (SELECT q, u, CASE WHEN u % 2 = 0 THEN 'www.' || domain WHEN u % 3 = 0 THEN 'm.' || domain ELSE domain END AS domain FROM serp)
  SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM (VALUES ('site3.example.com'), ('site7.example.com'), ('site9.example.com')) s(d) WHERE h.domain = s.d OR suffix(h.domain, '.' || s.d))"""
_LEMMA = "CASE x WHEN 'насосы' THEN 'насос' WHEN 'трубы' THEN 'труба' WHEN 'трубу' THEN 'труба' WHEN 'окон' THEN 'окно' WHEN 'двери' THEN 'дверь' WHEN 'цены' THEN 'цена' ELSE x END"
_LEMMATISED = f"list_transform(list_filter(string_split(keyword, ' '), lambda x: length(x) > 1), lambda x: {_LEMMA})"
SQL["x3_lemmatise"] = f"SELECT row_id, array_to_string({_LEMMATISED}, ' ') AS lemmas, array_to_string(list_sort({_LEMMATISED}), ' ') AS normalized FROM phrases"
SQL["f2_expanded_stop_words"] = "SELECT unnest(['трубы', 'трубу', 'цены', 'цена', 'wilo']) AS word"
SQL["j18_city_names"] = "SELECT row_id, CASE geo WHEN 'москва' THEN 'Москва' WHEN 'тверь' THEN 'Тверь' ELSE 'Санкт-Петербург' END AS city FROM phrases"
SQL["j14_domain_priority"] = """WITH o AS (SELECT domain || '.example.com' AS domain, CASE WHEN offers > 30 THEN 'commercial' ELSE 'informational' END AS class FROM domains WHERE total_docs >= 750)
  SELECT DISTINCT s.domain, CASE WHEN o.domain IS NOT NULL THEN o.class WHEN s.domain IN ('site1.example.com', 'site5.example.com') THEN 'commercial' WHEN s.domain = 'site2.example.com' THEN 'informational' ELSE 'unknown' END AS class,
  CASE WHEN o.domain IS NOT NULL THEN 'database' WHEN s.domain IN ('site1.example.com', 'site5.example.com') THEN 'commercial_file' WHEN s.domain = 'site2.example.com' THEN 'informational_file' ELSE 'none' END AS source FROM serp s LEFT JOIN o ON o.domain = s.domain"""
SQL["j15_domain_priority_shared"] = """WITH o AS (SELECT domain || '.example.com' AS domain FROM domains WHERE offers * 1e0 / greatest(total_docs, 1) >= 0.45e0), s AS (SELECT DISTINCT domain FROM serp)
  SELECT domain, CASE WHEN domain = 'site1.example.com' THEN 'commercial' WHEN domain = 'site2.example.com' THEN 'informational' WHEN domain IN (SELECT domain FROM o) THEN 'commercial' ELSE 'unknown' END AS class,
  CASE WHEN domain = 'site1.example.com' THEN 'commercial_file' WHEN domain = 'site2.example.com' THEN 'informational_file' WHEN domain IN (SELECT domain FROM o) THEN 'global_cache' ELSE 'none' END AS source FROM s"""
SQL["j13_dictionary_semi_join"] = "SELECT row_id, keyword FROM phrases WHERE strpos(keyword, 'насос') > 0 OR strpos(keyword, 'камень') > 0 OR strpos(keyword, 'wilo') > 0"
SQL["w3_first_by_group"] = "SELECT DISTINCT ON (keyword) keyword, group_name, event_id FROM status_log ORDER BY keyword, group_name, event_id"
SQL["x6_signature_clean"] = r"SELECT doc_id, lower(trim(regexp_replace(regexp_replace(text, '[^а-яёА-ЯЁa-zA-Z0-9\s\v]', ' ', 'g'), '[\s\v]+', ' ', 'g'))) AS cleaned FROM texts"
SQL["x31_capped_list"] = "SELECT q, array_to_string(list_slice(list_sort(list(u)), 1, 5), ', ') AS urls FROM serp GROUP BY q"
SQL["u3_common_of_group"] = """WITH p AS (SELECT DISTINCT q // 2 AS c, q, u FROM serp) SELECT a.c, a.u FROM p a JOIN p b ON a.c = b.c AND a.u = b.u AND a.q < b.q"""
SQL["g1_normal_documents"] = """SELECT q, CAST(row_number() OVER (PARTITION BY q ORDER BY url) AS INTEGER) AS position, url, regexp_extract(lower(url), '//(?:www[.])?([^/]*)', 1) AS domain FROM serp"""
_FLAT = """WITH k AS (SELECT row_id, cluster_id AS cluster, keyword, string_split(keyword, ' ') AS w, frequency_world AS f FROM kw),
  flat AS (SELECT row_id, cluster, unnest(w) AS phrase, CAST(1 AS BIGINT) AS frequency, 'unknown' AS source FROM k WHERE row_id % 3 = 0
    UNION ALL SELECT row_id, cluster, keyword, f, 'title' FROM k WHERE row_id % 3 > 0 AND row_id % 7 > 0 UNION ALL SELECT row_id, cluster, w[1], f, 'snippet' FROM k WHERE row_id % 3 > 0 AND row_id % 7 > 0)"""
SQL["g2_normal_phrases"] = f"{_FLAT} SELECT row_id, phrase, frequency, source FROM flat"
SQL["f10_has_phrases"] = "SELECT row_id, row_id % 3 > 0 AND row_id % 7 > 0 AS valid FROM kw"
_GROUPED = f"""{_FLAT}, g AS (SELECT cluster, phrase, CAST(sum(frequency) AS BIGINT) AS frequency, count(*) AS queries_count FROM flat GROUP BY cluster, phrase),
  s AS (SELECT cluster, phrase, source FROM flat GROUP BY cluster, phrase, source QUALIFY row_number() OVER (PARTITION BY cluster, phrase ORDER BY count(*) DESC, source) = 1),
  a AS (SELECT g.*, s.source AS main_source, len(string_split(g.phrase, ' ')) AS n FROM g JOIN s ON s.cluster = g.cluster AND s.phrase = g.phrase)"""
SQL["a17_cluster_phrases"] = f"{_GROUPED} SELECT cluster, phrase, frequency, queries_count, main_source FROM a"
# No phrase of the test table has more than two words, so a word is tested against phrases of two, all of which stay.
_RANKED = f"""{_GROUPED}, kept AS (SELECT * FROM a WHERE n = 2 OR NOT EXISTS (SELECT 1 FROM a l WHERE l.cluster = a.cluster AND l.n = 2 AND contains(' ' || l.phrase || ' ', ' ' || a.phrase || ' ') AND a.frequency <= 2 * l.frequency)),
  r AS (SELECT cluster, phrase, frequency, queries_count, main_source, round(frequency * (1 + 0.1e0 * queries_count) * (1 + 0.3e0 * (n - 2)), 3) AS relevance, CAST(row_number() OVER (PARTITION BY cluster ORDER BY n DESC, frequency DESC, phrase) AS INTEGER) AS rank FROM kept)"""
SQL["c25_aggregate_phrases"] = f"{_RANKED} SELECT * FROM r WHERE rank <= 10"
SQL["z18_phrase_text"] = f"{_RANKED} SELECT cluster, string_agg(phrase, ', ' ORDER BY rank) AS text FROM r WHERE rank <= 30 GROUP BY cluster"
SQL["j5_phrases_of_results"] = f"{_FLAT}, u AS (SELECT q, count(*) AS urls FROM serp GROUP BY q) SELECT row_id, phrase, frequency, urls FROM flat JOIN u ON u.q = row_id"
SQL["k4_top_csv"] = "SELECT row_id, keyword, frequency_world FROM kw ORDER BY frequency_world DESC, row_id LIMIT 20"
SQL["k10_keyword_objects"] = """SELECT '{"row_id":' || row_id || ',"keyword":"' || keyword || '"' || CASE WHEN geo IS NULL THEN '' ELSE ',"geo":"' || geo || '"' END || '}' AS json FROM phrases"""
SQL["k19_update_intents"] = "SELECT row_id, CASE WHEN row_id % 2 = 0 THEN 'changed' ELSE main_intent END AS main_intent FROM phrases WHERE row_id % 3 > 0 OR row_id % 2 = 0"
SQL["k20_status_updates"] = "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'completed' ELSE status END AS status, req_id FROM status_log"
SQL["z1_cluster_report"] = """WITH s AS (SELECT cluster_id, u FROM serp JOIN kw ON row_id = q GROUP BY cluster_id, u HAVING count(DISTINCT q) > 1), p AS (SELECT cluster_id, count(*) AS popular_urls FROM s GROUP BY cluster_id)
  SELECT x.cluster_id, count(*) AS n, CAST(trunc(sum(w)) AS BIGINT) AS total, arg_min(keyword, r) AS main_keyword, coalesce(any_value(popular_urls), 0) AS popular_urls
  FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY w DESC, row_id) AS r FROM phrases) x LEFT JOIN p ON p.cluster_id = x.cluster_id GROUP BY x.cluster_id"""
SQL["z13_top_domains"] = "SELECT class, domain, count(*) AS n FROM links WHERE class IS NOT NULL GROUP BY class, domain QUALIFY row_number() OVER (PARTITION BY class ORDER BY count(*) DESC, domain) <= 30"
SQL["l20_graph_export"] = """WITH ends AS (SELECT src AS node, dst AS other FROM edges UNION ALL SELECT dst, src FROM edges), k AS (SELECT node, count(DISTINCT other) AS degree FROM ends GROUP BY node)
  SELECT 'nodes' AS part, concat('{"node":', node, ',"degree":', degree, '}') AS json FROM k UNION ALL SELECT 'edges', concat('{"src":', src, ',"dst":', dst, '}') FROM edges"""
SQL["z14_pages_of_query"] = "SELECT url, q, position FROM serp WHERE position < 4"
SQL["z19_ngram_set"] = "SELECT row_id, array_to_string(list_sort(list_distinct(list_concat(string_split(keyword, ' '), CASE WHEN contains(keyword, ' ') THEN [keyword] ELSE [] END))), '|') AS grams FROM kw"
_BEST = """WITH c AS (SELECT q, position, CASE u % 4 WHEN 1 THEN 2 WHEN 2 THEN 3 END AS n, CASE u % 4 WHEN 1 THEN 'Каталог > Раздел ' || (u % 10) WHEN 2 THEN 'Каталог > Трубы > Вид ' || (u % 10) END AS crumbs FROM serp),
  b AS (SELECT q, crumbs FROM c WHERE n IS NOT NULL QUALIFY row_number() OVER (PARTITION BY q ORDER BY n DESC, position) = 1)"""
SQL["w11_best_breadcrumbs"] = f"{_BEST} SELECT q, crumbs FROM b"
SQL["z15_unique_breadcrumbs"] = f"{_BEST} SELECT DISTINCT crumbs FROM b"


def oracle_sql() -> dict[str, str]:
    """The statements with what they read as common table expressions in front."""
    out = {}
    for name, text in SQL.items():
        own = {n: t for n, t in (("phrases", PHRASES), ("links", LINKS)) if n in used(text, ("phrases", "links"))}
        base = [n for n in ROLES if n in used(text + "".join(f" {t}" for t in own.values()), ROLES)]
        heads = {n: spell(ROLES[n], spark=False) for n in base} | own
        out[name] = with_roles(text, heads).replace(" AS STRING)", " AS VARCHAR)")
    return out
