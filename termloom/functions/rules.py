"""Rules on keywords and frequencies as column functions. All limits and word lists are parameters."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits and points of the difficulty score, words of the funnel's stages, patterns of structures and
# modifiers, weights of intents, factors of positions.
FREQUENCY_BANDS = ((10_000, 40), (5_000, 30), (1_000, 20), (100, 10))
LEVELS = ((75, "very_hard"), (60, "hard"), (40, "medium"), (20, "easy"))
FUNNEL = (
    ("Awareness", 5, ("что такое", "расшифровка", "определение")),
    ("Interest", 4, ("виды", "как работает", "принцип")),
    ("Consideration", 3, ("обзор", "сравнение", "отзывы")),
    ("Intent", 2, ("цена", "стоимость")),
    ("Purchase", 1, ("купить", "заказать")),
)
ACTIONS, QUESTIONS = ("купить", "заказать"), ("как", "где", "что")
STRUCTURES = (
    ("action_product", r"^({actions})\s+[а-яё\s-]+"),
    ("question", r"^({questions})\s+"),
    ("comparison", r"(или|vs|против|сравнение|отличи)"),
    ("product_price", r"[а-яё\s-]+\s+(цена|стоимость|прайс)"),
    ("product_modifier", r"[а-яё\s-]+\s+[а-яё]+"),
    ("product_city", r"[а-яё\s-]+\s+[а-яё]+"),
    ("product", r"^[а-яё\s-]+$"),
)
MODIFIERS = (
    ("price", ("дешево", "дорого", "недорого", "цена", "стоимость", "премиум", "бюджетн")),
    ("quality", ("лучший", "качественный", "надежный", "проверенный", "профессиональн")),
    ("time", ("срочно", "быстро", "экспресс", "немедленно", "сегодня", "завтра")),
    ("location", ("рядом", "около", "близко", "метро", "район")),
    ("format", ("опт", "оптом", "розница", "б/у", "новый", "подержанн")),
)
INTENT_WEIGHTS = {"commercial": 3.0, "informational": 4.0, "navigational": 4.0}
POSITION_FACTORS = {1: 1.0, 2: 0.75, 3: 0.60, 4: 0.45, 5: 0.35, 6: 0.25, 7: 0.18, 8: 0.12, 9: 0.08, 10: 0.05}


def any_of(words: Iterable[str], whole: bool = False) -> str:
    """A pattern that any of the words matches, longer ones first; `whole`: not inside a longer word."""
    body = "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))
    return rf"(?U)\b({body})\b" if whole else f"({body})"


def contains_any(text: Column, words: Iterable[str]) -> Column:
    words = tuple(words)
    return text.rlike(any_of(words)) if words else F.lit(False)


def difficulty_score(w: Column, e: Column, words: Column, commercial: Column, brand: Column) -> Column:
    """0 to 100: points of the frequency's band, 20 times the exact share, points for few words, and for commerce and brands."""
    points = F.lit(5.0)
    for limit, gain in sorted(FREQUENCY_BANDS):
        points = F.when(w > limit, float(gain)).otherwise(points)
    share = F.when(e > 0, 20 * e / F.greatest(w, F.lit(1.0))).otherwise(0.0)
    length = F.when(words == 1, 20.0).when(words == 2, 10.0).when(words >= 5, -10.0).otherwise(0.0)
    total = points + share + length + F.when(commercial, 15.0).otherwise(0.0) + F.when(brand, 10.0).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), total))


def difficulty_level(score: Column) -> Column:
    level = F.lit("very_easy")
    for limit, name in sorted(LEVELS):
        level = F.when(score >= limit, name).otherwise(level)
    return level


def strategy(w: Column, e: Column, commercial: Column) -> Column:
    """The first that fits of five ways to promote a keyword."""
    return (
        F.when(w.between(100, 1000) & (e < 50), "quick_wins").when(w < 100, "long_tail").when((w > 5000) & (e > 500), "competitive")
        .when(~commercial & (e < 100), "informational_easy").otherwise("medium")
    )


def funnel_scores(keyword: Column, stages=FUNNEL) -> dict[str, Column]:
    """Each stage's weight for every one of its phrases that is in the keyword."""
    low = F.lower(keyword)
    return {name: sum((F.when(low.contains(p), float(weight)).otherwise(0.0) for p in phrases), F.lit(0.0)) for name, weight, phrases in stages}


def funnel_stage(keyword: Column, stages=FUNNEL) -> Column:
    """struct(stage, confidence): the first stage of the highest score; without any, Interest and 0.3."""
    scores = funnel_scores(keyword, stages)
    top = F.greatest(*scores.values())
    name = F.coalesce(*[F.when(s == top, n) for n, s in scores.items()])
    return F.struct(F.when(top == 0, "Interest").otherwise(name).alias("stage"), F.when(top == 0, 0.3).otherwise(F.least(top / 10, F.lit(1.0))).alias("confidence"))


def structure_pattern(keyword: Column, actions: Iterable[str] = ACTIONS, questions: Iterable[str] = QUESTIONS) -> Column:
    """The first structure whose pattern is in the trimmed lower-case keyword, else other."""
    low = F.lower(F.trim(keyword))
    out = F.lit("other")
    for name, pattern in reversed(STRUCTURES):
        out = F.when(low.rlike(pattern.format(actions="|".join(map(re.escape, actions)), questions="|".join(map(re.escape, questions)))), name).otherwise(out)
    return out


def structure_flags(keyword: Column, actions: Iterable[str] = (), questions: Iterable[str] = ()) -> dict[str, Column]:
    low = F.lower(keyword)
    return {
        "has_action": contains_any(low, actions), "has_question": contains_any(low, questions), "has_price": low.rlike("цена|стоимость|прайс"),
        "has_comparison": low.rlike("или|vs|против|сравнение"), "has_modifier": low.rlike("дешево|дорого|качественн|лучш"),
    }


def modifier_classes(keyword: Column, modifiers=MODIFIERS) -> Column:
    """The classes with a word in the keyword, or no_modifier."""
    low = F.lower(keyword)
    found = F.array_compact(F.array(*[F.when(contains_any(low, words), name) for name, words in modifiers]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("no_modifier")))


def intent_scores(keyword: Column, commercial: Iterable[str], informational: Iterable[str], navigational: Iterable[str], weights: dict[str, float] = INTENT_WEIGHTS) -> dict[str, Column]:
    """Matches of whole words, longer entries first and without overlap, times the class's weight; informational ones
    count a further three quarters."""
    low = F.lower(keyword)
    out = {}
    for name, words, factor in (("commercial", commercial, 1.0), ("informational", informational, 1.75), ("navigational", navigational, 1.0)):
        words = tuple(words)
        found = F.size(F.regexp_extract_all(low, F.lit(any_of(words, whole=True)), F.lit(0))) if words else F.lit(0)
        out[name] = found * (weights[name] * factor)
    return out


def main_intent(scores: dict[str, Column], has_geo: Column) -> Column:
    """struct(intent, score): the first of the highest score; without any, informational and 1. With a place the first two
    classes end in _geo."""
    c, i, n = scores["commercial"], scores["informational"], scores["navigational"]
    top = F.greatest(c, i, n)
    name = F.when(top == 0, "informational").when(c == top, "commercial").when(i == top, "informational").otherwise("navigational")
    suffix = F.when(has_geo & (name != "navigational"), "_geo").otherwise("")
    return F.struct(F.concat(name, suffix).alias("intent"), F.when(top == 0, 1.0).otherwise(top).alias("score"))


def content_intent(text: Column, commercial: Iterable[str], informational: Iterable[str]) -> Column:
    """struct(commercial, informational, intent, confidence) by the words of a text that contain an entry; ties and none
    are commercial with 0.5."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    count = lambda entries: F.size(F.filter(words, lambda w: contains_any(w, entries)))
    c, i = count(tuple(commercial)), count(tuple(informational))
    intent = F.when(i > c, "informational").otherwise("commercial")
    confidence = F.when(c == i, 0.5).otherwise(F.greatest(c, i) / (c + i))
    return F.struct(c.alias("commercial"), i.alias("informational"), intent.alias("intent"), confidence.alias("confidence"))


def intent_override(keyword: Column, commercial: Iterable[str], serp_intent: Column, current: Column) -> Column:
    """A commercial word decides; else the result page's intent; else what is there. A place in the current one stays."""
    geo = F.when(current.endswith("_geo"), "_geo").otherwise("")
    base = F.when(contains_any(F.lower(keyword), commercial), "commercial").otherwise(serp_intent)
    return F.when(base.isNotNull(), F.concat(base, geo)).otherwise(current)


def recalculated(current: Column, c_score: Column, i_score: Column, serp_intent: Column, c_share: Column, i_share: Column, limit: float = 0.6) -> Column:
    """struct(intent, commercial, informational) when result pages arrive: their intent first (the other score is halved),
    else the share of domains against the present intent, else whichever share reaches the limit."""
    c, i = c_share * 10, i_share * 10
    row = lambda intent, x, y: F.struct(intent.alias("intent"), x.cast("double").alias("commercial"), y.cast("double").alias("informational"))
    to_c, to_i = (current == "informational") & (c_share >= limit), (current == "commercial") & (i_share >= limit)
    return (
        F.when(serp_intent == "commercial", row(serp_intent, F.greatest(c_score, c), i_score * 0.5))
        .when(serp_intent == "informational", row(serp_intent, c_score * 0.5, F.greatest(i_score, i)))
        .when(to_c, row(F.lit("commercial"), c, i_score * 0.5)).when(to_i, row(F.lit("informational"), c_score * 0.5, i))
        .when(current == "commercial_geo", row(current, F.greatest(c_score, c), i_score)).when(current == "informational_geo", row(current, c_score, F.greatest(i_score, i)))
        .when(current.isNotNull(), row(current, F.greatest(c_score, c), F.greatest(i_score, i)))
        .otherwise(row(F.when((c_share < limit) & (i_share >= limit), "informational").otherwise("commercial"), c, i))
    )


def brand_query_type(keyword: Column, has_brand: Column, commercial: Iterable[str], informational: Iterable[str], navigational: Iterable[str] = ("сайт", "официальный", "контакты")) -> Column:
    low = F.lower(keyword)
    kinds = (("brand_commercial", commercial), ("brand_info", informational), ("brand_navigational", navigational))
    out = F.when(keyword.rlike(r"\d"), "brand_model").otherwise("brand_pure")
    for name, words in reversed(kinds):
        out = F.when(contains_any(low, words), name).otherwise(out)
    return F.when(has_brand, out).otherwise("non_brand")


def traffic_at_position(shows: Column, premium_ctr: Column, position: Column) -> Column:
    """Shows times click rate times the position's factor; positions beyond the table count as the third."""
    factor = F.coalesce(*[F.when(position == p, f) for p, f in POSITION_FACTORS.items()], F.lit(POSITION_FACTORS[3]))
    return shows * premium_ctr * factor / 100


def geo_extract(keyword: Column, cities: dict[str, str], moscow: Iterable[str], countries: dict[str, Iterable[str]], regions: Iterable[str]) -> Column:
    """struct(type, country, city, location) by dictionaries in order: cities (form to name), forms of Moscow, countries
    by their places, other regions. Whole words, longer entries first. All null without a match."""
    low, text = F.lower(keyword), lambda x: F.lit(x).cast("string")
    first = lambda words: F.nullif(F.regexp_extract(low, any_of(words, whole=True), 1), F.lit("")) if words else text(None)
    row = lambda kind, country, city, place: F.struct(text(kind).alias("type"), text(country).alias("country"), city.cast("string").alias("city"), place.alias("location"))
    city, capital, region = first(tuple(cities)), first(tuple(moscow)), first(tuple(regions))
    name = F.coalesce(F.create_map(*[F.lit(x) for pair in cities.items() for x in pair])[city], city) if cities else city
    out = F.when(city.isNotNull(), row("city", "Russia", name, name)).when(capital.isNotNull(), row("city", "Russia", F.lit("Москва"), capital))
    for country, places in countries.items():
        place = first(tuple(places))
        out = out.when(place.isNotNull(), row("country", country, text(None), place))
    return out.when(region.isNotNull(), row("region", None, text(None), region))
