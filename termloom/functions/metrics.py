"""Keyword metrics as named expressions over w, e (frequencies), d, m, t (result-page facts), cs, geo, brand.

All inputs are doubles; the small constants in denominators are part of the metrics' definitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METRICS = {
    "kei_standard": "(w / 2) * (w / 2) / (d + 1)",
    "kei_devaka": "(3 * e + w) / (w + 0.01e0)",
    "kei_base_exact_ratio": "w / (e + 0.01e0)",
    "kei_competition": "(1 + 2 * m + t) * (d / (e + 0.01e0)) / (1 + e / 12)",
    "kei_effectiveness": "(e / 12 + e) / (2 + m + t + 0.01e0)",
    "kei_coefficient": "e / (m + t + 1)",
    "kei_popularity": "(w + 2 * e) / 3",
    "kei_potential_traffic": "((e + 1e-4) / 12) * ((coalesce(ctr, 3e0) + 1e-4) / 100 + 0.1e0)",
    "kei_cost_per_visit": "(CASE WHEN coalesce(shows, 0e0) = 0 THEN e ELSE shows * ctr / 100 * cpc END + 1e-4) / (e + 0.01e0)",
    "kei_yandex_relevance": "(t / (m + 0.01e0)) * (e / (w + 0.01e0))",
    "ctr_potential": "100 * e / (w + 0.01e0)",
    "commercial_value": "w * (1 + cs / 10) * (1 + 0.5e0 * geo) * (1 + 0.3e0 * brand)",
    "traffic_potential": "w * (1 / (difficulty / 100 + 1)) * 0.3e0 * (100 - difficulty) / 100",
}
# Fixed values above and below: the formulas and defaults of the metrics.
#: Metrics made of those above.
DERIVED = {
    "kei_potential_revenue": "kei_potential_traffic * kei_cost_per_visit",
    "kei_synergy": "kei_effectiveness * kei_popularity / (kei_competition + 1)",
    "kei_effectiveness_coefficient": "kei_effectiveness * kei_effectiveness / (1 + kei_competition / 1000)",
}
#: Defaults of inputs that may be absent: result-page facts from the frequency, difficulty 50, no advertising figures.
DEFAULTS = {"d": "1000 * w", "m": "30e0", "t": "15e0", "cs": "0e0", "geo": "0e0", "brand": "0e0", "difficulty": "50e0", "shows": "0e0", "ctr": "cast(null as double)", "cpc": "0e0"}


def normalised(column: str) -> str:
    """0 to 100 by least and greatest value, given as lo_ and hi_ columns; 50 where all are equal."""
    return f"CASE WHEN hi_{column} = lo_{column} THEN 50e0 ELSE ({column} - lo_{column}) / (hi_{column} - lo_{column}) * 100 END"


def with_defaults(df: DataFrame, names: tuple[str, ...] = tuple(DEFAULTS)) -> DataFrame:
    """df with the columns of `names` that it hasn't got, by DEFAULTS; those it has stay as they are."""
    for name in names:
        if name not in df.columns:
            df = df.withColumn(name, F.expr(DEFAULTS[name]))
    return df


def calculate_all_metrics(df: DataFrame) -> DataFrame:
    """df with all metrics. Extremes come from one aggregate row joined to all, never from a window over everything."""
    df = with_defaults(df)
    df = df.select("*", *[F.expr(x).alias(n) for n, x in METRICS.items()])
    df = df.select("*", *[F.expr(x).alias(n) for n, x in DERIVED.items()])
    scaled = ("w", "cs", "kei_effectiveness")
    ends = df.agg(*[f(c).alias(f"{p}_{c}") for c in scaled for f, p in ((F.min, "lo"), (F.max, "hi"))])
    score = f"0.3e0 * ({normalised('w')}) + 0.25e0 * (100 - difficulty) + 0.25e0 * ({normalised('cs')}) + 0.2e0 * ({normalised('kei_effectiveness')})"
    return df.join(F.broadcast(ends)).withColumn("priority_score", F.expr(score)).drop(*[f"{p}_{c}" for c in scaled for p in ("lo", "hi")])
