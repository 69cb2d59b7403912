"""Toxic passages by maximum-scoring segments over token log-odds.

Training: log-odds of words between toxic and clean documents with an informative Dirichlet prior (the prior of a word
is its share of both classes together). Significant words are kept; words too rare to be significant on their own are
pooled by their first letters, so that inflected and compound forms of a toxic stem count as well. Every other token
has the pooled log-odds of the rest, which is negative.

Scan: Ruzzo and Tompa's linear-time scan gives all maximal-scoring segments of a document. A segment of score M in n
tokens is expected E = K n exp(-lambda M) times by chance in clean text; lambda solves the mean of exp(lambda s) = 1
over clean tokens, and K is fitted to the clean training documents. Segments of E below SIGNIFICANT are passages. The
largest segment's -ln E and the number of passages, through a logistic curve fitted to the training labels, give the
document's score.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Bounds of the fit: labelled documents (those with the least hash of their id), and entries of the model.
SAMPLE, TERMS = 20_000, 4_000
SIGNIFICANT = 1e-2
_TOKEN = re.compile(r"[^\W\d_]+")
_PREFIXES = (6, 5, 4)
#: Weight of the Dirichlet prior as a share of the counts, least z-score and log-odds of a term, least toxic documents it is in.
_PRIOR, _LEAST_Z, _LEAST_ODDS, _LEAST_DOCS = 0.01, 2.5, 2.0, 5


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


@dataclass(frozen=True)
class Model:
    """What the fit leaves: term and prefix weights, the score of other tokens, calibration. Its size is bounded by TERMS."""

    words: dict
    prefixes: dict
    other: float = -0.02
    decay: float = 1.0
    scale: float = 0.1
    curve: tuple = (-20.0, 0.0, 0.0)

    def weight(self, token: str) -> float:
        if token in self.words:
            return self.words[token]
        return next((self.prefixes[token[:k]] for k in _PREFIXES if len(token) > k and token[:k] in self.prefixes), 0.0)


class _Weights(dict):
    """Weights of the tokens met so far, forgotten when they become many."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, token: str) -> float:
        if len(self) > 100_000:
            self.clear()
        self[token] = w = self.model.weight(token)
        return w


def segments(hits: list[tuple[int, float]], other: float) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments (score, first token, token after the last), for tokens that score `other` except
    at hits. Each candidate keeps the sums before and after it; it is merged with those on its left as Ruzzo and Tompa
    prescribe, and one left out is never looked at again, so the time is linear in the hits."""
    out: list[tuple[float, float, int, int]] = []  # sum before, sum after, first, end
    total, end = 0.0, 0
    left: list[int] = []  # for each candidate, the nearest one on its left with a smaller sum before it
    for at, w in hits:
        before = total + other * (at - end)
        total, end = before + w, at + 1
        one = (before, total, at, end)
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][0] >= one[0]:
                j = left[j]
            if j < 0 or out[j][1] >= one[1]:
                out.append(one)
                left.append(j)
                break
            one = (out[j][0], one[1], out[j][2], one[3])
            del out[j:], left[j:]
    return [(r - b, first, stop) for b, r, first, stop in out]


def _hits(found: list[str], weights: _Weights) -> list[tuple[int, float]]:
    scores = np.fromiter(map(weights.__getitem__, found), float, len(found))
    return [(int(i), float(scores[i])) for i in np.flatnonzero(scores)]


def _evidence(model: Model, score: float, n: int) -> float:
    """-ln E of a segment in n tokens."""
    return model.decay * score - math.log(model.scale * max(n, 1))


def _features(found: list[str], model: Model, weights: _Weights) -> tuple[float, float]:
    """The largest segment's evidence (of a segment of score 0 without any) and ln(1 + number of passages)."""
    none = _evidence(model, 0.0, len(found))
    all_of = [_evidence(model, s, len(found)) for s, _, _ in segments(_hits(found, weights), model.other)]
    return max([none, *all_of]), math.log1p(sum(x >= -math.log(SIGNIFICANT) for x in all_of))


def score_column(text: Column, model: Model) -> Column:
    """The score of every whole text, 0 to 1. Null and empty texts score as texts without a toxic token."""

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights = _Weights(model)
        for part in parts:
            x = [_features(tokens(t if isinstance(t, str) else None), model, weights) for t in part]
            z = [model.curve[0] + model.curve[1] * a + model.curve[2] * b for a, b in x]
            yield pd.Series([1 / (1 + math.exp(-max(-40.0, min(40.0, v)))) for v in z], dtype=float)

    return score(text.cast("string"))


def passages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every significant toxic passage: doc_id, start and stop (code points of the text with letters lower-cased), score,
    e_value. Null and empty texts have none, an empty table gives no row, repeated rows and those without an id are read
    like others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = _Weights(model)
        for batch in batches:
            out = defaultdict(list)
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                low = (text or "").lower()
                hits = _hits(found := _TOKEN.findall(low), weights)
                at = [m.span() for m in _TOKEN.finditer(low)] if hits else []
                for s, first, stop in segments(hits, model.other):
                    if (x := _evidence(model, s, len(found))) >= -math.log(SIGNIFICANT):
                        for k, v in zip(("doc_id", "start", "stop", "score", "e_value"), (doc, at[first][0], at[stop - 1][1], s, math.exp(-x)), strict=True):
                            out[k].append(v)
            if out:
                yield pa.RecordBatch.from_pydict(dict(out))

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, start long, stop long, score double, e_value double")


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents and occurrences of every word by class; under '' those of the classes."""
    for batch in batches:
        df, tf = (Counter(), Counter()), (Counter(), Counter())
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = Counter(tokens(text))
            df[toxic].update(found.keys())
            df[toxic][""] += 1
            tf[toxic].update(found)
        words = list(df[0].keys() | df[1].keys())
        yield pa.RecordBatch.from_pydict({"word": words} | {f"{n}{k}": pa.array([c[k][w] for w in words], pa.int64()) for n, c in (("d", df), ("t", tf)) for k in (0, 1)})


def _significant(counts: DataFrame, mass: tuple[int, int]) -> DataFrame:
    """Terms with the log-odds and z-score that _LEAST_ODDS and _LEAST_Z ask for. Counts are of documents, so that one
    document that repeats a word counts once; mass: their sums over all words."""
    a = F.lit(_PRIOR) * (F.col("d0") + F.col("d1")) + 0.1
    odds = lambda k: F.log((F.col(f"d{k}") + a) / ((1 + _PRIOR) * (mass[k] + 1) - F.col(f"d{k}") + 0.1))
    rated = counts.withColumn("odds", odds(1) - odds(0)).withColumn("z", F.col("odds") / F.sqrt(1 / (F.col("d1") + a) + 1 / (F.col("d0") + a)))
    return rated.where((F.col("z") >= _LEAST_Z) & (F.col("odds") >= _LEAST_ODDS) & (F.col("d1") >= _LEAST_DOCS))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple:
    """Newton's method; the ridge keeps it finite where the classes are apart."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.clip(np.linalg.solve(h, x.T @ (y - p) - ridge * w), -5, 5)
    return tuple(float(v) for v in w)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Fits the model to at most `sample` labelled documents, those with the least hash of their id.

    labels: doc_id and toxic (0 or 1); null labels and ids are left out, of several labels of an id the largest holds.
    Without toxic labels the model scores every text 0 (to rounding).
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    chosen = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = materialise(chosen.withColumn("toxic", (F.col("toxic") > 0).cast("int")), "chosen")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # Copies count once, else the words of a much-copied toxic text would seem toxic. At most `sample` rows of two numbers: the broadcast is bounded by that parameter.
    train = materialise(texts.join(F.broadcast(chosen), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic")), "train")
    counts = train.mapInArrow(_word_counts, "word string, d0 long, d1 long, t0 long, t1 long")
    counts = materialise(counts.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("d0", "d1", "t0", "t1")]), "words")
    sizes = counts.where("word = ''").first()
    if sizes is None or not sizes["d1"] or not sizes["d0"]:
        return Model({}, {})
    counts = counts.where("word <> ''")
    mass = counts.agg(F.sum("d0"), F.sum("d1")).first()
    sizes = (mass[0], mass[1])
    by_word = materialise(_significant(counts, sizes).orderBy(F.desc("z"), "word").limit(TERMS), "terms")
    words = {r["word"]: r for r in by_word.collect()}
    rare = counts.join(F.broadcast(by_word.select("word")), "word", "left_anti")
    stems = rare.select(F.explode(F.array(*[F.when(F.length("word") > k, F.substring("word", 1, k)) for k in _PREFIXES])).alias("word"), "d0", "d1", "t0", "t1").where("word is not null")
    stems = stems.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("d0", "d1", "t0", "t1")])
    prefixes = {r["word"]: r for r in _significant(stems, sizes).orderBy(F.desc("z"), "word").limit(TERMS).collect()}
    said = counts.agg(F.sum("t0"), F.sum("t1")).first()
    begun = _begun(rare, list(prefixes))
    share = [min(0.9, (sum(r[f"t{k}"] for r in words.values()) + sum(r[f"t{k}"] for r in begun.values())) / max(1, said[k])) for k in (0, 1)]
    other = min(-0.005, math.log((1 - share[1]) / (1 - share[0])))
    model = Model({w: min(8.0, r["odds"]) for w, r in words.items()}, {w: min(6.0, r["odds"]) for w, r in prefixes.items()}, other)
    model = Model(model.words, model.prefixes, other, _decay(model, words, begun, said[0]))
    return _calibrated(model, train)


def _begun(rare: DataFrame, prefixes: list[str]) -> dict:
    """Tokens by class (t0, t1) that score by each prefix: those of words that aren't terms, by their longest prefix of the
    model. There are TERMS prefixes at most, so the broadcast and the result are bounded."""
    if not prefixes:
        return {}
    # An Arrow table, not a list: rows from a list are unpickled by workers of a second kind, with a daemon that stays.
    known = rare.sparkSession.createDataFrame(pa.table({"prefix": pa.array(prefixes, pa.string())}))
    each = rare.select("word", "t0", "t1", F.explode(F.array(*[F.when(F.length("word") > k, F.substring("word", 1, k)) for k in _PREFIXES])).alias("prefix"))
    longest = each.join(F.broadcast(known), "prefix").groupBy("word", "t0", "t1").agg(F.max_by("prefix", F.length("prefix")).alias("prefix"))
    return {r["prefix"]: r for r in longest.groupBy("prefix").agg(F.sum("t0").alias("t0"), F.sum("t1").alias("t1")).collect()}


def _decay(model: Model, words: dict, begun: dict, clean_tokens: int) -> float:
    """lambda > 0 with a mean of exp(lambda s) of 1 over clean tokens, by bisection; tokens that score by a word of the
    model, by one of its prefixes, or not at all."""
    p = [((r["t0"] + 0.5) / (clean_tokens + 1), model.words[w]) for w, r in words.items()]
    p += [((r["t0"] + 0.5) / (clean_tokens + 1), model.prefixes[w]) for w, r in begun.items()]
    rest = max(0.0, 1 - sum(q for q, _ in p))
    mean = lambda x: sum(q * math.exp(x * s) for q, s in p) + rest * math.exp(x * model.other)
    low, high = 1e-3, 1e-3
    while mean(high) < 1 and high < 8:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if mean(mid) < 1 else (low, mid)
    return max(low, 0.05)


def _calibrated(model: Model, train: DataFrame) -> Model:
    """K from the clean training documents, then the curve from all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = _Weights(model)
        for batch in batches:
            rows = []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hits = _hits(found := tokens(text), weights)
                rows.append((toxic, len(found), [s for s, _, _ in segments(hits, model.other)]))
            names = {"toxic": pa.int32(), "n": pa.int64(), "scores": pa.list_(pa.float64())}
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(names.values())], names=list(names))

    # At most SAMPLE rows; of a document's segments the number and the largest one's score are what the fit needs, and
    # the 50 largest tell how many are significant.
    got = train.mapInArrow(run, "toxic int, n long, scores array<double>").select("toxic", "n", F.slice(F.sort_array("scores", asc=False), 1, 50).alias("scores")).toPandas()
    got["most"] = [max(x, default=0.0) for x in got.scores]
    clean = got[(got.toxic == 0) & (got.n > 0)]
    hit = clean[clean.most > 0]
    level = float(hit.most.median()) if len(hit) else float(min([*model.words.values(), *model.prefixes.values()], default=1.0))
    scale = (float((clean.most >= level).sum()) + 0.5) / max(1e-12, float((clean.n * math.exp(-model.decay * level)).sum()))
    held = Model(model.words, model.prefixes, model.other, model.decay, max(scale, 1e-9))
    evidence = np.array([_evidence(held, m, n) for m, n in zip(got.most, got.n, strict=True)])
    count = np.log1p([sum(_evidence(held, s, n) >= -math.log(SIGNIFICANT) for s in x) for x, n in zip(got.scores, got.n, strict=True)])
    curve = _logistic(np.column_stack([evidence, count]), got.toxic.to_numpy(float))
    return Model(held.words, held.prefixes, held.other, held.decay, held.scale, curve)


def held_out(doc_id: Column) -> Column:
    """Whether the labels of a document stay out of the fit: crc32 of the id as text leaves 0 by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: doc_id, held_out, score, predicted. Rows without an id are scored like others."""
    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), score_column(F.col(text_col), model).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
