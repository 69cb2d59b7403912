"""Clusters and topics by words: TF-IDF vectors, k-means, density clusters, top terms, LDA."""

from __future__ import annotations

from pyspark.ml.clustering import LDA, KMeans
from pyspark.ml.feature import CountVectorizer, NGram, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import checkpointed, components


def _grams(texts: DataFrame, longest: int) -> DataFrame:
    """(id, grams): the 1- to `longest`-grams of the words of two characters or more."""
    rows = texts.select("id", F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0)).alias("w"))
    for n in range(2, longest + 1):
        rows = NGram(n=n, inputCol="w", outputCol=f"g{n}").transform(rows)
    return rows.select("id", F.concat("w", *[f"g{n}" for n in range(2, longest + 1)]).alias("grams"))


def tf_idf(texts: DataFrame, features: int = 1000, least_docs: int = 2, most_share: float = 0.8, longest: int = 3) -> DataFrame:
    """texts(id, text) to (id, terms, weights): the `features` most frequent terms that are in `least_docs` documents or
    more and in `most_share` of them at most; smoothed idf ln((1 + n) / (1 + df)) + 1, rows of length 1. Null texts and
    those without a term have empty lists."""
    grams = checkpointed(_grams(texts, longest))
    total = grams.count()
    counts = grams.select("id", F.explode("grams").alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    known = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("n")).where((F.col("df") >= least_docs) & (F.col("df") <= most_share * total))
    known = checkpointed(known.orderBy(F.desc("n"), "term").limit(features))
    # At most `features` rows, a parameter.
    weighed = counts.join(F.broadcast(known.select("term", "df")), "term").withColumn("w", F.col("tf") * (F.log((1 + F.lit(total)) / (1 + F.col("df"))) + 1))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    rows = weighed.withColumn("w", F.col("w") / length).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("term", "w"))).alias("t"))
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    return grams.select("id").join(rows, "id", "left").select("id", empty(F.col("t.term"), "array<string>").alias("terms"), empty(F.col("t.w"), "array<double>").alias("weights"))


def _vectors(weighed: DataFrame) -> DataFrame:
    """weighed with a dense vector over the terms in use (at most the features of tf_idf)."""
    terms = [r.term for r in weighed.select(F.explode("terms").alias("term")).distinct().orderBy("term").collect()]
    lookup = F.map_from_arrays("terms", "weights")
    return weighed.where("size(terms) > 0").withColumn("v", array_to_vector(F.transform(F.array(*[F.lit(t) for t in terms]), lambda t: F.coalesce(F.element_at(lookup, t), F.lit(0.0)))))


def k_means(weighed: DataFrame, k: int | None = None, most: int = 10, seed: int = 42) -> DataFrame:
    """(id, cluster) of the rows with a term. Without k the least k is taken after which one more cluster lowers the cost by under a tenth."""
    rows = checkpointed(_vectors(weighed))
    if rows.isEmpty():
        return rows.select("id", F.lit(0).alias("cluster"))
    model, cost = None, None
    for n in [k] if k else range(2, most + 1):
        new = KMeans(k=n, seed=seed, featuresCol="v", predictionCol="cluster").fit(rows)
        now = new.summary.trainingCost
        if cost is not None and cost - now < 0.1 * cost:
            break
        model, cost = new, now
    return model.transform(rows).select("id", "cluster")


def density_clusters(weighed: DataFrame, eps: float = 0.3, least: int = 3) -> DataFrame:
    """(id, cluster) by density on cosine distance: a row with `least` rows within eps, itself included, is a core;
    connected cores are a cluster, named by its least id; other rows within eps of a core join the least such cluster,
    the rest have a null cluster. Rows with the same terms are one point of that many rows, so copies make no pairs;
    points meet only on terms that both have."""
    rows = weighed.groupBy("terms", "weights").agg(F.min("id").alias("p"), F.count("*").alias("size"))
    rows = checkpointed(rows.where("size(terms) > 0"))
    flat = rows.select("p", F.explode(F.arrays_zip("terms", "weights")).alias("t")).select("p", "t.terms", "t.weights")
    near = flat.alias("a").join(flat.alias("b"), (F.col("a.terms") == F.col("b.terms")) & (F.col("a.p") < F.col("b.p")))
    near = near.groupBy(F.col("a.p").alias("x"), F.col("b.p").alias("y")).agg(F.sum(F.col("a.weights") * F.col("b.weights")).alias("cosine")).where(1 - F.col("cosine") <= eps)
    near = checkpointed(near.select("x", "y").union(near.select("y", "x")))
    weight = near.join(rows.select(F.col("p").alias("y"), "size"), "y").groupBy(F.col("x").alias("p")).agg(F.sum("size").alias("others"))
    cores = checkpointed(rows.select("p", "size").join(weight, "p", "left").where(F.col("size") + F.coalesce("others", F.lit(0)) >= least).select("p"))
    links = near.join(cores.select(F.col("p").alias("x")), "x").join(cores.select(F.col("p").alias("y")), "y")
    parts = components(links.select(F.col("x").alias("src"), F.col("y").alias("dst")))
    core = checkpointed(cores.join(parts, cores.p == parts.node, "left").select("p", F.coalesce("component", "p").alias("cluster")))
    edge = near.join(core.select(F.col("p").alias("y"), "cluster"), "y").join(core.select(F.col("p").alias("x")), "x", "left_anti").groupBy(F.col("x").alias("p")).agg(F.min("cluster").alias("cluster"))
    points = rows.select("terms", "weights", "p").join(core.unionByName(edge), "p", "left")
    return weighed.join(points, ["terms", "weights"], "left").select("id", "cluster")


def top_terms(weighed: DataFrame, clusters: DataFrame, k: int = 10) -> DataFrame:
    """(cluster, term, weight, rank): the k terms of the highest mean weight over all rows of a cluster(id, cluster)."""
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("n"))
    flat = weighed.select("id", F.explode(F.arrays_zip("terms", "weights")).alias("t")).join(clusters, "id")
    mean = flat.groupBy("cluster", F.col("t.terms").alias("term")).agg(F.sum("t.weights").alias("s")).join(sizes, "cluster").select("cluster", "term", F.round(F.col("s") / F.col("n"), 6).alias("weight"))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("weight"), "term"))
    return mean.withColumn("rank", rank).where(F.col("rank") <= k)


def lda_topics(texts: DataFrame, topics: int = 10, features: int = 1000, hard: float = 0.3, soft: float = 0.15, seed: int = 42) -> DataFrame:
    """(id, topic, share, others): a row's likeliest topic if its share is `hard` or more, else -1; the topics of share
    `soft` or more, three at most. Null and empty texts get topic -1 unless the prior alone decides otherwise."""
    grams = checkpointed(_grams(texts, 1))
    counted = CountVectorizer(inputCol="grams", outputCol="v", vocabSize=features, minDF=1.0).fit(grams).transform(grams)
    model = LDA(k=topics, seed=seed, featuresCol="v", optimizer="online").fit(counted)
    shares = vector_to_array("topicDistribution")
    ranked = F.reverse(F.array_sort(F.transform(shares, lambda x, i: F.struct(x.alias("share"), (-i).alias("t")))))
    rows = model.transform(counted).select("id", ranked.alias("r"))
    others = F.transform(F.filter(F.slice("r", 1, 3), lambda x: x.share >= soft), lambda x: -x.t)
    return rows.select("id", F.when(F.col("r")[0].share >= hard, -F.col("r")[0].t).otherwise(-1).alias("topic"), F.col("r")[0].share.alias("share"), others.alias("others"))
