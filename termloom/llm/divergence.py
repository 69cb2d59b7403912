"""How far the sources of a language are apart in their words: exact integer frequencies, summed over wide term vectors.

Every kept term of a language is one row with an array that has a place for each source of that language. JVM higher-order
functions turn its counts into frequencies and emit, for each pair of sources, the term's contribution; contributions are
summed where they are made, so that a task hands on one row for each pair of sources, whatever the number of terms. The
answer has a row for every ordered pair of sources of a language, so the arrays are no longer than the root of the answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: A word: everything but ASCII characters that aren't letters.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Frequencies are in parts of UNIT, with PRIOR added to each count.
UNIT, PRIOR = 1_000_000_000, 5
#: Groups (language, source) up to which their table is broadcast; beyond, joins shuffle.
FEW_GROUPS = 100_000


def _words(text: str) -> Column:
    """(term, first) for each word of a text, sorted: first is 1 at the first one of a term, so its sum counts texts."""
    sorted_words = f"sort_array(regexp_extract_all(translate({text}, '{UPPER}', '{LOWER}'), r'{TERM}', 0))"
    return F.expr(f"transform(array({sorted_words}), w -> transform(w, (t, i) -> named_struct('term', t, 'first', int(i = 0 or w[greatest(i - 1, 0)] <> t))))[0]")


def _frequency(count: str, total: str, terms: str) -> str:
    """1 + floor(UNIT * (count + PRIOR) / (total + PRIOR * terms)), in integers of any size."""
    return f"1 + ({UNIT}BD * (cast({count} as decimal(20,0)) + {PRIOR}BD)) div (cast({total} as decimal(20,0)) + {PRIOR}BD * cast({terms} as decimal(20,0)))"


def term_counts(docs: DataFrame) -> DataFrame:
    """docs(lang, source, text) without nulls to (lang, source, term, n, df): occurrences, and documents with the term."""
    rows = docs.select("lang", "source", F.explode(_words("text")).alias("w")).select("lang", "source", "w.term", "w.first")
    return rows.groupBy("lang", "source", "term").agg(F.count("*").alias("n"), F.sum("first").alias("df"))


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 30, top: int = 50) -> DataFrame:
    """Distances between the sources of each language, and the terms that mark a source.

    Returns lang, source, part, item, value, rank. Terms are matches of TERM with A-Z lower-cased; a language keeps those in
    `least_docs` of its documents or more. A group (language, source) gives each kept term of its language the frequency of
    _frequency, also those that it hasn't got. Part 'pair': every other source of the language, with the differences of the
    frequencies summed over all kept terms (0 without any). Part 'term': the first `top` terms that the group has and that are
    more frequent in it than in the language. Ranks run from 1 by value, largest first, then by the item's UTF-8 bytes.
    Nulls count as '', which is a language, a source or a text like any other. Repeated rows count as often as they come.
    A language with one source has no pairs; a group without terms has pairs only. Empty tables give empty results. Further
    columns are ignored. A text is one array of words in a task, so it must fit there.
    """
    spark = docs.sparkSession
    own = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    counts = materialise(term_counts(own), "counts")
    terms = materialise(counts.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df")).where(F.col("df") >= least_docs).select("lang", "term", "n"), "terms")
    kept = materialise(counts.select("lang", "term", "source", F.col("n").alias("c")).join(terms, ["lang", "term"]), "kept")

    totals = kept.groupBy("lang", "source").agg(F.sum("c").alias("total"))
    groups = own.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").na.fill(0, ["total"])
    groups = groups.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    groups = materialise(groups.select("lang", "source", "at", "total"), "groups")
    # Languages are at most as many as groups; a row has the sources of one language and their totals, in order.
    by_lang = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "source", "total"))).alias("g"))
    by_lang = by_lang.join(terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("all")), "lang", "left").na.fill(0, ["v", "all"])
    by_lang = materialise(by_lang.selectExpr("lang", "g.source as sources", "g.total as totals", "v", "`all`"), "langs")
    few = groups.count() <= FEW_GROUPS
    known = F.broadcast if few else (lambda df: df)

    placed = kept.join(known(groups.select("lang", "source", "at")), ["lang", "source"])
    wide = placed.groupBy("lang", "term", "n").agg(F.map_from_entries(F.collect_list(F.struct("at", "c"))).alias("c"))
    wide = wide.join(known(by_lang), "lang")
    wide = wide.withColumn("counts", F.expr("transform(totals, (t, i) -> coalesce(try_element_at(c, i), 0L))"))
    wide = materialise(wide.selectExpr("lang", "term", "sources", "counts", f"transform(totals, (t, i) -> {_frequency('counts[i]', 't', 'v')}) as p", f"{_frequency('n', '`all`', 'v')} as q"), "wide")

    # Pairs: a row for each term and first source, from which the later sources' contributions are emitted.
    firsts = wide.where("size(p) > 1").select("lang", "p", F.explode(F.expr("sequence(0, size(p) - 2)")).alias("i"))
    later = F.explode(F.expr("transform(sequence(i + 1, size(p) - 1), j -> named_struct('j', j, 'f', abs(p[i] - p[j])))"))
    sums = firsts.select("lang", "i", later.alias("x")).groupBy("lang", "i", F.col("x.j").alias("j")).agg(F.sum("x.f").alias("value"))
    all_pairs = by_lang.where("size(sources) > 1").select("lang", "sources", F.explode(F.expr("sequence(0, size(sources) - 2)")).alias("i"))
    all_pairs = all_pairs.select("lang", "i", F.explode(F.expr("transform(sequence(i + 1, size(sources) - 1), j -> named_struct('j', j, 'a', sources[i], 'b', sources[j]))")).alias("x")).select("lang", "i", "x.j", "x.a", "x.b")
    halves = all_pairs.join(sums, ["lang", "i", "j"], "left").na.fill(0, ["value"])
    ends = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = halves.select("lang", ends.alias("e"), "value").select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value")

    marked = wide.select("lang", F.col("term").alias("item"), "q", F.explode(F.expr("filter(transform(p, (x, i) -> named_struct('source', sources[i], 'p', x, 'c', counts[i])), s -> s.c > 0 and s.p > q)")).alias("s"))
    marked = marked.select("lang", "s.source", F.lit("term").alias("part"), "item", (F.col("s.p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    # The limit on ranks is pushed below the shuffle: each task hands on its first `top` terms of a group.
    return ranked(pairs).unionByName(ranked(marked).where(F.col("rank") <= top))
