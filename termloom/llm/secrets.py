"""Secret scans in DataFrame operations: fixed rules, and two character Markov models compared by likelihood ratio.

Positions come from what lies between matches: split() returns the pieces around the matches that
regexp_extract_all() returns, so running sums of their lengths are the matches' starts, in code points.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed rules: kind, pattern, the group whose length counts, its least length. Kinds sort in this order at one start.
#: AKIA[A-Z0-9]+ of 20 characters or more and [0-9a-f]+ of 24 or more are the same spans as those below: a match of the
#: open form runs to the end of its run, and no later match in that run is longer.
RULES = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: What must be in a text for a rule to match at all; a cheap test before positions are worked out.
_HINTS = {"assign": RULES[0][1], "access": RULES[1][1], "hex": RULES[2][1]}

#: Characters that the models tell apart; any other is one more class.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: A run of these is a candidate if it is long enough.
CANDIDATE = "[A-Za-z0-9+/_=-]{16,}"

#: Ordinary identifiers of programs and paths, part of every labelled sample.
IDENTIFIERS = """get_user_name setAccountConfiguration internationalization_of_services2 path/to/some/file_name_v2/index_page
getUserProfileById createConnectionFactory application_settings_default request_handler_timeout_seconds max_retry_count
src/main/java/com/example/service/UserRepository lib/python3/site-packages/numpy/core/__init__ docs/reference/configuration
databaseConnectionString session_cookie_expiration updateShoppingCartItem delete_temporary_files_older_than_30_days
this-is-a-long-article-title-about-cooking-2024 best-practices-for-software-testing image_gallery_thumbnail_small_2
calculateTotalPriceWithTax parse_command_line_arguments validate_email_address is_feature_enabled_for_customer
openDocumentFromTemplate convertTemperatureToFahrenheit notification_preferences_page export_report_to_spreadsheet
Donaudampfschifffahrtsgesellschaft Rechtsschutzversicherungsgesellschaften anticonstitutionnellement electroencefalografista""".split()


def running(values: Column, combine) -> Column:
    """What `combine` (associative, such as + or greatest) makes of each value and all before it. Every step doubles how
    far back a value has looked, so n values take n log n operations and no step copies what earlier ones made."""
    strides = F.array(*[F.lit(1 << k) for k in range(31)])
    steps = F.slice(strides, F.lit(1), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int"))
    return F.aggregate(steps, values, lambda acc, far: F.transform(acc, lambda x, i: F.when(i >= far, combine(F.get(acc, i - far), x)).otherwise(x)))


def _positions(text: Column, pattern: str) -> Column:
    """array<struct<start, whole>> of the pattern's matches, leftmost and without overlap."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x))
    stops = running(F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda gap, whole: gap + F.char_length(whole)), lambda x, y: x + y)
    return F.zip_with(stops, found, lambda stop, whole: F.struct((stop - F.char_length(whole)).alias("start"), whole.alias("whole")))


_SPAN = "array<struct<start:int,rank:int,kind:string,stop:int>>"


def base_spans(text: Column, kind: str) -> Column:
    """Spans of one fixed rule; matches whose counted group is too short are dropped after matching."""
    rank = [r[0] for r in RULES].index(kind)
    _, pattern, group, least = RULES[rank]
    counted = (lambda w: F.char_length(F.regexp_extract(w, pattern, group))) if group else (lambda w: F.char_length(w))
    kept = F.filter(_positions(text, pattern), lambda m: counted(m.whole) >= least)
    spans = F.transform(kept, lambda m: F.struct(m.start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (m.start + F.char_length(m.whole)).cast("int").alias("stop")))
    return F.when(text.rlike(_HINTS[kind]), spans).otherwise(F.array()).cast(_SPAN)


def labelled_samples(docs: DataFrame, text_col: str = "text", sample_docs: int = 400, words: int = 20000) -> DataFrame:
    """(string, random) to train on: at most `words` ordinary words of `sample_docs` documents, the bound of this
    sample (those with the least hash of their text), without the matches of the fixed rules, each also joined with the
    word after it, by nothing, an underscore, a hyphen or a slash, an eighth of these in capitals; identifiers; numbers
    of 12 to 32 digits; and random strings: SHA-256 digests of counters in
    hexadecimal, Base64, Base64 without its capitals and Base64 without what isn't a letter, of 16 to 44 characters."""
    spark = docs.sparkSession
    chosen = docs.select(F.col(text_col).cast("string").alias("t")).where("length(t) > 0 and length(t) <= 20000").select("t", F.xxhash64("t").alias("h")).orderBy("h", "t").limit(sample_docs)
    clean = F.col("t")
    for _, pattern, _, _ in RULES:
        clean = F.regexp_replace(clean, pattern, " ")
    found = F.regexp_extract_all(clean, F.lit("[A-Za-z0-9+/_=-]{3,}"), F.lit(0))
    pair = lambda w, i: F.concat(w, F.get(F.array(*map(F.lit, ("", "_", "-", "/"))), F.pmod(F.xxhash64(w), F.lit(4)).cast("int")), F.get(F.col("w"), i + 1))
    pairs = F.filter(F.transform("w", pair), lambda x: x.isNotNull())
    both = F.concat("w", F.transform(pairs, lambda x: F.when(F.pmod(F.xxhash64(x), F.lit(8)) == 0, F.upper(x)).otherwise(x)))
    ordinary = chosen.select(found.alias("w")).select(F.explode(both).alias("string")).limit(2 * words).select("string", F.lit(False).alias("random"))
    digest = F.sha2(F.col("id").cast("string"), 256)
    base64 = F.base64(F.unhex(digest))
    kind = F.col("id") % 4
    whole = F.when(kind == 0, digest).when(kind == 1, base64).when(kind == 2, F.lower(base64)).otherwise(F.regexp_replace(base64, "[^A-Za-z]", ""))
    made = spark.range(0, 4000, 1, 1).select(F.substring(whole, F.lit(1), (16 + F.pmod(F.xxhash64("id"), F.lit(29))).cast("int")).alias("string"), F.lit(True).alias("random"))
    known = spark.range(0, 10, 1, 1).select(F.explode(F.array(*[F.lit(w) for w in IDENTIFIERS])).alias("string"), F.lit(False).alias("random"))
    numbers = spark.range(0, 2000, 1, 1).select(F.substring(F.concat(F.abs(F.xxhash64("id")), F.abs(F.xxhash64(-F.col("id")))), F.lit(1), (F.col("id") % 21 + 12).cast("int")).alias("string"), F.lit(False).alias("random"))
    return ordinary.unionByName(known).unionByName(numbers).unionByName(made)


def train_markov(samples: DataFrame, prior: float = 0.5) -> list[float]:
    """Log ratios of the transition probabilities, random over ordinary, by class of the two characters, row by row.

    First-order chains; null strings count as empty. A row is smoothed by `prior` times the table's width transitions
    that follow the class's own frequencies of characters, so what is rare in ordinary strings stays so after any
    character. The table has
    (len(ALPHABET) + 1) ** 2 entries whatever the samples' size, so it may come to the driver."""
    k = len(ALPHABET) + 1
    chars = F.transform(F.split(F.coalesce("string", F.lit("")), ""), lambda c: F.when(c == "", F.lit(k)).otherwise(F.instr(F.lit(ALPHABET), c)))
    classes = samples.select("random", F.transform(F.filter(chars, lambda c: c <= k - 1), lambda c: F.pmod(c - 1, F.lit(k))).alias("c"))
    pairs = classes.where("size(c) > 1").select("random", F.explode(F.arrays_zip(F.expr("slice(c, 1, size(c) - 1)").alias("x"), F.expr("slice(c, 2, size(c) - 1)").alias("y"))).alias("p"))
    counts = {(r["random"], r["x"], r["y"]): r["count"] for r in pairs.groupBy("random", "p.x", "p.y").count().collect()}
    kinds = (True, False)
    seen = {kind: [sum(counts.get((kind, x, y), 0) for x in range(k)) for y in range(k)] for kind in kinds}
    share = {kind: [(n + prior) / (sum(seen[kind]) + prior * k) for n in seen[kind]] for kind in kinds}
    out = []
    for x in range(k):
        row = {kind: sum(counts.get((kind, x, y), 0) for y in range(k)) for kind in kinds}
        for y in range(k):
            random, ordinary = ((counts.get((kind, x, y), 0) + prior * k * share[kind][y]) / (row[kind] + prior * k) for kind in kinds)
            out.append(round(math.log(random / ordinary), 6))
    return out


def log_ratio(string: Column, table: list[float]) -> Column:
    """The log-likelihood ratio of a string, random over ordinary, in time linear in its length."""
    k = len(ALPHABET) + 1
    ratios = F.expr(f"array({','.join(f'{x:.6f}D' for x in table)})")  # one text to parse, not a call for each number
    classes = F.transform(F.filter(F.split(string, ""), lambda c: c != ""), lambda c: F.pmod(F.instr(F.lit(ALPHABET), c) - 1, F.lit(k)))
    least = F.greatest(F.size(classes) - 1, F.lit(0))
    steps = F.zip_with(F.slice(classes, F.lit(1), least), F.slice(classes, F.lit(2), least), lambda x, y: F.get(ratios, x * F.lit(k) + y))
    return F.aggregate(steps, F.lit(0.0), lambda acc, s: acc + s)


@dataclass(frozen=True)
class Markov:
    """The models: log ratios of transitions, and how large a candidate's ratio must be in all and a character, in nats."""

    table: list[float]
    least_total: float = 12.0
    least_mean: float = 0.8

    def is_random(self, string: Column) -> Column:
        ratio = log_ratio(string, self.table)
        return (ratio >= self.least_total) & (ratio >= self.least_mean * F.char_length(string))


def fit_limits(samples: DataFrame, table: list[float]) -> Markov:
    """Limits from candidates that the table wasn't trained on: just above the largest ratio of an ordinary one, a
    character, but for one in a thousand; in all, what a candidate of least length has at that rate, 8 at least. The
    samples are bounded where they are made, and here only two numbers come to the driver."""
    rated = samples.where(F.col("string").rlike(f"^{CANDIDATE}$") & ~F.col("random")).select((log_ratio(F.col("string"), table) / F.char_length("string")).alias("mean"))
    high = rated.agg(F.percentile_approx("mean", 0.999, 100_000)).first()[0]
    mean = round(max(0.3, (high if high is not None else 0.75) + 0.05), 6)
    return Markov(table, max(8.0, 16 * mean), mean)


def _free(docs: DataFrame, *names: str) -> list[str]:
    """Column names like these that docs hasn't got."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
        taken.add(name)
    return out


def scan_secrets(docs: DataFrame, model: Markov, text_col: str = "text", spans_col: str = "_spans") -> DataFrame:
    """docs with one more column `spans_col`: array<struct<start, rank, kind, stop>> in order, code points, stop exclusive.

    The fixed rules' spans, and candidates that the models call random and that overlap none of them (kind `random`).
    Null and empty texts have no span. All columns of docs stay as they are; `spans_col` must not be one of them.
    """
    text, base_col = _free(docs.withColumn(spans_col, F.lit(0)), "_text", "_base")
    base = docs.withColumn(text, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    base = base.withColumn(base_col, F.concat(*[base_spans(F.col(text), r[0]) for r in RULES]))
    found = _positions(F.col(text), CANDIDATE)
    random = F.filter(found, lambda m: model.is_random(m.whole) & ~F.exists(base_col, lambda b: (b.start < m.start + F.char_length(m.whole)) & (b.stop > m.start)))
    spans = F.transform(random, lambda m: F.struct(m.start.alias("start"), F.lit(len(RULES)).alias("rank"), F.lit("random").alias("kind"), (m.start + F.char_length(m.whole)).cast("int").alias("stop")))
    more = F.when(F.col(text).rlike(CANDIDATE), spans).otherwise(F.array()).cast(_SPAN)
    return base.withColumn(spans_col, F.array_sort(F.concat(base_col, more))).drop(text, base_col)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.stop.cast("string"))), ",")


def secret_digests(docs: DataFrame, model: Markov, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: counts of the fixed rules' spans, their digest, and all spans as one string.

    Null and empty texts have no span and the digest of the empty string; rows without an id and repeated rows are
    scanned like others, an empty table gives no row, and further columns are ignored, whatever their names."""
    found = scan_secrets(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), model)
    count = lambda kind: F.size(F.filter("_spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("_spans", lambda s: s.kind != "random")
    return found.select("doc_id", *[count(r[0]) for r in RULES], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("_spans")).alias("spans"))


def redact(docs: DataFrame, model: Markov, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs with every span replaced by `mark`; overlapping spans become one. Texts without a span are as they were, null
    ones too, and so are all other columns."""
    (spans,) = _free(docs, "_spans")
    found = scan_secrets(docs, model, text_col, spans)
    chars = F.filter(F.split(F.col(text_col), ""), lambda c: c != "")
    stops = running(F.transform(spans, lambda s: s.stop), F.greatest)
    reached = F.concat(F.array(F.lit(0)), stops)

    def rebuilt(v: Column) -> Column:
        # Before each span: what lies between it and the furthest stop so far; a span that begins earlier adds nothing.
        piece = lambda s, i: F.when(s.start >= F.get(v.reached, i), F.concat(F.array_join(F.slice(v.chars, F.get(v.reached, i) + 1, s.start - F.get(v.reached, i)), ""), F.lit(mark))).otherwise("")
        rest = F.slice(v.chars, F.element_at(v.reached, -1) + 1, F.size(v.chars))
        return F.concat(F.array_join(F.transform(spans, piece), ""), F.array_join(rest, ""))

    # In a lambda a variable is worked out once, where an expression would be worked out for every element.
    text = F.element_at(F.transform(F.array(F.struct(chars.alias("chars"), reached.alias("reached"))), rebuilt), 1)
    return found.withColumn(text_col, F.when(F.size(spans) > 0, text).otherwise(F.col(text_col))).select(*docs.columns)


def trained(spark: SparkSession, docs: DataFrame, text_col: str = "text") -> Markov:
    """The models from the bounded labelled sample of docs: transitions from four fifths of its strings, limits from the rest."""
    samples = labelled_samples(docs, text_col)
    apart = F.pmod(F.xxhash64("string"), F.lit(5)) == 0
    return fit_limits(samples.where(apart), train_markov(samples.where(~apart)))
