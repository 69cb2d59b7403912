"""Result documents and phrases: parsing, normal forms, phrase aggregation, breadcrumbs, exports of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DOCUMENT = "position int, url string, domain string, title string, snippet string, extended_text string, passages string, is_commercial boolean"
PHRASE = "array<struct<phrase:string,frequency:bigint,source:string>>"
# Patterns of shops' domains, and of broken breadcrumbs.
SHOP_DOMAINS = r"\.shop|\.store|market|shop|ozon|wildberries|avito|youla|aliexpress|goods|catalog|price"
BROKEN = ("404", "error", "ошибка")


def domain_of(url: Column) -> Column:
    """The host without scheme and www, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#]*)", 1), r"^www\.", ""))


def normal_documents(stored: Column) -> Column:
    """Documents from any stored form: a JSON list of objects or of URLs, URLs parted by | or, without one, by commas, or one URL
    with its scheme (a list of one has nothing that parts it).

    Rows are array<struct<DOCUMENT>>; entries without a URL go, but count for the position of those after them. Null, empty
    and unreadable values give an empty list."""
    fields = [f.rsplit(" ", 1) for f in DOCUMENT.split(", ")]
    text = F.trim(stored)
    listed = F.from_json(F.when(text.startswith("["), text), "array<string>")
    separated = F.when(~text.startswith("[") & ~text.startswith("{") & text.contains("|"), F.split(text, r"\|")).when(~text.startswith("[") & ~text.startswith("{") & text.contains(","), F.split(text, ",")).when(text.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://\S+$"), F.array(text))
    entries = F.coalesce(listed, separated, F.array().cast("array<string>"))

    def entry(x: Column, i: Column) -> Column:
        o = F.from_json(F.when(x.startswith("{"), x), DOCUMENT.replace("url string", "url string, nothing string"))
        url = F.when(x.startswith("{"), o.url).otherwise(F.trim(x))
        place = F.when(o.position > 0, o.position).otherwise((i + 1).cast("int"))
        values = {"position": place, "url": url, "domain": F.coalesce(F.nullif(o.domain, F.lit("")), domain_of(url)), "is_commercial": F.coalesce(o.is_commercial, F.lit(False))}
        return F.struct(*[(values[n] if n in values else F.coalesce(o[n], F.lit(""))).cast(t).alias(n) for n, t in fields])

    return F.filter(F.transform(entries, entry), lambda d: F.coalesce(d.url, F.lit("")) != "")


def normal_phrases(stored: Column) -> Column:
    """Phrases from any stored form: a JSON list of objects or of strings; a string has frequency 1 and source unknown."""
    text = F.trim(stored)
    entries = F.coalesce(F.from_json(F.when(text.startswith("["), text), "array<string>"), F.array().cast("array<string>"))

    def entry(x: Column) -> Column:
        o = F.from_json(F.when(x.startswith("{"), x), "phrase string, frequency bigint, source string")
        return F.struct(F.when(x.startswith("{"), o.phrase).otherwise(x).alias("phrase"), F.coalesce(o.frequency, F.lit(1).cast("bigint")).alias("frequency"), F.coalesce(o.source, F.lit("unknown")).alias("source"))

    return F.filter(F.transform(entries, entry), lambda p: F.trim(F.coalesce(p.phrase, F.lit(""))) != "")


def has_phrases(stored: Column) -> Column:
    """Whether a stored list has an object with a phrase."""
    entries = F.from_json(F.when(F.trim(stored).startswith("["), F.trim(stored)), "array<string>")
    return F.coalesce(F.exists(entries, lambda x: x.startswith("{") & F.get_json_object(x, "$.phrase").isNotNull()), F.lit(False))


def inner_text(xml: Column) -> Column:
    """Text without tags, the five entities resolved, white space made single."""
    out = F.regexp_replace(xml, r"<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def xml_documents(xml: Column, shops: str = SHOP_DOMAINS) -> Column:
    """The documents of a result page in XML: the first doc of each group; the extended text is the snippet, else the
    headline, else the passages. Malformed pages give what groups can be read, null ones an empty list."""
    groups = F.regexp_extract_all(F.coalesce(xml, F.lit("")), F.lit(r"(?s)<group(?:\s[^>]*)?>.*?</group>"), F.lit(0))
    docs = F.filter(F.transform(groups, lambda g: F.regexp_extract(g, r"(?s)<doc(?:\s[^>]*)?>(.*?)</doc>", 1)), lambda d: d != "")
    tag = lambda d, name: inner_text(F.regexp_extract(d, rf"(?s)<{name}(?:\s[^>]*)?>(.*?)</{name}>", 1))

    def document(d: Column, i: Column) -> Column:
        url, passages = tag(d, "url"), F.array_join(F.filter(F.transform(F.regexp_extract_all(d, F.lit(r"(?s)<passage(?:\s[^>]*)?>(.*?)</passage>"), F.lit(1)), inner_text), lambda p: p != ""), " ")
        domain = F.coalesce(F.nullif(tag(d, "domain"), F.lit("")), domain_of(url))
        extended = tag(d, "extended-text")
        snippet = F.coalesce(F.nullif(extended, F.lit("")), F.nullif(tag(d, "headline"), F.lit("")), passages)
        values = (("position", (i + 1).cast("int")), ("url", url), ("domain", domain), ("title", tag(d, "title")), ("snippet", snippet), ("extended_text", extended), ("passages", passages), ("is_commercial", F.lower(domain).rlike(shops)))
        return F.struct(*[v.alias(n) for n, v in values])

    return F.transform(docs, document)


def copy_passages(documents: Column) -> Column:
    """Documents whose empty snippet is their passages."""
    return F.transform(documents, lambda d: d.withField("snippet", F.when(F.coalesce(d.snippet, F.lit("")) == "", d.passages).otherwise(d.snippet)))


def texts_of(documents: Column, top: int = 10, sep: str = " ; ") -> tuple[Column, Column]:
    """Titles and descriptions of the first documents, joined; a description is the passages, else the snippet, else the
    extended text."""
    first = F.slice(documents, 1, top)
    filled = lambda *xs: F.coalesce(*[F.nullif(x, F.lit("")) for x in xs])
    join = lambda f: F.array_join(F.filter(F.transform(first, f), lambda x: x.isNotNull()), sep)
    return join(lambda d: filled(d.title)), join(lambda d: filled(d.passages, d.snippet, d.extended_text))


def aggregate_phrases(phrases: DataFrame, top: int = 10, by: str = "cluster") -> DataFrame:
    """phrases(by, phrase, frequency, source), a row per query, to the `top` phrases of each group: longest first, then by
    frequency, then alphabetically; with queries_count, main_source (the most frequent, then the least) and relevance.

    A shorter phrase goes where a longer one that stays has it as a run of words and is at least half as frequent. What
    stays is decided from the longest phrases down, one pass a length, so each pass joins only on words in common."""
    words = F.split(F.trim("phrase"), r"\s+")
    usable = phrases.where(F.trim(F.coalesce("phrase", F.lit(""))) != "")
    sources = usable.groupBy(by, "phrase", "source").agg(F.count("*").alias("k")).groupBy(by, "phrase").agg(F.min(F.struct((-F.col("k")).alias("k"), "source")).alias("s"))
    rows = usable.groupBy(by, "phrase").agg(F.sum("frequency").alias("frequency"), F.count("*").alias("queries_count")).join(sources, [by, "phrase"])
    rows = rows.select(by, "phrase", "frequency", "queries_count", F.col("s.source").alias("main_source"), F.size(words).alias("n"))
    lengths = sorted((r.n for r in rows.select("n").distinct().collect()), reverse=True)
    kept = None
    for n in lengths:
        now = rows.where(F.col("n") == n)
        if kept is not None:
            now = _not_covered(now, kept, n, by)
        kept = now if kept is None else kept.unionByName(now)
    kept = rows.limit(0) if kept is None else kept
    relevance = F.round(F.col("frequency") * (1 + 0.1 * F.col("queries_count")) * (1 + 0.3 * (F.col("n") - 2)), 3)
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), F.desc("frequency"), "phrase"))
    return kept.withColumn("relevance", relevance).withColumn("rank", rank).where(F.col("rank") <= top).drop("n")


def _not_covered(short: DataFrame, longer: DataFrame, n: int, by: str) -> DataFrame:
    """The phrases of n words that no longer phrase covers: all runs of n words of those meet them by equality."""
    w = F.split(F.trim("phrase"), r"\s+")
    run = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda k: F.array_join(F.slice(w, k, n), " "))
    runs = longer.select(F.col(by).alias("_g"), F.col("frequency").alias("long"), F.explode(run).alias("run")).groupBy("_g", "run").agg(F.max("long").alias("long"))
    return short.join(runs, (F.col(by) == F.col("_g")) & (F.col("phrase") == F.col("run")) & (F.col("frequency") <= 2 * F.col("long")), "left_anti")


def phrase_text(phrases: DataFrame, top: int = 30, by: str = "cluster") -> DataFrame:
    """(by, text): the phrases of rank `top` or better, in order, joined by commas."""
    return phrases.where(F.col("rank") <= top).groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "phrase"))), lambda x: x.phrase), ", ").alias("text"))


def best_breadcrumbs(found: DataFrame) -> DataFrame:
    """found(q, position, crumbs) to (q, crumbs): the longest without a sign of an error page, of these the first."""
    low = F.lower(F.array_join("crumbs", " "))
    fine = found.where(~F.coalesce(low.rlike("|".join(BROKEN)), F.lit(True)) & (F.size("crumbs") > 0))
    return fine.groupBy("q").agg(F.min_by("crumbs", F.struct(-F.size("crumbs"), "position")).alias("crumbs"))


def breadcrumbs_by_cluster(crumbs: DataFrame, members: DataFrame, context: int = 5) -> DataFrame:
    """(cluster, paths, keywords, context) of crumbs(q, crumbs) and members(q, cluster, keyword): distinct paths and
    keywords, sorted; the first keywords by q."""
    rows = members.join(crumbs, "q")
    out = rows.groupBy("cluster").agg(F.array_sort(F.collect_set(F.array_join("crumbs", " > "))).alias("paths"), F.array_sort(F.collect_set("keyword")).alias("keywords"), F.slice(F.sort_array(F.collect_list(F.struct("q", "keyword"))), 1, context).alias("c"))
    return out.select("cluster", "paths", "keywords", F.transform("c", lambda x: x.keyword).alias("context"))


def crumbs_of_html(page: Column) -> Column:
    """Breadcrumbs of a page: JSON-LD, else microdata names inside a BreadcrumbList, else an element whose class has
    breadcrumb, else a nav labelled so. Entries of one character go; fewer than two left are none (null)."""
    clean = lambda xs: F.filter(F.transform(xs, inner_text), lambda x: F.char_length(x) >= 2)
    good = lambda xs: F.when(F.size(xs) >= 2, xs)
    scripts = F.filter(F.regexp_extract_all(page, F.lit(r"""(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"""), F.lit(1)), lambda s: s.contains("BreadcrumbList"))
    item = "array<struct<position:int,name:string,item:struct<name:string>>>"
    listed = F.from_json(F.get_json_object(F.get(scripts, F.lit(0)), "$.itemListElement"), item)
    json = clean(F.transform(F.array_sort(listed), lambda x: F.coalesce(x["name"], x["item"]["name"], F.lit(""))))
    micro = clean(F.regexp_extract_all(F.regexp_extract(page, r"""(?is)itemtype=["'][^"']*BreadcrumbList["'](.*?)</(?:ol|ul|nav|div)>""", 1), F.lit(r"""(?is)itemprop=["']name["'][^>]*>(.*?)<"""), F.lit(1)))
    links = lambda block: clean(F.regexp_extract_all(block, F.lit(r"(?is)<(?:a|span|li)(?:\s[^>]*)?>([^<]+)<"), F.lit(1)))
    by_class = links(F.regexp_extract(page, r"""(?is)class=["'][^"']*breadcrumb[^"']*["'][^>]*>(.*?)</(?:ol|ul|nav|div)>""", 1))
    nav = links(F.regexp_extract(page, r"""(?is)<nav[^>]*aria-label=["'][^"']*breadcrumb[^"']*["'][^>]*>(.*?)</nav>""", 1))
    return F.coalesce(good(json), good(micro), good(by_class), good(nav))


def keyword_objects(rows: DataFrame) -> DataFrame:
    """A JSON object per row without null fields, in order of the columns."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "true"}).alias("json"))
