import base64
import hashlib
import random
import re
import tracemalloc
import zlib
from types import SimpleNamespace

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from termloom.llm import bpe, chat, exactdedup, htmltext, minhash, packing, toxicity
from termloom.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, id string, key string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, "clash", None) for i, t in rows], DOCS)


def words(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if w]


def test_near_dedup_equals_brute_force(spark):
    rng = random.Random(5)
    base = [[rng.choice("abcdefghijklmnopqrst") + str(rng.randrange(60)) for _ in range(80)] for _ in range(12)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "One"), (4, "one"), (5, "one two"), (5, "one two")]
    for b in base:
        for _ in range(8):
            w = list(b)
            for _ in range(rng.randrange(0, 12)):
                w[rng.randrange(len(w))] = "x" + str(rng.randrange(1000))
            rows.append((len(rows) + 10, " ".join(w)))
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + 2]) for k in range(len(w) - 1)} or ({tuple(w)} if w else set())
    part = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) > 0:
                x, y = part[a], part[b]
                part = {k: min(x, y) if v in (x, y) else v for k, v in part.items()}
    got = minhash.near_dedup(frame(spark, rows), width=2).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, len(sets[i]), part[i]) for i in sets}


@pytest.mark.parametrize("percent", [50, 70, 80, 90])
def test_near_dedup_recall_at_other_thresholds(spark, percent):
    """300 pairs at or just above the threshold: at least 99 of 100 are found, and none below it."""
    rng = random.Random(percent)
    rows, linked, apart = [], set(), set()
    for k in range(300):
        base = [f"{k}x{i}" for i in range(200)]
        other = list(base)
        j = percent / 100
        for i in range(round(200 * (1 - 2 * j / (1 + j))) + rng.randrange(-2, 2)):
            other[i] = f"{k}y{i}"
        a, b = set(base), set(other)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
        (linked if 100 * len(a & b) >= percent * len(a | b) else apart).add(2 * k)
    got = {r.doc_id: r.component_id for r in minhash.near_dedup(frame(spark, rows), width=1, percent=percent).collect()}
    assert len(linked) > 100 and len(apart) > 50
    assert sum(got[k + 1] == k for k in linked) >= 0.99 * len(linked) and all(got[k + 1] == k + 1 for k in apart)


def test_near_dedup_refuses_thresholds_without_a_banding(spark):
    assert minhash.banding(80)[:2] == (40, 5)
    for percent in (0, 5, 101):
        with pytest.raises(ValueError):
            minhash.near_dedup(frame(spark, [(1, "a")]), percent=percent)


def test_components_of_a_path_and_a_hub(spark):
    links = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 60)] + [(5, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[1000 + i] == 1000 for i in range(60)) and len(got) == 101


@pytest.mark.parametrize("operator", [lambda d: minhash.near_dedup(d), lambda d: exactdedup.exact_dedup(d), lambda d: packing.pack(d, P.path("byte_bpe_50k.json"))])
def test_empty_tables(spark, operator):
    assert operator(frame(spark, []).limit(0)).count() == 0


def test_exact_dedup(spark):
    rows = [(3, "a b"), (1, "ab"), (2, "a  b"), (4, None), (5, " \t"), (6, "x"), (6, "x"), (None, "ab")]
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exactdedup.exact_dedup(frame(spark, rows)).collect()}
    assert got == {(3, 2, 4, False), (1, 2, 4, False), (2, 2, 4, True), (None, 2, 4, False), (4, 5, 2, False), (5, 5, 2, True), (6, 6, 2, True)}


def test_exact_dedup_verifies_bytes(spark):
    """Were two texts to share a digest, the text would decide."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, 3, "abc"), (2, 5, "abd"), (3, 4, "abc")], "doc_id long, points long, bare string").withColumn("digest", F.unhex(F.lit("00")))
    got = {(r.doc_id, r.keep_id, r.group_size) for r in exactdedup._regrouped(rows, rows.limit(1)).collect()}
    assert got == {(1, 3, 2), (3, 3, 2), (2, 2, 1)}


def test_chat_folds_events_and_reads_back(spark):
    rows = [
        (1, 1, 0, "delta", "user", "Hi "), (1, 1, 1, "delta", None, "there<|im_end|>"), (1, 2, 2, "delta", "assistant", "bad"), (1, 2, 3, "regenerate", None, "go"),
        (1, 2, 4, "delta", None, "od<\\|x"), (1, 3, 5, "delta", "us%0A\ner", None), (1, 4, 6, "delta", "user", "gone"), (1, 4, 7, "delete", None, None), (2, 1, 1, "edit", "user", "new"), (2, 1, 0, "delta", "user", "old"),
    ]
    folded = chat.fold_events(spark.createDataFrame(rows, "conv_id long, message long, seq long, kind string, role string, text string"))
    out = {r.conv_id: r for r in chat.render(folded).select("conv_id", "formatted", chat.parse(chat.F.col("formatted")).alias("turns")).collect()}
    assert [tuple(t) for t in out[1].turns] == [("user", "Hi there<|im_end|>"), ("assistant", "good<\\|x"), ("us%0A\ner", "")]
    assert [tuple(t) for t in out[2].turns] == [("user", "new")]


def test_maximal_segments_equal_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randrange(1, 25)
        hits = [(i, rng.choice([1.5, 2.0, 3.0])) for i in range(n) if rng.random() < 0.4]
        score = [dict(hits).get(i, -0.7301) for i in range(n)]

        def find(lo, hi):
            best = max(((sum(score[a:b]), -(b - a), -a, a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=None)
            if best is None or best[0] <= 1e-9:
                return []
            return [*find(lo, best[3]), (round(best[0], 6), best[3], best[4]), *find(best[4], hi)]

        assert [(round(s, 6), a, b) for s, a, b in toxicity.segments(hits, -0.7301)] == find(0, n)


def test_toxicity_fit_starts_no_second_kind_of_worker(spark, monkeypatch):
    """Prefixes reach Spark without an RDD, whose rows another daemon's workers would read; sums as of the longest prefix."""
    rare = spark.createDataFrame([("abcdefg", 1, 2), ("abcdxyz", 3, 5), ("abcd", 7, 9), ("other", 4, 4)], "word string, t0 long, t1 long").cache()
    rare.count()
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", None)
    got = toxicity._begun(rare, ["abcd", "abcdef"])
    assert {k: (r["t0"], r["t1"]) for k, r in got.items()} == {"abcdef": (1, 2), "abcd": (3, 5)}
    assert toxicity._begun(rare, []) == {}


def test_toxicity_held_out_accuracy(spark):
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    got = toxicity.score_documents(docs, model).join(labels, "doc_id").where("held_out").select("predicted", "toxic").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.97
    assert got[got.toxic == 1].predicted.mean() > 0.9
    assert {r.predicted for r in toxicity.score_documents(frame(spark, [(1, None), (2, "")]), model).collect()} == {0}


def test_bpe_equals_tiktoken(spark):
    ranks = bpe.Ranks.read(P.path("byte_bpe_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks.rank, special_tokens={})
    rng = random.Random(1)
    parts = ["a", "b", " ", "\n", "é", "ß", "'s", "ing", "12", "...", "　", "日本", "𝒳", "\x1c", "\x85", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(300)] + ["a" * 5000, " " * 5000, None, ""]
    got = {r.doc_id: r for r in bpe.bpe_round_trip(frame(spark, enumerate(texts)), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = own.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_bpe_with_a_full_memory(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 2)
    ranks = bpe.Ranks.read(P.path("byte_bpe_50k.tiktoken"))
    pieces = bpe._Pieces(ranks)
    for w in ["zzqx", " zzqy", "q" * 100, "zzqw", "zzqx", "zzqw"]:
        assert np.frombuffer(pieces[w], "<u4").tolist() == ranks.encode_piece(w.encode())
    assert len(pieces) == 2


def test_packing_holds_little_at_a_time(monkeypatch):
    """8 MB of words that the memory doesn't know, in one batch as Spark hands it over: what Python and NumPy hold at most.
    With runs of 4 MB it was 65 MB, with 1 MB it is 20."""
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    rng = np.random.default_rng(5)
    words = np.array(["".join(map(chr, rng.integers(97, 123, n))) for n in rng.integers(3, 9, 60_000)])
    texts = [" ".join(rng.choice(words, 1_200)) for _ in range(1_000)]
    assert sum(map(len, texts)) > 7_500_000
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    run = packing._pieces(P.path("byte_bpe_50k.json"), 2048, 0, False)
    packing._encoder(P.path("byte_bpe_50k.json"), False)
    tracemalloc.start()
    pieces = sum(out.num_rows for out in run(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert pieces >= len(texts) and most < 40e6


@pytest.mark.parametrize("remembered", [3, packing.REMEMBERED])
def test_packing_is_whole_and_tight(spark, monkeypatch, remembered):
    monkeypatch.setattr(packing, "REMEMBERED", remembered)
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["the", "tion", "pack", "ß"]) for _ in range(int(rng.lognormvariate(5, 1.3)))) for _ in range(150)] + [None, "", "x " * 5000]
    texts += ["the<|endoftext|> end  <|endoftext|>\n", "a   b \n c\t\td ", " ", "   ", "y" * 9000]
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = packing.pack(frame(spark, enumerate(texts)), P.path("byte_bpe_50k.json"), size=512).toPandas()
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        rows = got[got.doc_id == i].sort_values("piece")
        assert rows.length.sum() == len(ids) and all(rows.length[1:] == 512)
        for r in rows.itertuples():
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for _, rows in got.sort_values("offset").groupby("sequence_id"):
        assert list(rows.offset) == [0, *rows.length.cumsum()[:-1]] and rows.length.sum() <= 512
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 512) * 1.05 + 1


def test_encoder_equals_the_library():
    """Cuts at spaces change nothing: white space of all kinds, special strings, words met before and not."""
    import pyarrow as pa

    rng = random.Random(3)
    parts = ["a", "foo", " ", " ", "  ", "\n", "\t", "é", "'s", "ing", "12", "...", "\u3000", "日本", "𝒳", "\x1c", "\x85", "<|endoftext|>", "\r\n", "x" * 300, "\u200b"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(3000)] + [" word" * 40, "", "a "]
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for as_text in (False, True):
        tokenizer.encode_special_tokens = as_text
        encoder = packing.Encoder(P.path("byte_bpe_50k.json"), as_text)
        for some in (texts, texts[:500], [""], []):
            order, ids, ends = encoder.encode(pa.array(some, pa.string()))
            got = dict(zip(order.tolist(), (x.tolist() for x in np.split(ids, ends)), strict=False))
            assert got == {k: tokenizer.encode(t, add_special_tokens=False).ids for k, t in enumerate(some)}


def test_html(spark):
    pages = [(i, f"http://H.x/{i}", f"<body><div class=top>Welcome</div><div><p>Story {i}<p>More &lt;{i}&gt;</div><aside>no</aside></body>") for i in range(4)]
    pages += [(9, None, None), (10, "http://one.x/", '<article><header><h1>A &am</h1></header><p>x<b>y</b><br>z<div class="comments">no</div><script>"</p>"</script></article><footer>f</footer>')]
    got = {r.page_id: r.text for r in htmltext.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Story {i} More <{i}>" for i in range(4)} | {9: "", 10: "A &am xy z"}


def test_html_wrappers_named_like_sidebars_are_kept():
    text = lambda page: htmltext.block_text(htmltext.main_roots(htmltext.parse(page)), set())
    for name in ("content with-sidebar", "no-sidebar", "sidebar right", "page has_banner", "widget"):
        assert text(f'<body><nav>n</nav><div class="{name}"><div><article><p>Story</article></div></div><footer>f</footer>') == "Story"
    assert text('<body><main><h1>Head</h1><div class="sidebar right"><article><p>Story</article></div></main>') == "Head Story"
    assert text('<form id="aspnet"><div id="nav">n</div><main>Story</main></form>') == "Story"
    assert text('<article>Story</article><div class="related"><article>teaser</article></div><aside><article>no</article></aside>') == "Story"
    assert text('<main>Story</main><div hidden><article>gone</article></div>') == "Story"


def test_entry_queries_exist():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {"pipeline"} | {f"op{n}" for n in range(1, 11)} <= names | {n.split("_")[0] for n in names}


def test_pipeline_deduplicates_repeated_and_null_ids(spark):
    """Both deduplications against brute force, row by row."""
    import corpus_pipeline

    rng = random.Random(7)
    base = [[rng.choice("abcdefgh") + str(rng.randrange(50)) for _ in range(60)] for _ in range(5)]
    close = lambda b: " ".join([*b[:30], "x" + str(rng.randrange(99)), *b[31:]])
    rows = [(7, " ".join(base[0])), (7, " ".join(base[0])), (7, " ".join(base[1])), (3, " ".join(base[1])), (None, " ".join(base[0])), (None, " ".join(base[2])), (None, " ".join(base[2])), (4, close(base[2])), (4, close(base[3])), (4, " ".join(base[4])), (2, close(base[4])), (9, "  ".join(base[3])), (5, None), (6, ""), (None, close(base[1]))]
    order = lambda r: (r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest())
    left = {}
    for r in sorted(rows, key=order):
        bare = re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")
        if bare not in left or len(r[1] or "") > len(left[bare][1] or ""):
            left[bare] = r
    docs = frame(spark, rows)
    exact = corpus_pipeline.exact(spark, docs, "")
    assert exact.columns == docs.columns
    text = lambda found: sorted([(r[0], r[1] or "") for r in found], key=order)
    assert text(exact.select("doc_id", "text").collect()) == text(left.values())

    distinct = sorted({(r[0], r[1] or "") for r in rows}, key=order)
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (words(t) for _, t in distinct)]
    part = list(range(len(distinct)))
    for a in range(len(part)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((part[a], part[b]))
                part = [x if v == y else v for v in part]
    best = [distinct[k] for k in sorted(set(part))]
    assert text(corpus_pipeline.near(spark, docs, "").select("doc_id", "text").collect()) == text(best) != text(rows)


def test_revisits_equal_brute_force(spark):
    """Revisits of other captures of the same URL, before any response, in later buckets and without validators."""
    from termloom.llm import warc

    rng = random.Random(11)
    shapes = ["http://H{}.x/a?b=1&a=2#f", "HTTP://h{}.X:80/a?a=2&utm_source=z&b=1", "http://h{}.x/a?a=2&b=1&gclid=7"]
    tag = lambda: rng.choice([None, "t1", "t2", "W/t1", "W/t2"])
    rows = []
    for k in range(240):
        headers = {"etag": str(k), "content-type": f"c{k}", **({"age": str(k)} if k % 2 else {"via": "v"})}
        ts = None if k % 40 == 0 else rng.randrange(0, 5 * 86_400, 43_200)
        rows.append((k, rng.choice(shapes).format(rng.randrange(9)), ts, "revisit" if rng.random() < 0.5 else "response", tag(), rng.choice([None, "m1", "m2"]), headers if k % 13 else None))
    host = lambda url: re.search(r"(?i)h(\d)", url)[1]
    at = lambda r: (-1 if r[2] is None else r[2], r[0])
    bare = lambda t: t and t.removeprefix("W/")
    expected = {}
    for r in (r for r in rows if r[3] == "revisit"):
        base = max((x for x in rows if x[3] == "response" and host(x[1].split("//")[1]) == host(r[1].split("//")[1]) and at(x) < at(r)), key=at, default=None)
        own, status = r[6] or {}, "unresolved"
        if base:
            pair = next(((bare(a), bare(b)) for a, b in ((r[4], base[4]), (r[5], base[5])) if a and b), None)
            status = "unverified" if pair is None else "resolved" if pair[0] == pair[1] else "mismatch"
        if status in ("resolved", "unverified"):
            own = (base[6] or {}) | {k: v for k, v in own.items() if k not in warc.KEPT_FIELDS}
        expected[r[0]] = (f"http://h{host(r[1].split('//')[1])}.x/a?a=2&b=1", base and base[0], status, own)
    records = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, etag string, last_modified string, headers map<string,string>")
    got = {r.record_id: (r.canonical_url, r.resolved_id, r.status, r.headers) for r in warc.resolve_revisits(records).collect()}
    assert got == expected
    assert {v[2] for v in expected.values()} == {"resolved", "mismatch", "unverified", "unresolved"}


def test_revisits_without_a_url_stay_unresolved(spark):
    from termloom.llm import warc

    schema = "record_id long, url string, ts long, kind string, etag string, last_modified string, headers map<string,string>, bucket int"
    rows = [(k, u, k, kind, "t", None, {"a": "b"}, 3) for k, (u, kind) in enumerate([(None, "response"), (None, "revisit"), ("", "response"), (" ", "revisit"), ("http://h/", "revisit"), ("http://h/", None)])]
    got = {r.record_id: (r.canonical_url, r.resolved_id, r.status, r.headers) for r in warc.resolve_revisits(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: (None, None, "unresolved", {"a": "b"}), 3: (None, None, "unresolved", {"a": "b"}), 4: ("http://h/", None, "unresolved", {"a": "b"})}
    assert warc.resolve_revisits(spark.createDataFrame([], schema)).count() == 0


def test_digest_index_of_several_runs(spark):
    index = exactdedup.DigestIndex(spark)
    runs = [[(b"a", 5, 3), (b"b", 2, 1)], [(b"a", 4, 3), (b"c", 9, 0)], [(b"a", 1, 2)]]
    frame_of = lambda rows: spark.createDataFrame([(bytearray(d), i, n) for d, i, n in rows], "digest binary, doc_id long, points long")
    for rows in runs:
        index.flush(frame_of(rows))
    assert {(bytes(r.digest), r.doc_id, r.points) for r in index.lookup([b"a", b"z"]).collect()} == {(b"a", 5, 3), (b"a", 4, 3), (b"a", 1, 2)}
    assert {(bytes(r.digest), r.keep_id, r.group_size) for r in index.compact().collect()} == {(b"a", 4, 3), (b"b", 2, 1), (b"c", 9, 1)}
    assert [len(x) for x in index.levels] == [3]
    index.flush(frame_of([(b"c", 3, 0), (b"a", None, 9)]))  # the fourth run: the level is merged into the next
    assert [len(x) for x in index.levels] == [0, 1]
    merged = {(bytes(r.digest), r.doc_id, r.points, r.n) for r in index.entries().collect()}
    assert merged == {(b"a", 4, 3, 4), (b"b", 2, 1, 1), (b"c", 3, 0, 2)}
    index.flush(frame_of([(b"d", 1, 1), (b"c", 1, 0)]))
    assert {(bytes(r.digest), r.doc_id, r.n) for r in index.known(frame_of([(b"c", 0, 0), (b"z", 0, 0)])).collect()} == {(b"c", 1, 3)}


def test_exact_dedup_through_many_memtables(spark, monkeypatch):
    monkeypatch.setattr(exactdedup, "MEMTABLE_ROWS", 100)
    rows = [(k, f"text {k % 37}" + " " * (k % 3)) for k in range(900)] + [(None, "text 1" + " " * 9)]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exactdedup.exact_dedup(frame(spark, rows).repartition(9)).collect()}
    groups = {}
    for i, t in rows:
        groups.setdefault(t.replace(" ", ""), []).append((i is None, -len(t), i))
    want = {i: (min(g)[2], len(g), i == min(g)[2] or min(g)[2] is None) for g in groups.values() for _, _, i in g}
    assert got == want


def test_exact_dedup_loses_no_row_when_files_are_cut_otherwise_between_flushes(spark, monkeypatch):
    monkeypatch.setattr(exactdedup, "MEMTABLE_ROWS", 2500)
    flush, sizes, before = exactdedup.DigestIndex.flush, iter(["1k", "128m", "3k", "64k"]), spark.conf.get("spark.sql.files.maxPartitionBytes")

    def other_cut(self, entries):
        spark.conf.set("spark.sql.files.maxPartitionBytes", next(sizes))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        return flush(self, entries)

    monkeypatch.setattr(exactdedup.DigestIndex, "flush", other_cut)
    try:
        got = exactdedup.exact_dedup(frame(spark, [(k, f"t{k % 9000}") for k in range(10000)]).repartition(13)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert {r.doc_id: (r.keep_id, r.group_size) for r in got} == {k: (k % 9000, 2 if k % 9000 < 1000 else 1) for k in range(10000)} and len(got) == 10000


def edit_log(rng, conversations):
    """A log of streamed deltas, edits, regenerations and deletions, out of order, and its sequential fold."""
    log, want, seq = [], {}, 0
    for conv in range(conversations):
        messages = [f"m{k}" for k in range(rng.randrange(1, 6))]
        state = {}
        for _ in range(rng.randrange(1, 40)):
            m, kind, text = rng.choice(messages), rng.choice(["delta"] * 8 + ["edit", "regenerate", "delete"]), rng.choice(["a", "<|im_end|>", "é ", "", "\n"])
            role = rng.choice(["user", "assistant", None])
            seq += 1
            log.append((conv, m, seq, kind, role, text))
            old, said = state.get(m, (None, None))
            state[m] = (None if kind == "delete" else text if kind != "delta" or old is None else old + text, said if role is None else role)
        want[conv] = [(state[m][1] or "", state[m][0]) for m in sorted(state) if state[m][0] is not None]
    rng.shuffle(log)
    return log, {c: t for c, t in want.items() if t}


def test_chat_fold_equals_a_sequential_one(spark):
    log, want = edit_log(random.Random(12), 60)
    events = spark.createDataFrame(log, "conv_id long, message string, seq long, kind string, role string, text string")
    got = chat.render(chat.fold_events(events)).select("conv_id", chat.parse(chat.F.col("formatted")).alias("turns")).collect()
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in got} == want


def test_conversation_events_stream_texts(spark):
    """A table becomes a log whose sequence numbers and deltas matter: shuffled and folded it gives the table again."""
    rows = [(1, 0, "user", "x" * 5000 + "é𝒳"), (1, 1, "assistant", "<|im_end|>" * 300), (1, 1, "assistant", "<|im_end|>" * 300), (1, None, None, None), (2, 3, "user", "")]
    events = chat.conversation_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    log = events.collect()
    assert len(log) > len(rows) and len({(r.conv_id, r.message, r.seq) for r in log}) == len(log)
    got = chat.render(chat.fold_events(events.orderBy("text"))).select("conv_id", chat.parse(chat.F.col("formatted")).alias("turns")).collect()
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in got} == {1: [("", ""), *[(r, t) for _, _, r, t in rows[:3]]], 2: [("user", "")]}
