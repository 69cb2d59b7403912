"""Jaccard join, source divergence and hard negatives against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from termloom.llm import meetings, minhash, negatives, ngramjoin, search
from termloom.llm.divergence import divergence
from termloom.llm.shingles import word_numbers

DOCS = "doc_id long, text string, id string, n string, mark string, key string, centre string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", None, "clash", None, None) for i, t in rows], DOCS)


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s, s.translate(str.maketrans("ab", "ba"))


def shingles(text, width):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


def components(sets, percent):
    part = {i: i for i in sets}

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                part[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_words_that_differ_have_other_numbers():
    for n in (64, 1024, 4096):
        a, b = thue_morse(n)
        assert word_numbers(a.encode())[0] != word_numbers(b.encode())[0]
    assert list(word_numbers(b"Ab\tab \x0b aB")) == [word_numbers(b"ab")[0]] * 3 and len(word_numbers(b" \n")) == 0
    rng = random.Random(3)
    some = {"".join(rng.choice("ab") for _ in range(rng.randrange(1, 18))) for _ in range(20000)}
    assert len(set(word_numbers(" ".join(some).encode()).tolist())) == len(some)


def test_long_words_that_differ_are_not_linked_or_found(spark):
    a, b = thue_morse(4096)
    rows = frame(spark, [(1, a), (2, b), (3, a), (4, f"x y z {b}")])
    for found in (minhash.near_dedup(rows, width=2, percent=80), ngramjoin.jaccard_join(rows, width=4, percent=85)):
        assert {r.doc_id: r.component_id for r in found.collect()} == {1: 1, 2: 2, 3: 1, 4: 4}
    best = search.top_k(rows, spark.createDataFrame([(7, a)], "query_id long, text string"), k=10).collect()
    assert {r.doc_id for r in best} == {1, 3}


@pytest.fixture(scope="module")
def texts():
    """Near copies of twelve texts with few and many changes, a line that most share, license-like texts, junk and ties."""
    rng = random.Random(11)
    word = lambda: rng.choice("abcdefghijklmnopqrst") + str(rng.randrange(60))
    line = " ".join(word() for _ in range(12))
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "One"), (4, "one"), (5, "one two"), (6, "one two three four"), (7, "ONE two three four"), (8, "one two three"), (9, line), (10, line + " end")]
    for _ in range(12):
        base = [word() for _ in range(rng.randrange(20, 200))]
        for _ in range(14):
            w = list(base)
            for _ in range(rng.randrange(0, 5)):
                w[rng.randrange(len(w))] = "x" + str(rng.randrange(1000))
            rows.append((len(rows) + 10, " ".join(w) + (" " + line if rng.random() < 0.7 else "")))
    return rows


@pytest.mark.parametrize(("width", "percent", "hot"), [(4, 85, 3), (2, 60, 5), (1, 100, 64)])
def test_jaccard_join_equals_brute_force(spark, texts, monkeypatch, width, percent, hot):
    monkeypatch.setattr(ngramjoin, "HOT", hot)
    monkeypatch.setattr(meetings, "BLOCK", 4)  # buckets are cut into blocks
    sets = {i: shingles(t, width) for i, t in texts}
    part = components(sets, percent)
    got = ngramjoin.jaccard_join(frame(spark, texts).repartition(3), width=width, percent=percent).collect()
    assert len(got) == len(texts)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, len(sets[i]), part[i]) for i in sets}


def test_no_link_is_lost_at_the_threshold(spark):
    """Pairs at, just above and just below 85 percent."""
    rng, rows = random.Random(2), []
    for k in range(200):
        base = [f"{k}x{i}" for i in range(rng.choice([7, 20, 100, 173]))]
        other = list(base)
        for i in range(max(0, round(len(base) * 0.081) + rng.randrange(-1, 2))):
            other[i] = f"{k}y{i}"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    part = components({i: shingles(t, 1) for i, t in rows}, 85)
    got = {r.doc_id: r.component_id for r in ngramjoin.jaccard_join(frame(spark, rows), width=1, percent=85).collect()}
    assert got == part and 60 < sum(part[2 * k + 1] == 2 * k for k in range(200)) < 190


@pytest.mark.parametrize("block", [1024, 16])
def test_a_row_is_once_in_the_buckets_of_a_group(spark, monkeypatch, block):
    """Near copies, and rows that share bands with them but are linked with none of them: these meet once and not for each band."""
    rng, base = random.Random(11), [f"w{k}" for k in range(60)]

    def changed(words, name, count):
        at = rng.sample(range(1, 59, 2), count)
        return [f"{name}x{k}" if k in at else w for k, w in enumerate(words)]

    rows = {0: base} | {i: changed(base, i, rng.choice([1, 2])) for i in range(1, 100)} | {i: changed(base, i, 4) for i in range(100, 150)}
    rows |= {i + 100: changed(rows[i], i + 100, 1) for i in range(100, 110)}
    counted, write = [], meetings.materialise

    def spied(df, tag, *rest):
        out = write(df, tag, *rest)
        if tag == "late":
            counted.append((out.count(), out.select("id").distinct().count()))
        return out

    monkeypatch.setattr(meetings, "materialise", spied)
    monkeypatch.setattr(minhash, "BLOCK", block, raising=False)
    got = {r.doc_id: r.component_id for r in minhash.near_dedup(frame(spark, [(i, " ".join(w)) for i, w in rows.items()]), width=2, percent=80).collect()}
    assert got == components({i: shingles(" ".join(w), 2) for i, w in rows.items()}, 80)
    (met, ids), = counted
    assert ids > 100 and (block == 16 or met <= 3 * ids)


def test_orders_share_a_prefix_element():
    for n in range(1, 200):
        for percent in (1, 50, 85, 100):
            p = ngramjoin.prefix_length(n, percent)
            assert 1 <= p <= n and n - p < math.ceil(percent * n / 100)


def test_frequent_shingles_are_counted_over_all_tasks(spark):
    rows = frame(spark, [(i, f"same line here {i}") for i in range(300)]).repartition(3)
    found = ngramjoin.frequent_map(rows.select("text"), 1)
    assert int(np.bitwise_count(found).sum()) == 3


def test_join_of_odd_tables(spark):
    rows = frame(spark, [(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e")])
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in ngramjoin.jaccard_join(rows, width=4, percent=85).collect())
    assert got == [(0, 2, 0), (1, 2, 1), (1, 2, 1), (2, 2, 1)]
    assert ngramjoin.jaccard_join(frame(spark, []), width=4).count() == 0
    for percent in (0, 101):
        with pytest.raises(ValueError):
            ngramjoin.jaccard_join(rows, percent=percent)


def brute_divergence(rows, least, top):
    rows = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))) for lang, source, text in rows]
    out = set()
    for lang in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == lang]
        df = Counter(t for _, _, w in own for t in set(w))
        kept = sorted(t for t in df if df[t] >= least)
        count = defaultdict(Counter)
        for _, source, w in own:
            count[source].update(t for t in w if df[t] >= least)
        everything = sum(count.values(), Counter())
        p = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}  # noqa: B023, E731
        all_p, by = p(everything), {s: p(c) for s, c in count.items()}
        for s in by:
            pairs = [(-sum(abs(by[s][t] - by[o][t]) for t in kept), o.encode(), o) for o in by if o != s]
            marks = [(all_p[t] - by[s][t], t.encode(), t) for t in kept if count[s][t] > 0 and by[s][t] > all_p[t]]
            out |= {(lang, s, "pair", x[2], -x[0], k + 1) for k, x in enumerate(sorted(pairs))} | {(lang, s, "term", x[2], -x[0], k + 1) for k, x in enumerate(sorted(marks)[:top])}
    return out


def test_divergence_equals_brute_force(spark):
    rng, rows = random.Random(4), []
    vocabulary = ["Wort", "straße", "été", "ÉTÉ", "x", "naïve", "Ω", "ω", "日本", "zebra"] + [f"{c}q" for c in "abcdefgh"]
    for _ in range(400):
        text = rng.choice([" ", "-", "1", "\x00"]).join(rng.choices(vocabulary, weights=range(1, len(vocabulary) + 1), k=rng.randrange(0, 12)))
        rows.append((rng.choice(["en", "en", "de", None, ""]), rng.choice(["a", "b", "c", None, "Ω", "é"]), rng.choice([text, text, text, None])))
    rows += [("one", "alone", "zebra"), ("few", "a", "zebra"), ("few", "b", None)]
    docs = spark.createDataFrame([(*r, 1, "clash") for r in rows], "lang string, source string, text string, term long, p string").repartition(5)
    for least, top in ((5, 3), (30, 50)):
        got = [tuple(r) for r in divergence(docs, least_docs=least, top=top).select("lang", "source", "part", "item", "value", "rank").collect()]
        assert len(got) == len(set(got)) and set(got) == brute_divergence(rows, least, top)
    assert divergence(docs.limit(0)).count() == 0


def brute_negatives(rows, positives, negatives_, low, high, anchor):
    good = [(i, label, [math.floor(256 * x) for x in v]) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    anchors = {}
    for i, label, v in good:
        if anchor(i):
            anchors[i] = min(anchors.get(i, (label, v)), (label, v))
    for a, (own, v) in anchors.items():
        scored = sorted(((-sum(x * y for x, y in zip(v, w)), i, label) for i, label, w in good if i != a), key=lambda t: t[:2])  # noqa: B905
        for s, p, _ in [t for t in scored if t[2] == own][:positives]:
            hard = [t for t in scored if t[2] != own and low * -s <= 100 * -t[0] <= high * -s][:negatives_]
            out += [(a, p, k + 1, t[1], -s, -t[0]) for k, t in enumerate(hard)]
    return sorted(out)


def vectors(n, width, seed, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    return [(i, [float(np.float32(x)) for x in centres[i % 6] + rng.normal(size=width) * spread], int(rng.integers(0, 4))) for i in range(n)]


SHAPE = "vec_id long, embedding array<float>, label int, id string, v string, block long"


@pytest.mark.parametrize(("width", "seed"), [(4, 1), (16, 2), (1, 3)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, width, seed):
    monkeypatch.setattr(negatives, "SAMPLE", 60)
    monkeypatch.setattr(negatives, "BLOCK_NUMBERS", 1)  # 1,024 rows a block at least
    rows = vectors(1500, width, seed) + [(2000 + k, [1.0] * width, k % 3) for k in range(40)]  # ties
    rows += [(3000, None, 1), (3100, [float("nan")] * width, 1), (3200, [None] * width, 1), (3300, [1.0] * width, None), (3400, [float("inf")] + [0.0] * (width - 1), 1), (None, [1.0] * width, 1), (3500, [], 1), (3600, [0.0] * width, 2), (3700, [-1.0], 0), (7, [0.5] * width, 1), (100, rows[100][1], 3)]
    given = spark.createDataFrame([(*r, "clash", None, 1) for r in rows], SHAPE).repartition(3)
    got = sorted(tuple(r) for r in negatives.mine_hard_negatives(given).collect())
    assert got == brute_negatives(rows, 5, 10, 30, 90, lambda i: i % 100 == 0)


def test_hard_negatives_of_large_and_odd_tables(spark):
    big = [(i, [1e6 * x for x in v], label) for i, v, label in vectors(200, 3, 9)]  # scores beyond 2**53
    given = spark.createDataFrame([(*r, None, None, None) for r in big], SHAPE)
    want = brute_negatives([(i, [float(np.float32(x)) for x in v], label) for i, v, label in big], 2, 3, 10, 95, lambda i: i % 40 == 0)
    assert sorted(tuple(r) for r in negatives.mine_hard_negatives(given, "vec_id % 40 = 0", positives=2, negatives=3, low=10, high=95).collect()) == want and want
    assert negatives.mine_hard_negatives(given.limit(0)).count() == 0
    assert negatives.mine_hard_negatives(given, "false").count() == 0
    with pytest.raises(ArithmeticError):
        negatives.mine_hard_negatives(spark.createDataFrame([(100, [1e30], 1, None, None, None)], SHAPE))


def test_pivots_rule_cells_out():
    """On clustered vectors an anchor with a known bound visits few cells."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 32)) * 100
    rows = np.floor(np.repeat(centres, 50, axis=0) + rng.normal(size=(600, 32)) * 3).astype(np.int64)
    space = negatives._Space(rows, 32, float((rows**2).sum(axis=1).max()))
    pd = space.to_pivots(space.lift(rows))
    cell = pd.argmin(axis=1)
    cells = {int(c): (k, 1, pd[cell == c].min(axis=0), pd[cell == c].max(axis=0)) for k, c in enumerate(np.unique(cell))}
    import pyarrow as pa

    ids, labels = np.arange(600), np.repeat(np.arange(12), 50)
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(labels), pa.array(rows.tolist(), pa.list_(pa.int64())), pa.array([[]] * 600, pa.list_(pa.int64()))], names=["id", "label", "v", "want"])
    visits = sum(b.num_rows for b in negatives._visits(space, (ids, labels, rows), cells, negatives._Positives(5))(iter([batch])))
    assert visits < 0.4 * 600 * len(cells)
