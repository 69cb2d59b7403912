import random

from termloom.llm import htmltext


def text(page):
    return htmltext.block_text(htmltext.main_roots(htmltext.parse(page)), set())


def test_names_that_only_look_like_marks_stay_in_an_article():
    page = '<article><p>A</p><div class="share-price">up 5</div><section id="notice-period">six weeks</section><div class="comment-list">no</div><div class="share-buttons">no</div><div class="ad">no</div><aside>no</aside></article>'
    assert text(page) == "A up 5 six weeks"


def test_a_lead_beside_a_card_stays():
    assert text("<main><p>A long lead about the matter at hand</p><div><article>card</article></div></main>") == "A long lead about the matter at hand card"
    assert text("<main><p>short</p><article>The article itself, which is longer</article></main>") == "The article itself, which is longer"


def largest(x, y):
    """Simple tree matching by its recurrence."""
    if x[0] != y[0]:
        return 0
    table = [[0] * (len(y[2]) + 1) for _ in range(len(x[2]) + 1)]
    for i, c in enumerate(x[2], 1):
        for j, d in enumerate(y[2], 1):
            table[i][j] = max(table[i - 1][j], table[i][j - 1], table[i - 1][j - 1] + largest(c, d))
    return table[-1][-1] + 1


def test_alignment_is_as_large_as_the_recurrence_says():
    rng = random.Random(9)

    def tree(depth):
        return [rng.choice("abc") if depth < 3 else "r", rng.randrange(3), [tree(depth - 1) for _ in range(rng.randrange(5))] if depth else []]

    for _ in range(150):
        x, y = tree(3), tree(3)
        pairs = htmltext.align(x, y)
        assert len(pairs) == largest(x, y) == len({id(p) for p, _ in pairs}) == len({id(q) for _, q in pairs})
        assert all(p[0] == q[0] for p, q in pairs)
    wide = ["r", 0, [["p", k, []] for k in range(3000)]]
    assert len(htmltext.align(wide, ["r", 0, [["div", 0, []], *wide[2][5:]]])) == 2996


def test_planted_articles_on_hosts_without_marks(spark):
    """No element names, classes or roles tell: only what varies from page to page is the article."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    rows, want = [], {}
    for host in range(3):
        menu, foot = ([" ".join(word() for _ in range(3)) for _ in range(4)] for _ in range(2))
        for k in range(12):
            blocks = [" ".join(word() for _ in range(rng.randrange(3, 30))) for _ in range(rng.randrange(1, 6))]
            page = "<body><div>" + "".join(f"<span><a>{m}</a></span>" for m in menu) + "</div><div>" + "".join(f"<p>{b}</p>" for b in blocks) + "</div><div>" + "".join(f"<span>{m}</span>" for m in foot) + "</div></body>"
            rows.append((host * 100 + k, f"http://h{host}.org/{k}", page, "clash"))
            want[host * 100 + k] = " ".join(blocks)
    rows += [rows[0], (900, None, "<p>alone</p>", None), (901, "http://h0.org/none", None, None), (902, "http://h0.org/", "", None)]
    want |= {900: "alone", 901: "", 902: ""}
    got = htmltext.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()
    assert len(got) == len(rows) and {r.page_id: r.text for r in got} == want
    assert htmltext.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
