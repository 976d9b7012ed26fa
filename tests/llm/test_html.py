import numpy as np

from lodestone.llm import html_text as H

PAGE = (
    "<html><head><title>t</title><style>p{}</style><script>var t='</p>'</script></head><body><nav><ul>" + "".join(f"<li><a href='x'>menu {i}</a></li>" for i in range(9))
    + "</ul></nav><article><h1>Title</h1><p>" + "First paragraph of the text. " * 8 + "</p><p>" + "Second &amp; last <b>paragraph</b>. " * 6 + "</p></article>"
    + "".join(f"<div>foot {i}</div>" for i in range(6)) + "<!-- a comment that is long enough to be taken for text " + "x " * 90 + "--></body></html>"
)


def test_keeps_text_between_surge_and_dive():
    text, lines, kept = H.main_text(PAGE)
    assert text.startswith("First paragraph") and text.endswith("Second & last paragraph.") and kept == 2 and lines == 18


def brute(lengths, window, surge, dive):
    n, keep, i = len(lengths), [False] * len(lengths), 0
    sums = [sum(lengths[j : j + window]) for j in range(n)]
    while i < n:
        if sums[i] >= surge:
            j = i
            while j < n and not (j > i and sums[j] < dive):
                j += 1
            inside = [x for x in range(i, j) if lengths[x] >= surge / window]
            for x in range(inside[0], inside[-1] + 1) if inside else ():
                keep[x] = True
            i = j
        else:
            i += 1
    return keep


def test_block_sums_against_brute_force():
    r = np.random.default_rng(0)
    for _ in range(200):
        lengths = r.integers(0, 80, r.integers(0, 30)) * (r.random(1) < 0.9)
        assert H.kept_lines(lengths, 3, 120, 60).tolist() == brute(lengths.tolist(), 3, 120, 60)


def test_edges(spark):
    rows = [(1, "u", PAGE, 1), (None, None, None, 1), (2, "u", "", 1), (3, "u", "<script>never closed " + "x" * 500, 1), (3, "u", "<p>" + "long text " * 50_000, 1)]
    out = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string, kept_lines int")).collect()
    assert [(r.page_id, r.text is None, len(r.text or "")) for r in out[1:4]] == [(None, True, 0), (2, False, 0), (3, False, 0)]
    assert len(out[4].text) == 499_999
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_hostile_pages_take_linear_time_and_give_the_same_lines():
    import time

    pages = ["<a" * 200_000, "<script" * 100_000 + "<!-- x -->" + "<div" * 100_000, "<p>text</p>" + "</script " * 100_000, "<!--" * 100_000, "<!" * 200_000 + "<?" * 200_000]
    for page in pages:
        start = time.perf_counter()
        H.lines_of(page)
        assert time.perf_counter() - start < 2, page[:20]
    rng = np.random.default_rng(4)
    bits = ["<p>", "<", ">", "a", " ", "\n", "<!--", "-->", "<script>", "</script>", "<script", "</p", "<b x='", "<!d", "<?x", "&amp;"]
    for _ in range(3000):
        page = "".join(rng.choice(bits, rng.integers(0, 14)))
        plain = H.html.unescape(H._TAG.sub("", H._BREAK.sub("\n", H._DROP.sub(" ", page))))
        assert H.lines_of(page) == [x.strip() for x in H._SPACE.sub(" ", plain).split("\n")], page
