import random

import pytest

from paddock.llm import html_text as H

SCHEMA = "page_id long, url string, html string, text string, path string"


def texts(spark, rows, parts=3):
    docs = spark.createDataFrame([(i, u, h, "clash", "clash") for i, u, h in rows], SCHEMA).repartition(parts)
    return {(r["page_id"], r["url"]): (r["text"], r["n_shared"]) for r in H.main_texts(docs).collect()}


@pytest.mark.parametrize(("html", "want"), [
    ("<body><nav>m</nav><article><h1>T &amp; U</h1><p>a&nbsp;b\n  c<p>d <i>e</i>f<br>g</article><footer>x</footer>", "T & U\na b c\nd ef g"),
    ("<header>top</header><main><header><h1>Title</h1></header><p>x</main><aside>y</aside>", "x"),
    ("<article><header><h1>Title</h1></header><p>x</p><section class='comments'><p>bad</section></article>", "Title\nx"),
    ("<article><p>a<script>var t='</p>';</script>b<style>p{}</style></p><!-- <p>no</p> --><form><p>f</form></article>", "ab"),
    ("<article><div class='ad-box'>buy</div><div id=cookie-notice>ok?</div><div hidden>h</div><div style='display: none'>n</div><p title='a>b'>shadow header</p></article>", "shadow header"),
    ("<article><p>1 < 2 &lt;b&gt; &#233;&eacute; &am &amp</article>", "1 < 2 <b> éé &am &"),
    ("<ul><li>x<li>y</ul>z<table><tr><td>1<td>2</table>", "x\ny\nz\n1\n2"),
    ("<p>kept <span class='share'>tweet</span> on</p>", "kept\non"),
    ("plain words", "plain words"),
    ("<div class='layout has-sidebar no-menu'><article class='post'><p>x</article><div class='sidebar'>y</div></div>", "x"),
    ("<article><p>x</p><!-- never closed <p>y", "x"),
    ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>", "deep"),
    ("", ""), ("<br><p></p>", ""),
])
def test_markup(html, want):
    inside, other = H.split_page(html)
    assert "\n".join(inside + [t for t, wanted in other if wanted]) == want


def test_shared_lines_of_the_nearest_page_go(spark):
    page = lambda words, extra="": f"<div>Site name</div><div>Tagline</div>{extra}<p>{words}</p><div>All rights reserved</div>"
    rows = [(1, "http://a.example/news/1", page("first story")), (2, "http://a.example/news/2.html?x=1", page("second story", "<p>more</p>")),
            (3, "https://b.example/1", page("lone page")), (4, None, page("no url")), (5, "http://a.example/news/1#top", page("first story")),
            (6, "HTTP://A.example/other/page", page("other story"))]
    got = texts(spark, rows)
    keep = "Site name\nTagline\n{}\nAll rights reserved"
    assert got[1, rows[0][1]] == ("first story", 3) and got[5, rows[4][1]] == ("first story", 3)
    assert got[2, rows[1][1]] == ("more\nsecond story", 3)
    assert got[6, rows[5][1]] == ("other story", 3)
    assert got[3, rows[2][1]] == (keep.format("lone page"), 0) and got[4, None] == (keep.format("no url"), 0)


def test_copies_of_an_article_keep_their_text(spark):
    html = "<nav>menu</nav><article><p>same story</p></article>"
    got = texts(spark, [(1, "http://a.example/1", html), (2, "http://a.example/2", html), (3, "http://a.example/2", None), (3, "http://a.example/2", "")])
    assert got[1, "http://a.example/1"] == ("same story", 1) and got[2, "http://a.example/2"][0] == "same story"
    assert got[3, "http://a.example/2"] == ("", 0)


def test_nearest_pages_equal_a_sorted_list(spark):
    rng = random.Random(4)
    places = sorted({("hot" if rng.random() < 0.6 else f"h{rng.randrange(9)}", "/" + "".join(rng.choice("ab/") for _ in range(rng.randrange(6)))) for _ in range(300)})
    rows = [(h, p, [i]) for i, (h, p) in enumerate(places)]
    want = {}
    for i, (h, p, _) in enumerate(rows):
        near = [(H._common_prefix(p, rows[j][1]), -k, j) for k, j in enumerate((i - 1, i + 1)) if 0 <= j < len(rows) and rows[j][0] == h]
        want[h, p] = rows[max(near)[2]][2] if near else None
    df = spark.createDataFrame(rows, "host string, path string, lines array<long>").repartition(5)
    for parts in (1, 8, 40):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            assert {(r["host"], r["path"]): r["partner"] for r in H.nearest_pages(df).collect()} == want
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 8)


def test_common_lines_are_a_longest_common_subsequence():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        shared = sorted(H.common_lines(a, b))
        assert len(shared) == best[-1][-1]
        it = iter(b)
        assert all(any(a[i] == y for y in it) for i in shared)


def test_given_pages(spark, sf_small):
    pages = spark.read.parquet(f"{sf_small}/pages.parquet")
    got = H.main_texts(pages).toPandas()
    assert len(got) == pages.count() and (got["n_chars"] == got["text"].str.len()).all()
    assert not got["text"].str.contains("<p>|&amp;|©", regex=True).any()
    assert H.main_texts(pages.where("false")).collect() == []


def test_long_page_in_linear_time():
    html = "<article>" + "<p class='x'>word &amp; word</p>\n" * 60_000 + "</article>"
    assert len(H.split_page(html)[0]) == 60_000
    assert H.split_page("<" * 200_000)[1] and H.split_page("<!--" * 100_000) == ([], [])
