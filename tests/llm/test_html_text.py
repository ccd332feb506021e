import duckdb
import html
import re

import pytest

from labelfold.llm import html_text as h


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("<p>only", "only"), ("a < b & c &lt;p&gt; <b>bold</b> <br>x", "a < b & c <p> bold x"),
    ("<nav>menu</nav><script>var a='</p>'", ""), ("<div><div ", ""),
    ("<article><header><h1>T</h1></header><p>one<p>two <i>it</i>alic</article>", "T\none\ntwo italic"),
    ("<body><article><p>x.</p><form>f</form><div class='comments'><p>A long comment, truly.</p></div></article><footer>z</footer>", "x."),
    ("<article><p>a<br>b\n c</p><!-- no --><style>p{}</style><p>&eacute;&#33;</article>", "a b c\né!"),
    ("<main><p>kept</p><aside>no</aside><div id='cookie-notice'>no</div><div style='display:none'>no</div></main>", "kept"),
])
def test_pages(page, text):
    assert h.main_text(page) == text


def test_article_without_a_name_is_found_by_its_paths():
    story = "".join(f"<p>Paragraph {i}, which is long enough to count, and has its commas and stops. Indeed it has.</p>" for i in range(6))
    page = f"<body><div class='x'><div><a href=a>Home</a></div><div><a href=b>News</a></div></div><div class='story'>{story}<p>Short.</p></div><div>(c)</div></body>"
    got = h.main_text(page).split("\n")
    assert len(got) == 7 and got[-1] == "Short."


def test_paths_aggregate_ratios():
    blocks = h.text_blocks("<div><p>long text, here.</p><p>x</p><ul><li>a</li></ul></div>")
    score, paths = h.path_scores(blocks)
    assert paths[0] == paths[1] != paths[2] and len(score) == 3


def test_all_pages_equal_their_article(spark):
    rows = duckdb.connect().sql("select page_id, html from '/root/testdata/sf0.001/pages.parquet'").fetchall()
    got = {r.page_id: r.text for r in h.query(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(rows)
    for i, page in rows:
        article = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)\b[^>]*>", article))
        assert got[i] == "\n".join(x for x in parts if x)


def test_columns_and_rows(spark):
    df = spark.createDataFrame([(1, None, None, "mine", 7), (1, None, None, "mine", 7), (None, "u", "<p>é</p>" + "<p>x, y.</p>" * 20_000, "t", 1)],
                               "page_id int, url string, html string, text string, extra int")
    out = h.extract(df).orderBy("page_id").collect()
    assert [r.n_chars for r in out] == [1 + 20_000 * 6 - 0, 0, 0] and all(r.extra is not None for r in out)
    assert h.extract(df.limit(0)).count() == 0


LONG = "".join(f"<p>Paragraph {i}, which is long enough to count, and has its commas and stops. Indeed it has.</p>" for i in range(12))
LINES = [f"Paragraph {i}, which is long enough to count, and has its commas and stops. Indeed it has." for i in range(12)]


@pytest.mark.parametrize("page, text", [
    (f"<body><article><h1>T</h1><p>Lead.</p><div class=body>{LONG}</div><p>Closing.</p></article><p>out</p></body>", ["T", "Lead.", *LINES, "Closing."]),
    (f"<body><main><h1>T</h1><section>{LONG}</section><section><p>Short one.</p></section></main></body>", ["T", *LINES, "Short one."]),
    (f"<body><main><div>more</div><article><h1>T</h1><div>{LONG}</div><ul><li>a</li></ul></article></main></body>", ["T", *LINES, "a"]),
    (f"<body><article><h1>T</h1><div>{LONG}</div></article><article><h1>U</h1>{LONG}</article></body>", ["T", *LINES, "U", *LINES]),
    (f"<body><div><a href=a>Home</a></div><div class=story><h1>T</h1><div class=body>{LONG}</div><p>{'A closing line, with words enough to count. ' * 2}</p></div></body>",
     ["T", *LINES, ("A closing line, with words enough to count. " * 2).strip()]),
])
def test_text_beside_a_long_section_is_kept(page, text):
    assert h.main_text(page).split("\n") == text


@pytest.mark.parametrize("page, text", [
    ("<div class='has-sidebar'><article><p>kept</p></article><div class='sidebar'>no</div></div>", "kept"),
    ("<div class='layout-with-sidebar wide'><main><p>kept</p><div class='sidebar-left'>no</div></main></div>", "kept"),
    ("<body class='no-footer'><div id='page-without-nav'><article><p>kept</p></article></div><div class='site-footer'>no</div></body>", "kept"),
    ("<div id='comments'><article class='comment'><p>no</p></article></div><article><p>kept</p></article>", "kept"),
    ("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> be.</p><math/><p>b</p></article>", "Let x=2 be.\nb"),
])
def test_names_of_wrappers_and_formulas(page, text):
    assert h.main_text(page) == text


@pytest.mark.parametrize("piece", ["<div>x. ", "<span>x ", "<b><p>x, y. ", "<div><a href=q>x</a></section>", "<ul><li>x.", "<article>x. "])
def test_deep_nesting_takes_linear_time(piece):
    import time
    t0 = time.time()
    got = h.main_text("<article><p>lead.</p>" + piece * 20_000)
    assert got.startswith("lead.") and time.time() - t0 < 10


def test_repeated_pages_and_equal_scores_come_out_alike(spark):
    page = "<body><div class=a><p>One, two.</p></div><div class=b><p>One, two.</p></div></body>"
    rows = h.extract(spark.createDataFrame([(i, "u", page) for i in (1, 1, 2)], "page_id int, url string, html string")).collect()
    assert {r.text for r in rows} == {"One, two.\nOne, two."} and len(rows) == 3
