from sourceweave.llm.wrappers import expression, extract, folded, infer_wrappers, main_text, merged, parse

PAGE = (
    '<!doctype html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>'
    '<nav><ul><li><a href="/x">Menu</a><li>B</ul></nav><header>Top</header><div class="ad">Buy</div>'
    "<article><h1>Head &amp; line</h1><p><b>First\n  one.<br>Still<p>Second &eacute;&nbsp;x &#8364; &am</p>"
    '<aside>Side</aside><form>f<input value="a>b"><button>Go</button></form><ul><li>i<li>j</ul>'
    '<div id="reader-comments"><p>Me too</div></article><footer>&copy; F</footer>'
)
TEXT = "Head & line\n\nFirst one. Still\n\nSecond é x € &am\n\ni\n\nj"


def test_article_of_one_page():
    assert extract(PAGE) == TEXT
    assert extract(None) == extract("") == extract("<p>") == ""
    assert extract("plain &lt;text") == "plain <text"
    assert extract("<p>" + "long " * 200_000) == ("long " * 200_000).strip()
    assert extract("<div><div hidden>x</div><p>a</p><p style='display: none'>b</p></div>") == "a"


def test_alignment_makes_slots_groups_and_options():
    a = folded(parse("<body><ul><li>a</li><li>b</li></ul><div>c</div><p>same</p></body>"))[1]
    b = folded(parse("<body><ul><li>d</li></ul><p>same</p><hr><table><tr><td>e</table></body>"))[1]
    assert expression(merged(a, b)) == '(body(ul(li(#)+) div(")? p(") table(tr(td(")))?))'


def pages_of(spark, bodies, host="h.example"):
    return spark.createDataFrame([(i, f"http://{host}/{i}", b, 1) for i, b in enumerate(bodies)], "page_id long, url string, html string, n_chars int")


def test_template_text_and_region_without_article_tags(spark):
    bodies = [f"<body><div class=box><p>Call us now</p><div class=main><h2>Title {i}</h2><p>Words of page {i} go on {'and on ' * i}</p></div></div></body>" for i in range(8)]
    wrapper = infer_wrappers(pages_of(spark, bodies).selectExpr("html", "'h' as host")).collect()[0]
    assert wrapper.pages == 8 and wrapper.wrapper == '(body(div.box(p(") div.main(h2(#) p(#)))))'
    got = {r.page_id: r for r in main_text(pages_of(spark, bodies)).collect()}
    for i, r in got.items():
        assert r.text == f"Title {i}\n\n" + f"Words of page {i} go on {'and on ' * i}".strip() and r.n_chars == len(r.text)


def test_copies_are_no_template(spark):
    """A text that all copies of a page share stays; one that pages with different articles share is template."""
    same = [PAGE] * 9
    assert {r.text for r in main_text(pages_of(spark, same)).collect()} == {TEXT}
    common = [f"<article><h1>A{i}</h1><p>A line that all share</p><p>own {i}</p></article>" for i in range(9)]
    assert {r.page_id: r.text for r in main_text(pages_of(spark, common)).collect()} == {i: f"A{i}\n\nown {i}" for i in range(9)}
    assert {r.page_id: r.text for r in main_text(pages_of(spark, common[:4])).collect()} == {i: f"A{i}\n\nA line that all share\n\nown {i}" for i in range(4)}
    outside = [f"<article><h1>A</h1><p>same</p></article><p>other {i}</p>" for i in range(9)]
    assert {r.text for r in main_text(pages_of(spark, outside)).collect()} == {"A\n\nsame"}


def test_the_wrapper_decides_inside_the_article(spark):
    """Generated pages of known text: notices that a page alone doesn't give away, headings, lists and tables that stay."""
    bodies, want = [], []
    for i in range(12):
        parts = [f"Paragraph {j} of {i}" for j in range(1 + i % 4)]
        tip = "<div class=tip><h3>Tip</h3><p>Install our app</p></div>" if i % 3 else ""
        bodies.append(
            f"<body><article><h1>Title {i}</h1>{tip}<h2>Summary</h2><p>{'</p><p>'.join(parts)}</p><p>Follow us everywhere</p>"
            f"<h2>Data</h2><table><tr><th>Size</th><td>{i} m</td></tr></table><h2>More</h2><div class=end><p>Printed on paper</p></div></article></body>"
        )
        want.append("\n\n".join([f"Title {i}", "Summary", *parts, "Data", "Size", f"{i} m"]))
    got = {r.page_id: r.text for r in main_text(pages_of(spark, bodies)).collect()}
    assert got == dict(enumerate(want))
    assert all(extract(body) != text for body, text in zip(bodies, want, strict=True))


PROBES = [
    ("<article><h1>H</h1><button>Share</button><p>Para one.</p><p>Para two.</p></article>", "H\n\nPara one.\n\nPara two."),
    ("<article><p data-hidden>kept</p><p class=x hidden>gone</p><p data-x='hidden'>too</p></article>", "kept\n\ntoo"),
    ("<div class=post><p>The post</p></div><article class=comment><p>Me too and longer</p></article>", "The post"),
    ("<article><p>The post</p></article><article class='comment even'><p>Me too</p></article>", "The post"),
    ("<main><article><p>The post</p></article><article class=comment-body><p>Me too, said at length</p></article></main>", "The post"),
    ("<main><p>The post</p><div class=related><article class=teaser><p>Read this</p></article></div></main>", "The post"),
    ("<article><p>Short post</p><section id=comments><p>A comment that is longer than all of the post</p></section></article>", "Short post"),
    ("<div class=x><p>Short post</p></div><div class=sidebar><p>A sidebar that is longer than all of the post</p></div>", "Short post"),
    ("<article class='post comments-open has-ads'><p>The post</p></article><p>Other</p>", "The post"),
    ("<article><p class=\"x>The post</p></article>", "The post"),
    ("<article><p>The post</p><p>has <math><mi>a</mi><mo>+</mo><mn>1</mn><annotation>a+1</annotation></math> in it</p></article>", "The post\n\nhas a+1 in it"),
    ("<div class=comments><p>Nothing but comments</p></div>", "Nothing but comments"),
]


def test_probes():
    for page, text in PROBES:
        assert extract(page) == text, page
    assert extract("<article><p>a</p>" + "<p>word</p><button>b</button>" * 50_000 + "</article>").count("word") == 50_000


def test_edges(spark):
    rows = [(1, None, PAGE), (2, "no host", PAGE), (3, "http://a/", None), (4, "http://a/", ""), (None, "http://a/", PAGE), (5, "http://a/", PAGE), (5, "http://a/", PAGE)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as text", "'y' as host", "'z' as path")
    got = main_text(pages).collect()
    assert len(got) == 7 and sum(r.text == TEXT for r in got) == 5 and {r.n_chars for r in got if r.page_id in (3, 4)} == {0}
    assert main_text(pages.limit(0)).collect() == []


SHAPES = [
    "<ul><li>{0}</li><li>{0}</li></ul>",
    "<blockquote><p>{0}</p><p>{0}</p></blockquote>",
    "<table><tr><td>{0}</td><td>{0}</td></tr></table>",
    "<section><p>{0}</p></section><section><h2>more</h2><p>{0}</p></section>",
]


def test_most_of_the_text_in_one_part_keeps_the_others(spark):
    """A list, quote, table or section that holds most of an article without an article tag."""
    bodies, want = [], []
    for i in range(40):
        long = f"{i} long part of the page " * 8
        bodies.append(f"<body><div class=top><a href=/>Home</a></div><div class=post><h1>T{i}</h1><p>intro {i}</p>{SHAPES[i % 4].format(long)}<p>end {i}</p></div><div class=foot><p>All rights reserved</p></div></body>")
        want.append([f"T{i}", f"intro {i}", long.strip(), *(["more"] if i % 4 == 3 else []), long.strip(), f"end {i}"])
    for r in main_text(pages_of(spark, bodies)).collect():
        assert r.text.split("\n\n") == want[r.page_id]
    for body, parts in zip(bodies[:4], want, strict=False):
        assert extract(f"<body>{body[body.index('<div class=post>'):body.index('<div class=foot>')]}</body>").split("\n\n") == parts


def test_each_page_decides_where_a_host_mixes_templates(spark):
    few = [f"<body><div class=a><p>short {i}</p></div><div class=b><p>{'other text ' * 9}{i}</p></div></body>" for i in range(3)]
    many = [f"<body><div class=a><p>{'long text ' * 50}{i}</p></div></body>" for i in range(30)]
    got = {r.page_id: r.text for r in main_text(pages_of(spark, few + many)).collect()}
    assert all(got[i] == f"short {i}\n\n{'other text ' * 9}{i}" for i in range(3))


def test_a_part_of_one_copied_page_is_no_template(spark):
    copied = "<body><div class=post><p>Own</p><table><tr><td>Only here</td></tr></table></div></body>"
    others = [f"<body><div class=post><p>Text {i}</p></div></body>" for i in range(9)]
    got = {r.page_id: r.text for r in main_text(pages_of(spark, [copied] * 9 + others)).collect()}
    assert got[0] == "Own\n\nOnly here" and got[9] == "Text 0"


WORDY = [
    '<body class="single has-sidebar"><div><p>{0}</p></div></body>',
    '<html class="no-js cookies"><body><div class=x><p>{0}</p></div></body></html>',
    '<body><article class="post comments-open"><p>{0}</p></article></body>',
    '<body><main class="with-sidebar"><p>{0}</p></main></body>',
    '<body><div id="page-widget"><article><p>{0}</p></article></div><p>Other text that is longer than the short article is</p></body>',
    '<body><div id="social-history"><p>{0}</p></div><div class="newsletter"><p>Get it</p></div></body>',
    '<body><div class="menu-wrap"><div class="banner-box"><p>{0}</p><div class="share"><p>Share</p></div></div></div></body>',
]


def test_class_words_never_discard_the_article(spark):
    for shape in WORDY:
        assert extract(shape.format("The article of the page")) == "The article of the page"
        got = main_text(pages_of(spark, [shape.format(f"The article of page {i}") for i in range(8)])).collect()
        assert {r.text for r in got} == {f"The article of page {i}" for i in range(8)}


def test_a_long_notice_that_all_pages_share_is_discarded(spark):
    """It holds most of a page's text, but is template."""
    bodies = [f"<body><div class=cookie-box><p>{'We use cookies. ' * 30}</p></div><div class=x><p>Text {i}</p><p>End {i}</p></div></body>" for i in range(8)]
    assert {r.page_id: r.text for r in main_text(pages_of(spark, bodies)).collect()} == {i: f"Text {i}\n\nEnd {i}" for i in range(8)}
