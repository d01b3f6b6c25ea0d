import pytest

from retainspark.llm import html as m

ARTICLE = "<article><h1>Head</h1><p>First  one,\n with &amp; sign.</p><p>Second one, with <b>bold</b> words.<br><p>Third &lt;one&gt; here.</p></article>"
WANT = "Head\nFirst one, with & sign.\nSecond one, with bold words.\nThird <one> here."


@pytest.mark.parametrize("around", [
    "<html><body>{}</body></html>",
    "<body><nav><ul><li><a href=/x>Menu</a></li></ul></nav>{}<footer>&copy; foot, note.</footer>",
    "<body><header><h1>Site name</h1></header><div class='sidebar'>Side text, quite long, with a comma.</div>{}",
    "<body><div class=ad>Buy now, it is cheap and very good, really.</div>{}<section id='comments'><p>Nice article, thanks a lot.</p></section>",
    "<body><script>var t='</p><p>no</p>';</script><style>p{{}}</style><!-- no <p>no</p> -->{}<form><label>Name</label><input></form>",
    "<body><div class='cookie-notice'><p>We use cookies, accept them.</p></div>{}<aside><p>Related, things.</p></aside>",
    "<body><noscript><p>Turn it on.</p></noscript><div hidden><p>Hidden text here.</p></div>{}<script>unclosed",
])
def test_only_the_article(around):
    assert m.main_text(around.format(ARTICLE)) == WANT


def test_without_an_article_element_ratios_decide():
    body = "".join(f"<p>Paragraph {i} has a good many words, some commas, and a full stop.</p>" for i in range(6))
    links = "".join(f"<span><a>Link {i}</a></span>" for i in range(12))
    page = f"<body><div class=top>{links}</div><div class=story><h2>Title</h2>{body}</div><div class=end>{links}</div>"
    got = m.main_text(page).split("\n")
    assert got[0] == "Title" and len(got) == 7 and got[1].startswith("Paragraph 0")


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("<html></html>", ""), ("plain words, only.", "plain words, only."), ("<p>a<p>b", "a\nb"), ("<article><p>x &#233;&amp", "x é&"),
    ("<article><p>a\xa0b</p><pre>c\n d</pre></article>", "a b\nc d"), ("<article><ul><li>one<li>two</ul></article>", "one\ntwo"),
    ('<article><p title="a > b">kept</p></article>', "kept"), ('<article><p title="broken>kept</p></article>', "kept"), ("<article><p>1 < 2</p>", "1 < 2"),
])
def test_defined_results(page, want):
    assert m.main_text(page) == want


def test_long_and_deep_pages():
    assert len(m.main_text("<article>" + "<p>word, word.</p>" * 20000)) == 20000 * 11 + 19999
    assert m.main_text("<div>" * 3000 + "deep, text.") == "deep, text."


def test_pages_table(spark, sf_small):
    rows = m.op1_html_text(spark, sf_small).collect()
    docs = {"\n".join(x for x in (" ".join(s.split()) for s in r.text.split("\n")) if x) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf_small}/pages.parquet").count()
    for r in rows:  # the article is a headline and then one whole document
        assert r.n_chars == len(r.text) and r.text.partition("\n")[2] in docs


def test_hard_rows(spark):
    df = spark.createDataFrame([(1, "u", None, "c"), (1, None, "<p>a</p>", "c"), (None, "u", "", "c")], "page_id long, url string, html string, text string")
    got = sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in m.extract(df).collect())
    assert got == [(0, "u", "", 0), (1, "", "a", 1), (1, "u", "", 0)] and m.extract(df.limit(0)).collect() == []


LONG = "A very long paragraph, with commas, and words that go on. " * 20


@pytest.mark.parametrize("page, want", [
    (f"<body><div><h1>Title</h1><p>{LONG}</p></div></body>", ["Title", LONG]),
    (f"<body><ul><li>Home</li></ul><div><h1>Title</h1><p>Short one.</p><p>{LONG}</p><p>The end.</p></div></body>", ["Title", "Short one.", LONG, "The end."]),
    (f"<body><main><h1>Title</h1><p>Intro, short.</p><article><p>{LONG}</p></article></main></body>", ["Title", "Intro, short.", LONG]),
    (f"<body><div><h1>Title</h1><ul><li>{LONG}</li><li>Two.</li></ul></div><div>Menu</div></body>", ["Title", LONG, "Two."]),
    (f"<body><main><article><h1>Title</h1><p>{LONG}</p></article><div><article><a>Teaser</a></article></div></main></body>", ["Title", LONG]),
])
def test_the_container_holds_all_content(page, want):
    assert m.main_text(page).split("\n") == [x.strip() for x in want]


@pytest.mark.parametrize("block", [
    '<h2 id="related-work">Related work</h2>', f'<section id="search"><h2>Search</h2><p>{LONG}</p></section>', f'<div class="side-effects"><p>{LONG}</p></div>',
    f'<p title="a hidden gem">{LONG}</p>', '<p>See <a href="/?id=menu">the card</a> there.</p>', '<p data-id="menu">Short one.</p>',
])
def test_names_do_not_take_article_text(block):
    import re
    got = m.main_text(f"<body><article><h1>Head</h1><p>{LONG}</p>{block}<p>{LONG}</p></article></body>")
    want = [x.strip() for x in re.split(r"</?(?:h2|p|section|div)\b[^>]*>", block) if x.strip()]
    assert got.split("\n") == ["Head", LONG.strip(), *[re.sub("<[^>]*>", "", x) for x in want], LONG.strip()]


@pytest.mark.parametrize("block", ['<div class="share-buttons"><a>Share</a></div>', '<div class="related">' + LONG + '</div>', '<p hidden>' + LONG + '</p>', '<ul class="nav-links"><li>Next</ul>'])
def test_furniture_in_the_article_goes(block):
    assert m.main_text(f"<body><article><h1>Head</h1><p>{LONG}</p>{block}<p>{LONG}</p></article></body>").split("\n") == ["Head", LONG.strip(), LONG.strip()]


@pytest.mark.parametrize("tag", ["article", "div"])
def test_an_article_in_a_named_wrapper(tag):
    assert m.main_text(f"<body><div class='header-fixed'><{tag}><h1>Head</h1><p>{LONG}</p></{tag}></div></body>").split("\n") == ["Head", LONG.strip()]


COMMENT = f"<p>{LONG * 3}</p>"


@pytest.mark.parametrize("comments", [
    f'<section id="comments"><article>{COMMENT}</article></section>', f'<section id="comments" class="x"><article class="a">{COMMENT}</article><article>{COMMENT}</article></section>',
    f'<ol class="comment-list"><li>{COMMENT}</li></ol>', f'<ul class="commentlist"><li><article>{COMMENT}</article></li></ul>', f'<div class="discussion">{COMMENT}</div>',
    f'<div id="reader-comments">{COMMENT}</div>', f'<div id="disqus_thread">{COMMENT}</div>', f'<article class="comment">{COMMENT}</article>', f'<div class="replies">{COMMENT}</div>',
    f'<div class="post-comments-area">{COMMENT}</div>', f'<section class="commentThread comment-thread">{COMMENT}</section>',
])
@pytest.mark.parametrize("page", ["<body><article><h1>Head</h1><p>{0}</p></article>{1}</body>", "<body><article><h1>Head</h1><p>{0}</p>{1}</article></body>",
                                  "<body><main><h1>Head</h1><p>{0}</p>{1}</main></body>", "<body><div><h1>Head</h1><p>{0}</p></div>{1}</body>"])
def test_reader_comments_go_however_long(page, comments):
    assert m.main_text(page.format(LONG, comments)).split("\n") == ["Head", LONG.strip()]


@pytest.mark.parametrize("name", ["no-comments", "has-comments", "comments-open", "with-comments"])
def test_names_that_say_whether_there_are_comments(name):
    assert m.main_text(f'<body><div class="post {name}"><article><h1>Head</h1><p>{LONG}</p></article></div></body>').split("\n") == ["Head", LONG.strip()]


@pytest.mark.parametrize("name", ["ad-box", "adbox", "related-posts", "related_articles", "cookie-notice-wrapper", "newsletter-box", "social-links"])
def test_prose_in_furniture_goes(name):
    assert m.main_text(f'<body><article><h1>Head</h1><p>{LONG}</p><div class="{name}"><p>{LONG}</p></div></article></body>').split("\n") == ["Head", LONG.strip()]


def test_pages_of_one_paragraph():
    for furniture in ('<div class="share-buttons"><a>Tweet</a></div>', '<div class="side-effects-x"><a>Tweet</a></div>'):
        assert m.main_text(f"<body><p>{LONG}</p>{furniture}</body>") == LONG.strip()


def test_the_first_of_several_articles():
    second = f"<article><p>{LONG}</p><p>{LONG}</p></article>"
    assert m.main_text(f"<body><article><h1>Head</h1><p>{LONG}</p></article>{second}</body>").split("\n") == ["Head", LONG.strip()]
    assert m.main_text(f"<body><article><p>A teaser, short.</p></article>{second}</body>").split("\n") == [LONG.strip()] * 2


def test_an_article_named_for_comments_alone_on_its_page():
    assert m.main_text(f'<body><article class="comment"><h1>Head</h1><p>{LONG}</p></article></body>').split("\n") == ["Head", LONG.strip()]
