import re
import time
from html import unescape

from tapeloom.llm import maintext, queries

SF = "/root/testdata/sf0.01"
P = "The cat sat on the mat and it was the best of all the cats that are in this house by the sea, as they say. " * 3


def template(html):
    """Brute force for the template of the test pages: all blocks of the article element."""
    inner = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    parts = re.split(r"<(?:/?p|/?h1)>", inner)
    parts = [" ".join(unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in parts]
    return "\n\n".join(x for x in parts if x)


def test_template_pages(spark):
    got = {r.page_id: r for r in queries.op8_main_text(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages)
    for r in pages:
        assert got[r.page_id].text == template(r.html) and got[r.page_id].n_chars == len(template(r.html)) and got[r.page_id].url == r.url


def test_boilerplate_goes_and_article_stays():
    body = (
        "<html><head><title>T</title><script>if (a < b) x = '<p>no</p>'</script><style>p>a{}</style></head><body class='page menu-open'>"
        "<header><h1>Site name</h1></header><div id='main-menu'><a href='/'>Home</a> <a href='/b'>B</a></div>"
        "<div class='cookie-notice'><p>" + P + "</p></div><div class=sidebar><p>" + P + "</p></div>"
        "<article><header><h1>Title &amp; more</h1></header><p>" + P + "<p>Short one.</p><p>caf&eacute;&nbsp; \n x&lt;y<br>z</p>"
        "<form><input name=q><p>Search the site</p></form><aside>Other <b>things</b></aside>"
        "<ul><li><a href='/1'>See also this story</a></li></ul><div class='comments'><p>" + P + "</p></div></article>"
        "<!-- <p>gone</p> --><footer>&copy; 2020 us</footer></body></html>"
    )
    want = ["Title & more", " ".join(P.split()), "Short one.", "café x<y z"]
    assert maintext.main_text(body).split("\n\n") == want


def test_pages_without_article():
    html = f"<body><div><a href=x>Home</a> | <a href=y>News</a></div><h2>Head</h2><div>{P}</div><div>Yes.</div><div>{P}</div><div><a href=z>One</a> <a href=w>Two</a></div><div>© us</div>"
    assert maintext.main_text(html).split("\n\n") == ["Head", " ".join(P.split()), "Yes.", " ".join(P.split())]


def test_edges(spark):
    for html in (None, "", "  \n", "<", "<p", "<!-- open", "<script>open", "</p></div>", "<a title='x>y", "<>&#0;&bogus;"):
        assert isinstance(maintext.main_text(html), str)
    assert maintext.main_text(None) == "" and maintext.main_text("<!-- open <p>x</p>") == ""
    long = "<article>" + "<p>" + "word " * 200000 + "</article>"
    assert len(maintext.main_text(long)) == 999999
    assert maintext.main_text("<p" * 100000) is not None
    df = spark.createDataFrame([(1, "u", None, "t"), (None, None, "<article><p>Hi</p></article>", "t"), (1, "u", None, "t")], "page_id long, url string, html string, text string")
    got = sorted((str(r.page_id), r.text, r.n_chars) for r in maintext.extract(df).collect())
    assert got == [("1", "", 0), ("1", "", 0), ("None", "Hi", 2)]
    assert maintext.extract(df.limit(0)).count() == 0


def test_marked_wrappers_keep_the_article():
    text = " ".join(P.split())
    for name in ("layout-with-sidebar", "no-sidebar", "ad-free", "has-menu", "sidebar"):
        assert maintext.main_text(f"<body><div class='{name}'><article><p>{P}</p></article></div><p>{P}</p></body>") == text
    assert maintext.main_text(f"<body><form action=x><article><p>{P}</p></article></form></body>") == text
    assert maintext.main_text(f"<body><form action=x><div>{P}</div></form></body>") == text
    assert maintext.main_text(f"<body><div hidden><article><p>{P}</p></article></div></body>") == ""


def test_self_closed_tags_and_linked_headings():
    text = " ".join(P.split())
    for tag in ("svg", "iframe"):
        assert maintext.main_text(f"<article><{tag} class='x' /><p>{P}</p></article>") == text
    assert maintext.main_text(f"<article><h1><a href=x>Title</a></h1><p>{P}</p></article>") == "Title\n\n" + text


def test_long_pages_take_linear_time():
    n = 100_000
    pages = [
        "<article><p>Some words.</p></article>" * n,
        "<div>" * n + "<p>one of the words</i></span></b>" * n,
        f"<div>{P}</div>" + "<p>Short one.</p><p>The short one is of the words that are not so short, as it has to be here.</p>" * (n // 2),
        "</div></section>" * n + f"<div>{P}</div>",
    ]
    for page in pages:
        start = time.process_time()
        maintext.main_text(page)
        assert time.process_time() - start < 10


def test_a_copyright_sign_inside_an_article_stays():
    short = "The © sign is named in this short paragraph of the article."
    text = " ".join(P.split())
    assert maintext.main_text(f"<article><p>{P}</p><p>{short}</p><p>{P}</p></article>") == f"{text}\n\n{short}\n\n{text}"
    assert maintext.main_text(f"<div>{P}</div><div>© 2020 by the owners of this page</div>") == text


def test_pages_by_the_block_rules_alone():
    """No article, no telling names: only lengths, links and stop words tell."""
    text = " ".join(P.split())
    links = "".join(f"<li><a href=/{k}>Topic number {k}</a></li>" for k in range(12))
    rows = "<tr><td class=c1><a href=/>Start</a></td><td class=c2><a href=/x>Contact us</a></td></tr>"
    pages = [
        f"<body><ul>{links}</ul><div class=x1><h1>Head line</h1><p>{P}</p><p>{P}</p></div><ul>{links}</ul></body>",
        f"<table>{rows}<tr><td>{P}</td></tr><tr><td>{P}</td></tr>{rows}</table>",
        f"<div><a href=/a>One</a> <a href=/b>Two</a></div><h2>Head line</h2><section>{P}</section><section>{P}</section><p>Price 12 EUR, size 40, item 7731</p><div><a href=/c>More</a></div>",
    ]
    for page, head in zip(pages, ("Head line\n\n", "", "Head line\n\n")):
        assert maintext.main_text(page).startswith(f"{head}{text}\n\n{text}") and "Topic" not in maintext.main_text(page) and "Contact" not in maintext.main_text(page)
        assert "Two" not in maintext.main_text(page) and "More" not in maintext.main_text(page)


def test_compound_names_of_comments_and_adverts_go():
    text = " ".join(P.split())
    for name in ("reader-comments", "user-comments", "post-comments", "comment_list", "related-posts", "ad-slot", "info-notice"):
        part = f"<section class='{name}'><p>{P}</p></section>"
        assert maintext.main_text(f"<article><p>{P}</p>{part}</article>") == text, name
        assert maintext.main_text(f"<body><div><p>{P}</p></div>{part}</body>") == text, name


def test_topics_of_an_article_stay():
    text = " ".join(P.split())
    for head in ("<h2 id='advertising'>Topic</h2>", "<h2 id=search>Topic</h2>", "<section id='promotion'><h3 class=menu>Topic</h3></section>"):
        assert maintext.main_text(f"<article><p>{P}</p>{head}<p>{P}</p></article>") == f"{text}\n\nTopic\n\n{text}", head
    assert maintext.main_text(f"<article><p>{P}</p><section id=comments><p>{P}</p></section></article>") == text


def test_paragraphs_with_long_links_stay_in_an_article():
    text = " ".join(P.split())
    link = "See <a href=x>the long report of the house by the sea and all its cats</a> for more."
    assert maintext.main_text(f"<article><p>{P}</p><p>{link}</p><p>{P}</p></article>") == f"{text}\n\nSee the long report of the house by the sea and all its cats for more.\n\n{text}"
    assert maintext.main_text(f"<article><p>{P}</p><p><a href=x>Read this next</a></p></article>") == text


def test_lone_short_pages_and_other_languages():
    assert maintext.main_text("<body><p>Hello there.</p></body>") == "Hello there."
    assert maintext.main_text("<body><a href=/>Home</a><p>Hello there.</p><p>© us</p></body>") == "Hello there."
    russian = "Вчера вечером жители небольшого города собрались на главной площади, чтобы обсудить строительство нового моста через реку. " * 3
    italian = "Ieri sera gli abitanti del piccolo borgo si sono riuniti nella piazza principale per discutere della costruzione di un nuovo ponte sul fiume. " * 3
    chinese = "昨天晚上,小镇的居民聚集在中心广场,讨论在河上修建新桥的计划。许多人表示支持,但也有人担心费用过高。" * 3
    for prose in (russian, italian, chinese):
        page = f"<body><ul><li><a href=/>Home</a></li><li><a href=/b>Blog</a></li></ul><h1>Title</h1><div>{prose}</div><div>{prose}</div><div><a href=/c>More</a></div></body>"
        text = " ".join(prose.split())
        assert maintext.main_text(page) == f"Title\n\n{text}\n\n{text}"
