from pyspark.sql import functions as F

from cardprism.llm import html_extract, url_filter
from cardprism.llm.html_extract import extract
from cardprism.llm.queries import URL_RULES

PAGE = """<!DOCTYPE html><html><head><title>Menu title</title><style>p{x}</style><script>var t="</p><p>no</p>";</script></head>
<body class="with-sidebar"><header><h1>Site name</h1></header><nav><ul><li><a href="/">Home</a></li><li><a>More</a></li></ul></nav>
<div class="cookie-notice">We use cookies.</div><div class="ad">Buy this now, a very long advert text that goes on and on and on.</div>
<article><h1>A &amp; B</h1><p>First   para&shy;graph\nwith <b>bo</b>ld.<p>Short.</p><aside>Aside text</aside><form><label>Name</label></form>
<p>2 &lt; 3 &#233;&nbsp;!</p><div id="comments"><p>I hate this article, says a reader.</p></div></article>
<div class="sidebar">Side text</div><!-- hidden <p>text</p> --><footer>&copy; nobody</footer></body></html>"""


def test_article_without_its_surroundings():
    assert extract(PAGE) == "A & B First para\xadgraph with bold. Short. 2 < 3 é !"


def test_pages_without_article_marks():
    menu = '<div id="menu"><a href="a">One</a> <a href="b">Two</a></div>' + '<ul>' + '<li><a href="x">A link of some words</a></li>' * 5 + "</ul>"
    body = "".join(f"<p>{'Sentence of the text. ' * 8}{k}</p><p>Tiny {k}</p>" for k in range(3))
    got = extract(f"<body>{menu}<div>{body}</div><ul>{'<li><a>Other</a></li>' * 5}</ul><p>Imprint</p></body>")
    assert got.startswith("Sentence") and got.endswith("Tiny 2") and "Tiny 0" in got and "link" not in got


def test_broken_empty_and_plain_pages():
    assert extract(None) == extract("") == extract("<p></p>") == extract("<script>x") == ""
    assert extract("just text & more") == "just text & more"
    assert extract("<nav><ul><li>Menu<article><p>Kept though the menu is not closed") == "Kept though the menu is not closed"
    assert extract('<article><p class="a" title="x > y">In</p><p title="open>Next</p>').startswith("In")
    assert extract("<article><p>a</p><!-- never closed <p>b</p>") == "a"
    assert extract("<article><article class='comment'><p>no</p></article><p>yes</p></article>") == "yes"


def test_long_pages_are_whole():
    text = " ".join(f"word{i}" for i in range(200_000))
    assert extract(f"<article><p>{text}</p></article>") == text
    many = "".join(f"<p>para {i}</p>" for i in range(20_000))
    assert extract(f"<article>{many}</article>").count("para") == 20_000
    assert extract("<" * 50_000 + "a b") is not None


def test_extract_column(make):
    df = make([(1, PAGE, "t"), (1, PAGE, "t"), (2, None, "t"), (None, "", "t")], "page_id bigint, html string, text string")
    got = df.withColumn("main", html_extract.extract_main(F.col("html"))).collect()
    assert sorted(len(r.main) for r in got) == [0, 0, len(extract(PAGE)), len(extract(PAGE))]
    assert df.where("false").withColumn("main", html_extract.extract_main(F.col("html"))).count() == 0


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    head = rest
    for c in "/?#":
        head = head.split(c)[0]
    path = rest[len(head):].split("?")[0].split("#")[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in head)
    fits = [(len(h), len(p), v, h + p) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, "allow", None))
    return host, path, best[3], best[2]


URLS = [
    "http://a.example.org/es/1", "http://example.org/es", "https://EXAMPLE.org/en/17?q=1", "http://x.example.org/en/2#t", "http://notexample.org/es/",
    "http://org", "http://org/", "http://a.com/fr/1", "http://a.com/de/", "http://a.com/de", "http://com/de/x", "http://a.net/", "", None, "no scheme",
    "http://", "://h.org/x", "http://a.org?x=/es/", "http://user@a.org:80/x", "http://.org/x", "http://example.org./es/", "a://b://c.org/",
    "http://İ.ORG/x", "http://a.com/fr/../de/", "http://a..org//x",
]


def test_urls_against_brute_force(make):
    df = make([(i, u, "h") for i, u in enumerate(URLS * 2)], "page_id bigint, url string, host string")
    for r in url_filter.filter_urls(df, URL_RULES).collect():
        assert tuple(r.url_filter) == brute(r.url), r
    assert url_filter.filter_urls(df.where("false"), URL_RULES).count() == 0


def test_rule_precedence_and_bound(make):
    trie = url_filter.RuleTrie([("allow", "b.c", "/x"), ("block", "b.c", "/x"), ("allow", "c", "/x/very/long"), ("block", "c", "/"), ("allow", "b.c", "/x/y")])
    assert trie.judge("a.b.c", "/x") == ("block", "b.c/x")
    assert trie.judge("a.b.c", "/x/very/long/path") == ("block", "b.c/x")
    assert trie.judge("a.b.c", "/x/yes") == ("allow", "b.c/x/y")
    assert trie.judge("d.c", "/x/very/longer") == ("allow", "c/x/very/long")
    assert trie.judge("d", "/") is None
    df = make([(1, "http://a.b/")], "page_id bigint, url string")
    try:
        url_filter.filter_urls(df, URL_RULES, max_rules=2)
    except ValueError:
        return
    raise AssertionError("a longer rule list must be refused")
