from kindred.llm import urlfilter as U
from kindred.llm.storage import Scratch

URLS = [
    (1, "http://a.ORG/x", "a.org", "/x", "org/", "allow"),
    (2, "https://www.example.org/es/1?q#f", "www.example.org", "/es/1", "example.org/es/", "block"),
    (3, "http://example.org/en/17", "example.org", "/en/17", "example.org/en/1", "block"),
    (4, "http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
    (5, "http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
    (6, "http://x.com/de/", "x.com", "/de/", "com/de/", "block"),
    (7, "http://x.com/De/", "x.com", "/De/", None, "allow"),
    (8, "http://a.org", "a.org", "", None, "allow"),
    (9, None, "", "", None, "allow"),
    (10, "no scheme/com/de/", "", "", None, "allow"),
    (11, "http://x.net?u=http://y.com/de/", "x.net", "", None, "allow"),
    (12, "", "", "", None, "allow"),
    (13, "http://m.net/a", "m.net", "/a", None, "block"),  # canonical link to a blocked URL
    (14, "http://n.net/b#top", "n.net", "/b", None, "block"),  # redirects to 13
    (15, "http://k.org/c", "k.org", "/c", "org/", "allow"),  # explicit allow, linked to a blocked URL
    (16, "http://l.net/d", "l.net", "/d", None, "allow"),  # a class with an explicit allow and a block
    (16, "http://l.net/d", "l.net", "/d", None, "allow"),
]
HTML = {
    13: '<link rel="canonical" href="http://x.com/de/1">',
    14: "<meta http-equiv=refresh content='0; url=http://m.net/a'>",
    15: '<LINK data-x=1 href="//y.com/de/" REL=canonical>',
    16: '<link rel="canonical" href="http://k.org/c#x">',
    4: '<link rel="stylesheet" href="http://x.com/de/">',
    7: None,
}


def test_rules_and_aliases(spark):
    rows = [(i, u, HTML.get(i, "<p>"), "clash") for i, u, *_ in URLS]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, verdict string")
    got = U.judge_urls(pages, U.html_links(pages), U.RULES, Scratch(spark)).collect()
    assert sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in got) == sorted((i, h, p, r or "", v) for i, _, h, p, r, v in URLS)


def test_relative_links_and_no_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x", '<link rel=canonical href="/y">')], "page_id long, url string, html string")
    assert U.html_links(pages).collect()[0].dst_url == "http://a.net/y"
    empty = pages.limit(0)
    assert U.judge_urls(empty, U.html_links(empty), U.RULES, Scratch(spark)).count() == 0


def test_main_path_is_native(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x", "")], "page_id long, url string, html string")
    plan = U.judge_urls(pages, U.html_links(pages), U.RULES, Scratch(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
