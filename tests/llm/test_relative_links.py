import pytest

from kindred.llm import urlfilter as U
from kindred.llm.storage import Scratch

BASE = "http://A.net/b/c/d;p?q"
#: Most are the examples of RFC 3986, 5.4.
TARGETS = {
    "g": "http://a.net/b/c/g",
    "./g": "http://a.net/b/c/g",
    "g/": "http://a.net/b/c/g/",
    "/g": "http://a.net/g",
    "//g": "http://g",
    "?id=5": "http://a.net/b/c/d;p?id=5",
    "g?y#s": "http://a.net/b/c/g?y#s",
    "#s": "http://A.net/b/c/d;p?q#s",
    ".": "http://a.net/b/c/",
    "..": "http://a.net/b/",
    "../g": "http://a.net/b/g",
    "../../../g": "http://a.net/g",
    "/./g": "http://a.net/g",
    "g.": "http://a.net/b/c/g.",
    "..g": "http://a.net/b/c/..g",
    "./g/.": "http://a.net/b/c/g/",
    "g;x=1/../y": "http://a.net/b/c/y",
    "g?y/../x": "http://a.net/b/c/g?y/../x",
    "/go?u=http://h/x": "http://a.net/go?u=http://h/x",
    "go?u=http://h/x": "http://a.net/b/c/go?u=http://h/x",
    "HTTPS://X.net/a/../b?c": "HTTPS://X.net/b?c",
    "?a=1&amp;b=2": "http://a.net/b/c/d;p?a=1&b=2",
    "mailto:a@b": None,
    "javascript:go('http://x')": None,
}


@pytest.mark.parametrize("form", ['<link rel="canonical" href="{}">', '<meta http-equiv="refresh" content="0; url={}">'])
def test_every_form(spark, form):
    targets = {t: r for t, r in TARGETS.items() if "'" not in t}
    rows = [(f"{BASE}{n}", form.format(t)) for n, t in enumerate(targets)]
    got = {r.src_url: r.dst_url for r in U.html_links(spark.createDataFrame(rows, "url string, html string")).collect()}
    # the number of the row ends the base's query, which only a mere fragment keeps
    expected = {f"{BASE}{n}": r.replace("d;p?q#", f"d;p?q{n}#") for n, r in enumerate(targets.values()) if r}
    assert got == expected


def test_resolved(spark):
    rows = [(BASE, t) for t in TARGETS] + [("http://h.net", "x"), ("http://h.net?q", "../x")]
    df = spark.createDataFrame(rows, "base string, target string")
    got = {r.target: r.u for r in df.where("target not like '%&amp;%'").select("target", U.resolved(df.base, df.target).alias("u")).collect()}
    assert got == {t: r for t, r in TARGETS.items() if "&amp;" not in t} | {"x": "http://h.net/x", "../x": "http://h.net/x"}


def test_relative_aliases_are_blocked(spark):
    rules = (U.Rule("block", "m.net", "/bad/"),)
    rows = [
        (1, "http://m.net/bad/1", ""),
        (2, "http://m.net/new/2", '<link rel=canonical href="../bad/1">'),
        (3, "http://m.net/new/3", "<meta http-equiv=refresh content='0; url=2'>"),
        (4, "http://m.net/new/4", '<link rel="canonical" href="/go?u=http://m.net/bad/1">'),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = U.judge_urls(pages, U.html_links(pages), rules, Scratch(spark)).collect()
    assert {r.page_id: r.verdict for r in got} == {1: "block", 2: "block", 3: "block", 4: "allow"}
