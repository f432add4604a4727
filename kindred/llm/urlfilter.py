"""URL filters: longest host/path rule, and block decisions carried over redirects.

DataFrame functions only. Rules are a short list in the plan (one CASE per rule); links
between URLs come from a canonical-link element, a refresh element, or any table of
(src_url, dst_url).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .storage import Scratch


@dataclass(frozen=True)
class Rule:
    action: str  # allow or block
    host: str  # this host and its subdomains
    path: str = "/"  # prefix of the path

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return ascii_lower(F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"(?s)\A[^/?#]*", 0))


def path_of(url: Column) -> Column:
    """From the first / after the host up to ? or #; empty if the host ends otherwise."""
    return F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"(?s)\A[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct (rule, action) of the longest fitting rule, null without one."""
    out = F.lit(None).cast("struct<rule:string,action:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text, r.action != "block")):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.action).alias("action"))).otherwise(out)
    return out


def node_of(url: Column) -> Column:
    """URL without its fragment and with a lower-case host: what a server can tell apart."""
    scheme = ascii_lower(F.substring_index(url, "://", 1))
    tail = F.regexp_extract(_rest(url), r"(?s)\A[^/?#]*([^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(scheme, F.lit("://"), host_of(url), F.when(tail == "", "/").otherwise(tail)))


def _attribute(tag: Column, name: str) -> Column:
    found = F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*(\"([^\"]*)\"|'([^']*)'|[^\s>\"']+)", 1)
    return F.regexp_replace(found, r"\A[\"']|[\"']\z", "")


def _without_dots(path: Column) -> Column:
    """Path, empty or from a slash on, with its . and .. segments resolved."""
    parts = F.split(F.substring(path, 2, F.length(path)), "/")
    step = lambda done, s: F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(s == ".", done).otherwise(F.concat(done, F.array(s)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    whole = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(path.contains("/."), F.concat(F.lit("/"), F.array_join(whole, "/"))).otherwise(path)


def resolved(base: Column, target: Column) -> Column:
    """Target of a link on the page base, by RFC 3986, 5.2; null if it has a scheme but no host.

    base must hold ://.
    """
    scheme, path = F.substring_index(base, "://", 1), path_of(base)
    site = F.concat(scheme, F.lit("://"), host_of(base))
    folder = F.regexp_extract(path, r"(?s)\A.*/", 0)
    full = (
        F.when(target.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*:"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(site, target))
        .otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), target))
    )
    part = lambda i: F.regexp_extract(full, r"(?s)\A([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)([^?#]*)(.*)", i)
    return (
        F.when(target.startswith("?"), F.concat(site, path, target))
        .when((target == "") | target.startswith("#"), F.concat(F.substring_index(base, "#", 1), target))
        .when(part(1) != "", F.concat(part(1), _without_dots(part(2)), part(3)))
    )


def html_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src_url, dst_url) of canonical-link and refresh elements in raw HTML.

    Targets are resolved against the page's URL; a base element is not read. Of character
    references only &amp; is decoded.
    """
    u, h = F.col(url), F.col(html)
    link = F.regexp_extract(h, r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>", 0)
    meta = F.regexp_extract(h, r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>", 0)
    lower = F.lower(h)
    canonical = F.when(lower.contains("canonical"), _attribute(link, "href"))
    refresh = F.when(lower.contains("refresh"), F.regexp_extract(_attribute(meta, "content"), r"(?is)url\s*=\s*[\"']?([^\"']*)", 1))
    target = F.replace(F.regexp_replace("dst", r"(?s)\A[ \t\n\f\r]+|[ \t\n\f\r]+\z", ""), F.lit("&amp;"), F.lit("&"))
    return (
        pages.where(F.instr(u, "://") > 0)
        .select(u.alias(url), F.explode(F.array(canonical, refresh)).alias("dst"))
        .select(F.col(url).alias("src_url"), target.alias("dst"))
        .where("dst <> ''")
        .select("src_url", resolved(F.col("src_url"), F.col("dst")).alias("dst_url"))
        .where("dst_url is not null")
    )


def judge_urls(pages: DataFrame, links: DataFrame, rules: Sequence[Rule], scratch: Scratch, *, key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict, alias_of) for every row of pages.

    A URL that a rule fits gets the rule's verdict, so an explicit allow is never undone
    by an alias. Any other URL is blocked if its class of aliases (connected by links)
    holds a blocked URL and no explicitly allowed one, else allowed. alias_of is the least
    URL of that class, null without links.

    Null URLs and those without :// have empty host and path, no rule, and are allowed.
    Repeated rows are judged alike; an empty table gives an empty result. Links may name
    URLs that are not in pages; rules speak for those too.
    """
    host, path = host_of(F.col(url)), path_of(F.col(url))
    judged = pages.select(F.col(key).alias("page_id"), node_of(F.col(url)).alias("node"), host.alias("host"), path.alias("path")).withColumn("m", matched_rule(F.col("host"), F.col("path"), rules))
    edges = links.select(node_of(F.col("src_url")).alias("src"), node_of(F.col("dst_url")).alias("dst"))
    classes, _ = scratch.put(connected_components(edges, scratch), "aliases")
    ruled = classes.withColumn("m", matched_rule(host_of(F.col("node")), path_of(F.col("node")), rules))
    verdicts = ruled.groupBy("component").agg(
        F.coalesce(F.bool_or(F.col("m.action") == "block"), F.lit(False)).alias("blocked"),
        F.coalesce(F.bool_or(F.col("m.action") == "allow"), F.lit(False)).alias("allowed"),
    )
    spread = classes.join(verdicts, "component").select("node", "component", (F.col("blocked") & ~F.col("allowed")).alias("bad"))
    return judged.join(spread, "node", "left").select(
        "page_id",
        "host",
        "path",
        F.col("m.rule").alias("rule"),
        F.coalesce(F.col("m.action"), F.when(F.coalesce("bad", F.lit(False)), "block").otherwise("allow")).alias("verdict"),
        F.col("component").alias("alias_of"),
    )
