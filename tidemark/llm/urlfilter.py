"""URL filters: rules by host and path, block decisions carried to aliases through redirect equivalence.  Native.

A rule ``host/path`` fits its host and all subdomains if the url's path starts
with the rule's; the longest rule wins.  Urls that a redirect (a refresh with
a url) or a canonical link joins are one resource: connected components over
those edges are found by distributed star rounds.  A url without a rule of
its own takes the decision of its component: allow if any member is
explicitly allowed, else block if any is blocked, else allow.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.frames import cut

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
# what a browser does not read as tags: comments (to the end of the page if not closed), scripts, styles, text fields
_UNREAD = r"(?is)<!--.*?(?:-->|\z)|<(script|style|textarea|title)\b.*?</\1\s*+>"
_TAG = r"""(?is)<(?:link|meta)\b((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
_ATTRIBUTE = r"""[^\s"'>/=]++\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>]++)"""
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _part(url: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_extract(url, pattern, 1), F.lit(""))


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or end, A-Z lower-cased; "" without ``://``."""
    return F.translate(_part(url, r"^(?s:.*?)://([^/?#]*)"), _UPPER, _UPPER.lower())


def url_path(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or end; "" without ``://``."""
    return _part(url, r"^(?s:.*?)://[^/?#]*([^?#]*)")


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits; null if none does.  Equal length: the later rule."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def url_key(url: Column) -> Column:
    """The resource that a url names: without fragment, host lower-cased; null without ``://``."""
    rest = F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^#]*)", 1)
    return F.when(F.contains(url, F.lit("://")), F.concat(url_host(url), F.when(rest == "", F.lit("/")).otherwise(rest)))


def _attribute(attributes: Column, name: str) -> Column:
    """The value of the first attribute of that name, "" if there is none."""
    named = F.filter(attributes, lambda a: a.rlike(rf"(?i)^{name}\s*="))
    value = F.coalesce(F.regexp_extract(F.get(named, 0), r"(?s)=\s*(.*)", 1), F.lit(""))
    return F.trim(F.replace(F.btrim(value, F.lit("\"'")), F.lit("&amp;"), F.lit("&")))


def _absolute(links: DataFrame) -> DataFrame:
    """(url, link) to (url, target): links as absolute urls, seen from the page's own url; no target for mailto: and such."""
    link = F.col("link")
    parts = links.withColumns({"scheme": F.regexp_extract("url", r"^((?s:.*?))://", 1), "host": url_host(F.col("url")),
                               "path": url_path(F.col("url"))})
    parts = parts.withColumn("root", F.concat("scheme", F.lit("://"), "host"))
    folder = F.regexp_extract("path", r"^((?s:.*/)?)", 1)
    target = (F.when(F.contains(link, F.lit("://")), link)
              .when(F.startswith(link, F.lit("//")), F.concat("scheme", F.lit(":"), link))
              .when(F.startswith(link, F.lit("/")), F.concat("root", link))
              .when(link.rlike(r"^[#?]"), F.concat("root", "path", link))
              .when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.lit(None))
              .otherwise(F.concat("root", F.when(folder == "", "/").otherwise(folder), link)))
    return parts.select("url", target.alias("target")).where("target is not null")


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(url, target): canonical links and refresh redirects found in the pages' html, as absolute urls.

    Null html has none, nor have comments, scripts, styles, titles and text fields; a quoted ``>`` does not end a tag.
    Very long pages are read whole.
    """
    read = F.regexp_replace(F.col(html_col), _UNREAD, " ")
    tags = F.transform(F.regexp_extract_all(read, F.lit(_TAG), F.lit(1)),
                       lambda t: F.regexp_extract_all(t, F.lit(_ATTRIBUTE), F.lit(0)))
    tag = F.col("tag")
    marked = pages.where(F.col(html_col).rlike(r"(?i)\bcanonical\b|http-equiv")).select(
        F.col(url_col).alias("url"), F.explode(tags).alias("tag"))
    named = marked.select("url", *[_attribute(tag, a).alias(a.replace("-", "_")) for a in ("rel", "href", "http-equiv", "content")])
    canonical = F.when(F.col("rel").rlike(r"(?i)(^|\s)canonical(\s|$)"), F.col("href"))
    refresh = F.when(F.lower("http_equiv") == "refresh", F.trim(F.regexp_extract(
        "content", r"(?is)^[^;,]*[;,]\s*(?:url\s*=)?\s*['\"]?([^'\"]*)", 1)))
    # cut: the filters below would repeat these expressions if they were pushed through them
    links = cut(named.select("url", F.coalesce(canonical, refresh).alias("link")))
    return _absolute(links.where("link <> ''"))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url_col: str = "url",
                html_col: str | None = "html", edges: DataFrame | None = None, keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """``keep`` columns with host, path, rule and verdict of every row.

    ``edges``: more equivalent urls as (url, target), e.g. from a redirect log.  Null urls and urls without ``://``
    have an empty host and path, fit no rule, join nothing and are allowed.  Repeated rows stay.  Very long urls and
    pages are read whole.  Other columns of ``pages`` may have any names.  Empty table: no rows.
    """
    u, v = F.col(url_col), ("_host", "_path", "_match")
    judged = pages.select(*keep, u.alias("_url"), url_host(u).alias(v[0]), url_path(u).alias(v[1]))
    judged = judged.withColumn(v[2], matched_rule(F.col(v[0]), F.col(v[1]), rules))
    found = [page_links(pages, url_col, html_col)] if html_col else []
    found += [edges.select(F.col(edges.columns[0]).alias("url"), F.col(edges.columns[1]).alias("target"))] if edges is not None else []
    own = F.col("_match.verdict")
    out = [*keep, F.col(v[0]).alias("host"), F.col(v[1]).alias("path"), F.col("_match.rule").alias("rule")]
    if not found:
        return judged.select(*out, F.coalesce(own, F.lit("allow")).alias("verdict"))
    links = found[0]
    for f in found[1:]:
        links = links.unionByName(f)
    # urls that links name; a url and the url without its fragment are one node
    ends = cut(links.select(url_key(F.col("url")).alias("a"), url_key(F.col("target")).alias("b")))
    group = components(ends)
    names = group.withColumn("m", matched_rule(F.regexp_extract("node", r"^([^/?#]*)", 1),
                                               F.regexp_extract("node", r"^[^/?#]*([^?#]*)", 1), rules))
    decided = names.groupBy("root").agg(F.max(F.when(F.col("m.verdict") == "allow", 2).when(
        F.col("m.verdict") == "block", 1).otherwise(0)).alias("d"))
    carried = cut(group.join(decided, "root").where("d > 0").select(
        F.col("node").alias("_node"), F.when(F.col("d") == 2, "allow").otherwise("block").alias("_carried")))
    # only urls without a rule look their component up, by a 64-bit key and the url itself
    free = judged.where("_match is null").withColumn("_node", url_key(F.col("_url")))
    looked = free.join(carried, "_node", "left").select(*out, F.coalesce("_carried", F.lit("allow")).alias("verdict"))
    return judged.where("_match is not null").select(*out, own.alias("verdict")).unionByName(looked)
