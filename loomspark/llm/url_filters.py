"""Operator 2: URL filters whose block decisions reach every alias of a page.

Aliases are the connected components over redirect and canonical-link edges: ``<link rel=canonical>`` and
meta refresh targets of the pages, redirects that are given, and on demand the common spellings of one
address. Inside a component an explicit allow
rule on any member comes before an explicit block; without either, the default holds. DataFrame
functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.shared import connected_components, materialise

#: (host, path, verdict), by contract of the registered query.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = None
    for rule_host, rule_path, what in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        if rule is None:
            rule, verdict = F.when(fits, rule_host + rule_path), F.when(fits, what)
        else:
            rule, verdict = rule.when(fits, rule_host + rule_path), verdict.when(fits, what)
    if rule is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return rule, verdict


def query_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*(\?[^#]*)?", 1)


def address(url: Column) -> Column:
    """One spelling of what the url names: no scheme, no fragment. Null without a host."""
    host = host_of(url)
    return F.when(host != "", F.concat(host, path_of(url), query_of(url)))


def canonical(url: Column) -> Column:
    """The address that usually answers for this one: no www or m label, tracking parameter, index page,
    ``.html`` or final slash."""
    host = F.regexp_replace(host_of(url), r"^(www|m)\.(?=[^.]+\.)", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"/index\.html?$", "/"), r"(\.html?|/)$", "")
    query = F.regexp_replace(query_of(url), r"(?<=[?&])(utm_[a-z]+|ref|fbclid|gclid)=[^&]*(&|$)", "")
    return F.when(host != "", F.concat(host, path, F.regexp_replace(query, r"[?&]$", "")))


def _resolved(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments: a step up leaves the folder it is in, if there is one."""
    parts = F.split(path, "/")
    none = F.array().cast("array<string>")
    up = lambda s: F.when(F.size(s) > 1, F.slice(s, 1, F.size(s) - 1)).otherwise(s)
    kept = F.aggregate(parts, none, lambda s, x: F.when(x == ".", s).when(x == "..", up(s)).otherwise(F.array_append(s, x)))
    # a last segment of dots names a folder
    return F.concat(F.array_join(kept, "/"), F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise(""))


def _absolute(link: Column, base: Column) -> Column:
    """``link`` as a url: whole, or relative to the host, folder, path or address of ``base``; null if blank.

    Any number of steps up is followed; other schemes have no host.
    """
    link = F.replace(F.trim(link), F.lit("&amp;"), F.lit("&"))
    site = F.concat(F.lit("http://"), host_of(base))
    folder = F.regexp_replace(F.when(path_of(base) == "", "/").otherwise(path_of(base)), r"[^/]*$", "")
    bare = F.regexp_extract(link, r"(?s)^[^?#]*", 0)
    path = F.concat(_resolved(F.concat(folder, bare)), F.substr(link, F.length(bare) + 1))
    return (
        F.when(link == "", None)
        .when(link.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(F.lit("http:"), link))
        .when(link.startswith("/"), F.concat(site, link))
        .when(link.startswith("?"), F.concat(site, path_of(base), link))
        .when(link.startswith("#"), F.concat(site, path_of(base), query_of(base)))
        .otherwise(F.concat(site, path))
    )


def html_links(pages: DataFrame) -> DataFrame:
    """(src, dst) urls that the pages (url, html) name as canonical or as refresh target."""
    attribute = r"""(?is)\b%s\s*=\s*["']?\s*([^"'\s>]+)"""
    tags = F.regexp_extract_all("html", F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), 0)
    links = pages.filter(F.col("html").rlike(r"""(?i)rel\s*=\s*["']?canonical|http-equiv\s*=\s*["']?refresh""")).select(
        "url", F.explode(tags).alias("tag")
    )
    target = F.when(F.col("tag").rlike(r"""(?i)rel\s*=\s*["']?canonical"""), F.regexp_extract("tag", attribute % "href", 1)).when(
        F.col("tag").rlike(r"""(?i)http-equiv\s*=\s*["']?refresh"""), F.regexp_extract("tag", r"""(?is)\burl\s*=\s*["']?\s*([^"'\s>]+)""", 1)
    )
    return links.select(F.col("url").alias("src"), _absolute(target, F.col("url")).alias("dst")).filter("src IS NOT NULL AND dst IS NOT NULL")


def judge(
    pages: DataFrame, rules: tuple = RULES, default: str = "allow", redirects: DataFrame | None = None, spelling: bool = False
) -> DataFrame:
    """Add host, path, rule, verdict, alias_group and group_pages to ``pages`` (url, optionally html).

    ``redirects`` (src, dst urls) adds edges to those found in the pages; ``spelling`` adds those between an
    address and its :func:`canonical` spelling, which nobody has declared. Of rules that are equally long
    the first counts. A page that a rule fits has
    the rule's verdict. Any other page has allow if its group holds an explicitly allowed url, else
    block if it holds an explicitly blocked one, else ``default``. Urls that occur only as targets
    count in their group; group_pages counts the pages of a group, null where there is none. A url that is null or has no host belongs to no group and has the default.
    Urls and html of any length are read whole. Repeated rows keep their number, an empty table stays
    empty; columns of the names added are replaced; other columns stay.
    """
    made = ("host", "path", "rule", "verdict", "alias_group", "group_pages", "_address", "_ruled")
    pages = pages.drop(*made)
    # without spellings an address leads to itself: it is a member of its own group
    form = canonical if spelling else address
    edges = pages.select(address(F.col("url")).alias("src"), form(F.col("url")).alias("dst"))
    if "html" in pages.columns:
        named = html_links(pages)
        redirects = named if redirects is None else redirects.select("src", "dst").unionByName(named)
    if redirects is not None:
        src, dst = F.col("src"), F.col("dst")
        redirects = materialise(redirects)
        edges = edges.unionByName(redirects.select(address(src).alias("src"), address(dst).alias("dst")))
        edges = edges.unionByName(redirects.select(address(dst).alias("src"), form(dst).alias("dst")))
    edges = materialise(edges.filter("src IS NOT NULL AND dst IS NOT NULL").distinct())
    groups = materialise(connected_components(edges))

    members = edges.select("src").union(edges.select("dst")).distinct().withColumnRenamed("src", "node")
    whole = F.concat(F.lit("http://"), F.col("node"))
    _, explicit = matching_rule(host_of(whole), path_of(whole), rules)
    ruled = members.select("node", explicit.alias("said")).filter("said IS NOT NULL")
    ruled = ruled.join(groups, "node", "left").select(F.coalesce("component", "node").alias("alias_group"), "said")
    decided = ruled.groupBy("alias_group").agg(
        F.when(F.bool_or(F.col("said") == "allow"), "allow").otherwise("block").alias("_ruled")
    )
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    out = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url")), "_address": address(F.col("url"))})
    out = out.withColumns({"rule": rule, "verdict": verdict})
    # rows without an address have no group: they pass by the joins, where they would meet in one task
    nothing = F.lit(None).cast("string")
    bare = out.filter("_address IS NULL").withColumns({"alias_group": nothing, "group_pages": nothing.cast("long"), "_ruled": nothing})
    out = out.filter("_address IS NOT NULL").join(groups, F.col("_address") == F.col("node"), "left").drop("node")
    out = out.withColumn("alias_group", F.coalesce("component", "_address")).drop("component")
    counted = out.groupBy("alias_group").agg(F.count("*").alias("group_pages"))
    out = out.join(counted, "alias_group").join(decided, "alias_group", "left").unionByName(bare).drop("_address")
    return out.withColumn("verdict", F.coalesce("verdict", "_ruled", F.lit(default))).drop("_ruled")
