"""URL rules whose decisions reach aliases: pages that redirects or canonical links declare to be the same.

DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowbench.llm.common import ascii_lower, written
from flowbench.llm.components import connected_components

MAX_RULES = 1000


@dataclass(frozen=True)
class UrlRule:
    """Fits a host and its subdomains where the path starts with ``path``."""

    host: str
    path: str
    allow: bool

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def address(url: Column) -> Column:
    """Host, path and query without scheme, default port, fragment and ``utm_`` parameters: what counts as one address.

    Null for a url without host.
    """
    host = F.regexp_replace(host_of(url), r":(80|443)$", "")
    query = F.regexp_replace(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), r"(^|&)utm_[^&]*", "")
    query = F.regexp_replace(query, r"^&+", "")
    path = F.when(path_of(url) == "", F.lit("/")).otherwise(path_of(url))
    return F.when(host != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def fitting_rule(host: Column, path: Column, rules: list[UrlRule]) -> Column:
    """Struct ``rule``, ``allow`` of the longest rule that fits (of equally long ones the first by text), else null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    found = F.lit(None).cast("struct<rule:string,allow:boolean>")
    for r in sorted(rules, key=lambda r: (len(r.text), [-ord(c) for c in r.text])):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.allow).alias("allow"))).otherwise(found)
    return found


def declared_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``source``, ``target``: urls that a page names as its canonical form or refreshes to, made absolute.

    Read from ``<link rel=canonical href>`` and ``<meta http-equiv=refresh content="..;url=..">`` outside comments.
    Null or empty pages have none.
    """
    html = F.coalesce(F.col(f"`{html_col}`"), F.lit(""))
    some = pages.select(F.col(f"`{url_col}`").alias("source"), html.alias("html")).where(F.col("html").rlike(r"(?i)canonical|http-equiv"))
    tags = F.regexp_extract_all(F.regexp_replace("html", r"(?s)<!--.*?-->", ""), F.lit(r"(?is)<(?:link|meta)\s[^>]*>"), 0)
    tag = F.col("tag")
    canonical = tag.rlike(r"(?is)^<link\s") & tag.rlike(r"(?is)\srel\s*=\s*[\"']?[^\"'>]*\bcanonical\b")
    refresh = tag.rlike(r"(?is)^<meta\s") & tag.rlike(r"(?is)\shttp-equiv\s*=\s*[\"']?\s*refresh\b")
    href = F.regexp_extract(tag, r"(?is)\shref\s*=\s*[\"']?\s*([^\"'\s>]+)", 1)
    to = F.regexp_extract(tag, r"(?is)\burl\s*=\s*[\"']?\s*([^\"'\s>]+)", 1)
    named = some.select("source", F.explode(tags).alias("tag")).select("source", F.when(canonical, href).when(refresh, to).alias("named"))
    scheme, host, path = F.regexp_extract("source", r"^([^:/?#]*)://", 1), host_of(F.col("source")), path_of(F.col("source"))
    target = (
        F.when(F.col("named").contains("://"), F.col("named"))
        .when(F.col("named").startswith("//"), F.concat(scheme, F.lit(":"), F.col("named")))
        .when(F.col("named").startswith("/"), F.concat(scheme, F.lit("://"), host, F.col("named")))
        .otherwise(F.concat(scheme, F.lit("://"), host, F.coalesce(F.regexp_extract(path, r"^(.*/)", 1), F.lit("/")), F.col("named")))
    )
    return named.where("named <> ''").select("source", target.alias("target")).where("source IS NOT NULL")


def judge(pages: DataFrame, rules: list[UrlRule], redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: ``id_col``, ``host``, ``path``, ``rule``, ``verdict`` (allow or block), ``decided_by`` (rule, alias or default).

    The longest fitting rule decides. A page without one is allowed if any alias has an allowing rule, else blocked if any has a
    blocking rule, else allowed. Aliases are urls of one address, and addresses joined over canonical links, refreshes and
    ``redirects`` (``source``, ``target``) in any number of steps, whether or not they are pages here. Null urls and urls without
    ``://`` have empty host and path and no alias. Repeated rows give a row each; other columns are not returned; an empty table gives none.
    """
    url = F.col(f"`{url_col}`")
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"), address(url).alias("node"))
    rows = rows.withColumn("own", fitting_rule(F.col("host"), F.col("path"), rules))
    links = declared_links(pages, url_col, html_col)
    if redirects is not None:
        links = links.union(redirects.select("source", "target"))
    links = written(links, "declared-links")  # pages are searched for links once
    edges = links.select(address(F.col("source")).alias("a"), address(F.col("target")).alias("b"))
    nodes = connected_components(edges, "a", "b")
    ends = links.select(F.explode(F.array("source", "target")).alias("url"))
    ends = ends.select(address(F.col("url")).alias("node"), fitting_rule(host_of(F.col("url")), path_of(F.col("url")), rules).alias("own"))
    # What rules say about each address, one row for it; then about each component.
    said = rows.select("node", "own").union(ends).where("own IS NOT NULL AND node IS NOT NULL")
    said = said.groupBy("node").agg(F.max("own.allow").alias("allow"))
    said = said.join(nodes, "node", "left").groupBy(F.coalesce("component", "node").alias("component")).agg(F.max("allow").alias("alias_allow"))
    placed = rows.join(nodes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    allow = F.coalesce("own.allow", "alias_allow", F.lit(True))
    return placed.join(said, "component", "left").select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.col("own.rule").alias("rule"),
        F.when(allow, "allow").otherwise("block").alias("verdict"),
        F.when(F.col("own").isNotNull(), "rule").when(F.col("alias_allow").isNotNull(), "alias").otherwise("default").alias("decided_by"),
    )
