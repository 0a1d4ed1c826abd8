"""Operator 12: URL rules, with block decisions carried over to aliases. DataFrame functions only.

A rule is a host and the beginning of a path; it fits the host and its subdomains, and the longest fitting rule decides.
Where no rule fits, the address' class does. Classes are the connected components of the redirect and canonical links:
``<link rel="canonical">`` and ``<meta http-equiv="refresh">`` of the pages, and further redirects from a crawler's log.
Only addresses with a link take part, so the components grow with the links and not with the pages. Every address of a
class is held against the rules, pages or not: a page that redirects to a blocked address is blocked as well. An
explicit allow has precedence: for its own address over every block that reaches it, and for its class over the blocks
in it, so that what is equivalent to an allowed address is allowed.

Addresses are one node when host, path and query are equal (scheme and fragment do not lead elsewhere; A-Z of the host in
lower case). A link's target may be absolute, begin with ``//`` or ``/``, or be relative; ``.`` and ``..`` are resolved.

Defined results: null urls and urls without ``://`` have an empty host and path, fit no rule, have no links and are
allowed; an empty host has no aliases; equal rows are judged alike; links in comments and scripts do not count; tags
end at the first ``>``; null html has no links; an empty table gives no rows; further columns are left alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekpanel.llm.components import components
from weekpanel.llm.shared import Staging, lower_ascii

ALLOW, BLOCK = "allow", "block"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """What follows the first ``://``, up to ``/``, ``?``, ``#`` or the end."""
    return lower_ascii(_part(url, r"([^/?#]*)"))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return _part(url, r"[^/?#]*([^?#]*)")


def _query_of(url: Column) -> Column:
    return _part(url, r"[^?#]*(\?[^#]*)")


def _part(url: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_extract(url, f"(?s)^.*?://{pattern}", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """The address as a node of the links; null without a host. An empty path is the root's."""
    host, path = host_of(url), path_of(url)
    return F.when(host != "", F.concat(host, F.when(path == "", F.lit("/")).otherwise(path), _query_of(url)))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest fitting rule as (rule, verdict), null where none fits; of equally long ones the longer host, then allow."""
    ordered = sorted(set(rules), key=lambda r: (-len(r.name), -len(r.host), r.verdict != ALLOW, r.name))
    found: Column = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in reversed(ordered):
        named = F.lit(rule.host.lower())
        fits = ((host == named) | F.endswith(host, F.concat(F.lit("."), named))) & F.startswith(path, F.lit(rule.path))
        found = F.when(fits, F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def _attribute(tag: Column, name: str) -> Column:
    """An attribute's value, quoted or not, with ``&amp;`` decoded and trimmed; null where the tag has none."""
    pattern = rf"""(?is)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
    value = F.btrim(F.regexp_extract(tag, pattern, 1), F.lit("\"' \t\r\n"))
    return F.when(tag.rlike(pattern), F.regexp_replace(value, "&(?:amp|#38|#[xX]26);", "&"))


def _without_dots(df: DataFrame, column: str) -> DataFrame:
    """``.`` and ``..`` resolved, as a browser does."""
    kept = F.aggregate(
        F.split(column, "/"),
        F.array().cast("array<string>"),
        lambda done, part: F.when(part == ".", done)
        .when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1))))
        .otherwise(F.concat(done, F.array(part))),
    )
    tail = F.when(F.col(column).rlike(r"(?:^|/)\.\.?$"), F.lit("/")).otherwise(F.lit(""))
    tidy = F.concat(F.array_join(kept, "/"), tail)
    return df.withColumn(column, F.when(F.contains(column, F.lit("/.")), tidy).otherwise(F.col(column)))


def resolved(links: DataFrame) -> DataFrame:
    """(from_url, to_url) of (from_url, link): the links as absolute addresses; those to no web address drop out.

    In steps, each a projection of its own: one expression would repeat its inputs over and over.
    """
    base, link = F.col("from_url"), F.col("link")
    steps = links.select(base, F.substring_index("link", "#", 1).alias("link"))
    absolute = F.concat(F.substring_index("link", "://", 1), F.lit("://"), host_of(link))
    steps = steps.withColumns(
        {
            "scheme": F.substring_index("from_url", "://", 1),
            "host": host_of(base),
            "place": F.when(path_of(base) == "", F.lit("/")).otherwise(path_of(base)),
            "kind": F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), F.lit("absolute"))
            .when(F.startswith("link", F.lit("//")), F.lit("host"))
            .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit("other"))
            .when(F.startswith("link", F.lit("/")), F.lit("path"))
            .when(F.substring_index("link", "?", 1) == "", F.lit("query"))
            .otherwise(F.lit("relative")),
        }
    ).filter("kind <> 'other'")
    kind, root = F.col("kind"), F.concat(F.col("scheme"), F.lit("://"), F.col("host"))
    steps = steps.select(
        base,
        F.when(kind == "absolute", absolute).when(kind == "host", F.concat("scheme", F.lit(":"), "link")).otherwise(root).alias("start"),
        F.when(kind == "absolute", path_of(link))
        .when(kind == "host", F.lit(""))
        .when(kind == "query", F.col("place"))
        .when(kind == "path", F.substring_index("link", "?", 1))
        .otherwise(F.concat(F.regexp_replace("place", "[^/]*$", ""), F.substring_index("link", "?", 1)))
        .alias("path"),
        F.when(kind != "host", F.regexp_extract("link", r"(?s)\?.*$", 0)).otherwise(F.lit("")).alias("query"),
    )
    return _without_dots(steps, "path").select(base, F.concat("start", "path", "query").alias("to_url"))


def page_links(pages: DataFrame) -> DataFrame:
    """(from_url, to_url) of the canonical links and refreshing redirects in the pages' html.

    A cheap test for the words that such tags hold goes first, so that most pages are not searched for tags.
    """
    shown = F.regexp_replace("html", r"(?is)<!--.*?-->|<script\b.*?</script\s*>", "")
    candidates = pages.filter(F.col("html").rlike(r"(?i)\bcanonical\b|\bhttp-equiv\b")).select("url", shown.alias("shown"))
    found = F.regexp_extract_all("shown", F.lit(r"(?is)<(?:link|meta)\s[^>]*>"), F.lit(0))
    tags = candidates.filter(host_of(F.col("url")) != "").select(F.col("url").alias("from_url"), F.explode(found).alias("tag"))
    tag = F.col("tag")
    read = tags.select(
        "from_url",
        F.when(tag.rlike("(?i)^<link"), _attribute(tag, "rel")).alias("rel"),
        F.when(tag.rlike("(?i)^<meta"), _attribute(tag, "http-equiv")).alias("equiv"),
        _attribute(tag, "href").alias("href"),
        _attribute(tag, "content").alias("content"),
    )
    to = F.regexp_extract("content", r"""(?is)^[\s\d.]*[;,]\s*url\s*=\s*["']?([^"']*)""", 1)
    canonical = F.col("rel").rlike(r"(?i)(?:^|\s)canonical(?:\s|$)")
    link = F.when(canonical, F.col("href")).when(F.lower("equiv") == "refresh", F.btrim(to))
    return resolved(read.select("from_url", link.alias("link")).filter("link IS NOT NULL"))


def alias_classes(links: DataFrame, staging: Staging) -> DataFrame:
    """(node, root) of every address with a link to another one."""
    edges = links.select(node_of(F.col("from_url")).alias("a"), node_of(F.col("to_url")).alias("b"))
    return components(staging.write(edges, "links").filter("a <> b"), staging, "aliases")


def judged_pages(pages: DataFrame, rules: Sequence[Rule], redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, and alias_of (the smallest address of the class) of every page.

    ``redirects`` has (from_url, to_url), for instance of a crawler's log. Pages without links are judged where they are
    read. The verdicts of classes are aggregated on the map side and staged, so that a hot class or address is split in
    the join.
    """
    for rule in rules:
        if rule.verdict not in (ALLOW, BLOCK):
            raise ValueError(f"a rule allows or blocks: {rule}")
    staging = Staging(pages.sparkSession, "url-filter")
    links = page_links(pages)
    if redirects is not None:
        links = links.unionByName(redirects.select("from_url", "to_url"))
    classes = staging.write(alias_classes(links, staging), "classes")
    address = F.concat(F.lit("://"), F.col("node"))
    parsed = classes.select("node", "root", host_of(address).alias("host"), path_of(address).alias("path"))
    told = parsed.withColumn("verdict", rule_of(F.col("host"), F.col("path"), rules)["verdict"])
    # min: "allow" comes before "block".
    of_class = staging.write(told.groupBy("root").agg(F.min("verdict").alias("class_verdict")), "class-verdicts")
    aliases = staging.write(classes.join(of_class, "root").withColumnRenamed("root", "alias_of"), "verdicts")
    url = F.col("url")
    slim = pages.select(
        F.col("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node")
    ).withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("found.verdict"), F.col("class_verdict"), F.lit(ALLOW))
    return slim.join(aliases, "node", "left").select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), "alias_of"
    )
