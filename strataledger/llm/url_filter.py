"""URL filters: block and allow rules, carried to aliases over redirect and canonical-link edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataledger.llm.common import ascii_lower, cut, looked_up
from strataledger.llm.components import connected_components

#: (verdict, host, path)
Rule = tuple[str, str, str]

_CANONICAL = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
_REFRESH = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
_HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
_TARGET = r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """What two spellings of one address share: host, path and query, without scheme and fragment; null without ``://``."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)
    return F.when(F.contains(url, F.lit("://")), F.concat(host_of(url), path_of(url), query))


def resolved(link: Column, base: Column) -> Column:
    """An absolute URL for a link found in the page at base; ``&amp;`` is read as ``&``."""
    link = F.replace(F.trim(link), F.lit("&amp;"), F.lit("&"))
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    root = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*(?:/(?:[^?#/]*/)*)?)", 1)
    folder = F.when(F.endswith(folder, F.lit("/")), folder).otherwise(F.concat(folder, F.lit("/")))
    return (
        F.when(link.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), link)
        .when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(root, link))
        .when(F.length(link) > 0, F.concat(folder, link))
    )


def rule_table(spark: SparkSession, rules: DataFrame | Sequence[Rule]) -> DataFrame:
    """(rule_host, rule_path, verdict), a row a rule, of a table (verdict, host, path) or of a list of triples.

    Of rules that agree in host and path allow wins. Rules with a null part count for nothing.
    """
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame([tuple(r) for r in rules], "verdict string, host string, path string")
    kept = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict").where("rule_host IS NOT NULL AND rule_path IS NOT NULL AND verdict IN ('allow', 'block')")
    return kept.groupBy("rule_host", "rule_path").agg(F.min("verdict").alias("verdict"))


def matched_rules(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """addresses (distinct host, path) that a rule fits, with own struct(rule, verdict): the longest rule.

    A rule fits its host and all subdomains where the path starts with the rule's. Of equally long rules (host and
    path together) allow wins, then the later by code point. Each address is posted under its host's suffixes and, for
    each, under those starts of its path whose lengths some rule of that host has; both are looked up by equality, so
    neither the number of rules nor a host with very many of them is gone through by an address.
    """
    of_host = looked_up(rules.groupBy("rule_host").agg(F.collect_set(F.length("rule_path")).alias("lengths")))
    by_path = looked_up(rules.select(F.col("rule_host").alias("own_host"), F.col("rule_path").alias("own_path"), "verdict"))
    parts = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    posted = addresses.select("host", "path", F.explode(suffixes).alias("suffix")).join(of_host, F.col("suffix") == F.col("rule_host"))
    starts = posted.select("host", "path", "suffix", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n")).select("host", "path", "suffix", F.substring("path", F.lit(1), F.col("n")).alias("start"))
    fits = starts.join(by_path, (F.col("suffix") == F.col("own_host")) & (F.col("start") == F.col("own_path")))
    rule = F.concat("own_host", "own_path")
    best = F.max(F.struct(F.length(rule).alias("n"), (F.col("verdict") == "allow").alias("a"), rule.alias("rule"), "verdict"))
    return fits.groupBy("host", "path").agg(best.alias("best")).select("host", "path", F.struct(F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict")).alias("own"))


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src_url, dst_url): from each page to its canonical links and to the targets of its refresh redirects."""
    page, base = F.coalesce(F.col(html), F.lit("")), F.col(url)

    def targets(tag: str, attribute: str) -> Column:
        return F.transform(F.regexp_extract_all(page, F.lit(tag), F.lit(0)), lambda t: F.regexp_extract(t, attribute, 1))

    links = F.concat(targets(_CANONICAL, _HREF), targets(_REFRESH, _TARGET))
    return (
        pages.where(base.isNotNull())
        .select(base.alias("src_url"), F.explode(F.array_distinct(links)).alias("link"))
        .select("src_url", resolved(F.col("link"), F.col("src_url")).alias("dst_url"))
        .where("dst_url IS NOT NULL")
    )


def judge_urls(pages: DataFrame, rules: DataFrame | Sequence[Rule], edges: DataFrame | None = None, url: str = "url", html: str = "html") -> DataFrame:
    """All of pages with host, path, rule and verdict, packed as (page, host, path, rule, verdict).

    rules is a table (verdict, host, path) of any size or a list of such triples. A page that a rule fits gets the
    longest rule's verdict. Every other page takes over the decision of its aliases,
    which are all addresses joined to its own by redirects and canonical links in either direction, whether they are
    pages here or not: allow if a rule allows one of them, else block if a rule blocks one, else allow.
    edges (src_url, dst_url) adds redirects seen elsewhere, such as a crawler's log.
    Addresses that differ in scheme or fragment only are one. Null and unparsable URLs have an empty host and path,
    no alias and, without a rule, the verdict allow. Repeated pages stay. Empty tables give no rows; pages' own
    columns stay inside ``page`` and cannot clash.
    """
    links = link_edges(pages, url, html)
    if edges is not None:
        links = links.unionByName(edges.select("src_url", "dst_url"))
    linked = cut(
        links.select(node_of(F.col("src_url")).alias("src"), node_of(F.col("dst_url")).alias("dst"))
        .where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
        .distinct()
    )
    component = connected_components(linked)
    # a node starts with its host, so it is judged like the URL it was made of
    as_url = F.concat(F.lit("x://"), F.col("node"))
    nodes = component.select("component", "node", host_of(as_url).alias("node_host"), path_of(as_url).alias("node_path"))
    addresses = pages.select(host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    table = cut(rule_table(pages.sparkSession, rules))
    own = looked_up(matched_rules(addresses.unionAll(nodes.select("node_host", "node_path")).distinct(), table).toDF("own_host", "own_path", "own"))
    decided = (
        nodes.join(own, (F.col("node_host") == F.col("own_host")) & (F.col("node_path") == F.col("own_path")), "left")
        .groupBy("component")
        .agg(F.max(F.col("own.verdict") == "allow").alias("allowed"), F.max(F.col("own.verdict") == "block").alias("blocked"))
    )
    verdicts = decided.select(F.col("component").alias("of"), F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").alias("alias_verdict")).where("alias_verdict IS NOT NULL")
    aliases = looked_up(component.join(looked_up(verdicts), F.col("component") == F.col("of")).select(F.col("node").alias("alias"), "alias_verdict"))
    judged = pages.select(F.struct("*").alias("page")).select(
        "page", host_of(F.col(f"page.`{url}`")).alias("host"), path_of(F.col(f"page.`{url}`")).alias("path"), node_of(F.col(f"page.`{url}`")).alias("node")
    )
    judged = judged.join(own, (F.col("host") == F.col("own_host")) & (F.col("path") == F.col("own_path")), "left")
    return judged.join(aliases, F.col("node") == F.col("alias"), "left").select(
        "page", "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", "alias_verdict", F.lit("allow")).alias("verdict")
    )
