"""Operator 7, URL filters with redirect equivalence.

Rules judge addresses; connected components over redirect and canonical-link edges carry the decision to aliases. In a
component an explicit allow wins over any block; a page's own rule always wins over its component.
"""

from __future__ import annotations

import re
from html import unescape
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import components

ALLOW, BLOCK = "allow", "block"
TAG = re.compile(r"(?is)<(?:link|meta)\b[^>]*>")
ATTRIBUTE = re.compile(r"(?s)([\w-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
TARGET = re.compile(r"(?is)\burl\s*=\s*['\"]?([^'\">]+)")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def _path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _node(url: Column) -> Column:
    """An address as a node: lower-cased host, path, query; scheme and fragment make no difference. NULL without host."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(_host(url) != "", F.concat(_host(url), F.when(rest == "", F.lit("/")).otherwise(rest)))


def _links(html: str, base: str) -> list[str]:
    """Targets of a page's canonical links and meta refreshes, resolved against its address."""
    found = []
    for tag in TAG.findall(html):
        given = {name.lower(): value.strip("\"'") for name, value in ATTRIBUTE.findall(tag)}
        link = None
        if tag[1:5].lower() == "link" and "canonical" in given.get("rel", "").lower().split():
            link = given.get("href")
        elif tag[1:5].lower() == "meta" and given.get("http-equiv", "").lower() == "refresh":
            target = TARGET.search(given.get("content", ""))
            link = target and target[1]
        if link and link.strip():
            try:
                found.append(urljoin(base, unescape(link).strip()))
            except ValueError:  # not an address
                continue
    return found


def link_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """`(url, target)` of canonical links and of redirects by meta refresh; addresses as they stand, made absolute."""
    lower = F.lower(F.col(html_col))
    marked = pages.filter(F.col(url_col).isNotNull() & (lower.contains("canonical") | lower.contains("refresh")))

    def run(batches):
        for batch in batches:
            rows = [(u, t) for u, h in zip(batch["url"].to_pylist(), batch["html"].to_pylist(), strict=True)
                    for t in _links(h, u)]
            yield pa.RecordBatch.from_pydict({"url": pa.array([r[0] for r in rows], pa.string()),
                                              "target": pa.array([r[1] for r in rows], pa.string())})

    few = marked.select(F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return few.mapInArrow(run, "url string, target string")


def match_rules(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """Longest fitting rule of each distinct (host, path): adds rule and action, NULL where none fits.

    Each suffix of a host (as many as it has labels) is joined with the rules' hosts; of equally long rules allow wins.
    """
    keys = addresses.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = keys.select("host", "path", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))).alias("suffix"))
    own = rules.select(F.col("host").alias("suffix"), F.col("path").alias("start"), "action")
    fits = suffixes.join(own, "suffix").filter(F.col("path").startswith(F.col("start")))
    rule = F.concat("suffix", "start")
    best = fits.groupBy("host", "path").agg(F.max(F.struct(
        F.length(rule).alias("size"), (F.col("action") == ALLOW).alias("allow"), rule.alias("rule"), "action")).alias("b"))
    return keys.join(best, ["host", "path"], "left").select(
        "host", "path", F.col("b.rule").alias("rule"), F.col("b.action").alias("action"))


def judge(pages: DataFrame, rules: DataFrame, edges: DataFrame | None = None, id_col: str = "page_id",
          url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, alias_root (smallest node of its component, else NULL).

    `rules` holds (host, path, action); `edges` further redirects (url, target), for instance from a crawl log. A page
    without a rule takes its component's decision: allow if any member is explicitly allowed, block if any is blocked,
    else allow. Rules apply to link targets too, also to those that are no page here. Without an address: allow.
    """
    few = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    found = link_edges(pages, url_col, html_col)
    if edges is not None:
        found = found.unionByName(edges.select("url", "target"))
    pairs = found.select(_node(F.col("url")).alias("u"), _node(F.col("target")).alias("v"))
    roots = components(pairs, "url-components")
    members = roots.select("node", "root", F.regexp_extract("node", r"(?s)^([^/?#]*)", 1).alias("host"),
                           F.regexp_extract("node", r"(?s)^[^/?#]*([^?#]*)", 1).alias("path"))
    decided = members.join(match_rules(members, rules), ["host", "path"]).groupBy("root").agg(
        F.max((F.col("action") == ALLOW).cast("int")).alias("allowed"),
        F.max((F.col("action") == BLOCK).cast("int")).alias("blocked"))
    aliases = roots.join(decided, "root").select(
        "node", F.col("root").alias("alias_root"),
        F.when(F.coalesce("allowed", F.lit(0)) == 1, ALLOW).when(F.col("blocked") == 1, BLOCK).alias("carried"))
    own = few.select("page_id", _host(F.col("url")).alias("host"), _path(F.col("url")).alias("path"),
                     _node(F.col("url")).alias("node"))
    ruled = own.join(match_rules(own, rules), ["host", "path"], "left").join(aliases, "node", "left")
    return ruled.select("page_id", "host", "path", "rule",
                        F.coalesce("action", "carried", F.lit(ALLOW)).alias("verdict"), "alias_root")
