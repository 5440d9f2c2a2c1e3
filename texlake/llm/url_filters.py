"""URL filters with redirect equivalence.

Urls are nodes; a redirect (meta refresh) or a canonical link of a page is an edge from the page's url to its
target, and further edges may be given as a table. Entities in a target are decoded, and a target without a scheme is
resolved against the page's url (a ``<base>`` element is not read); other schemes than those with ``//`` name no page. Connected components of this graph are sets of aliases. A
url that a rule fits has that rule's verdict (explicit rules, allow included, take precedence over anything
propagated). Any other url is blocked if an alias of it is blocked by a rule and no alias is explicitly allowed; otherwise
it is allowed.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: what follows up to ``?``, ``#``
or the end. A null url, or one without ``://``, has an empty host and path, fits no rule and has no alias.
Scheme and fragment do not tell nodes apart. Pages that share a url share its node; repeated rows stay.

Rules are a list in the program, so joining them means one expression, not a join; edges and components are
distributed tables. Only nodes with an edge enter the components, so the hosts' sizes do not matter.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape
from html.entities import html5
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_checkpoint
from .components import connected_components

#: The rules (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlParts:
    host: Column
    path: Column
    node: Column


def parts(url: Column) -> UrlParts:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*+", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*+([^?#]*+)", 1)
    node = F.concat(host, F.regexp_extract(rest, r"^[^/?#]*+([^#]*+)", 1))
    return UrlParts(host, path, F.when(host != "", node))


def ruled(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The longest rule that fits, as a struct (rule, verdict); null if none does.

    Length is that of host and path together; of two equally long ones the longer host, then the first by text.
    """
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[1] + r[2], r[0]))
    out = None
    for verdict, rule_host, rule_path in ordered:
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


#: A character reference, as attributes read them: a name without ``;`` does not count before ``=``, a letter or a digit.
REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|([A-Za-z][A-Za-z0-9]*+(?:;|(?!=))))")
SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")


def resolve(base: str, target: str) -> str | None:
    """The absolute url of a link's target as the page at ``base`` writes it; None if it names no page."""
    target = REFERENCE.sub(lambda m: unescape(m[0]) if m[1] is None or m[1] in html5 else m[0], target).strip(" \t\r\n\f\"'")
    if scheme := SCHEME.match(target):
        return target if target.startswith("//", scheme.end()) else None
    try:  # the scheme tells no nodes apart, and http is one that relative targets are defined for
        return urljoin("http://" + base.partition("://")[2], target) if "://" in base else None
    except ValueError:
        return None


def html_links(pages: DataFrame) -> DataFrame:
    """(src, dst): urls of pages and the absolute urls of their canonical links and meta refreshes."""

    @F.arrow_udf("string")
    def resolved(base: pa.Array, target: pa.Array) -> pa.Array:
        return pa.array([resolve(b, t) if b and t else None for b, t in zip(base.to_pylist(), target.to_pylist(), strict=True)], pa.string())

    tags = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"(?is)<(?:link|meta)\s[^>]*+>"), F.lit(0))
    tag = F.col("tag")
    canonical = F.when(tag.rlike(r"(?is)^<link\s.*\brel\s*=\s*[\"']?canonical\b"), F.regexp_extract(tag, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]++)", 1))
    refresh = F.when(tag.rlike(r"(?is)^<meta\s.*\bhttp-equiv\s*=\s*[\"']?refresh\b"), F.regexp_extract(tag, r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]++)", 1))
    found = pages.where("url is not null").select("url", F.explode(tags).alias("tag"))
    targets = found.select(F.col("url").alias("src"), F.coalesce(canonical, refresh).alias("target")).where("target <> ''")
    return targets.select("src", resolved("src", "target").alias("dst")).where("dst is not null")


def judge(pages: DataFrame, rules: tuple = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of every page; ``redirects`` may hold further edges (src, dst) between urls."""
    links = html_links(pages)
    if redirects is not None:
        links = links.union(redirects.select("src", "dst"))
    edges = links.select(parts(F.col("src")).node.alias("src"), parts(F.col("dst")).node.alias("dst")).where("src is not null and dst is not null and src <> dst")
    components = connected_components(edges)
    split = F.split(F.col("node"), r"[/?#]", 2)
    found = ruled(F.get(split, F.lit(0)), F.regexp_extract("node", r"^[^/?#]*+([^?#]*+)", 1), rules)["verdict"]
    verdicts = components.withColumn("v", found).groupBy("component").agg(F.bool_or(F.col("v") == "block").alias("blocked"), F.bool_or(F.col("v") == "allow").alias("allowed"))
    spread = components.join(verdicts.where("blocked and not coalesce(allowed, false)"), "component").select(F.col("node").alias("alias"))
    spread = shared_checkpoint(spread)
    own = parts(F.col("url"))
    rows = pages.select("page_id", own.host.alias("host"), own.path.alias("path"), own.node.alias("node"))
    rows = rows.withColumn("found", ruled(F.col("host"), F.col("path"), rules))
    if spread.isEmpty():
        rows = rows.withColumn("alias", F.lit(None).cast("string"))
    else:
        rows = rows.join(spread, rows["node"] == spread["alias"], "left")
    propagated = F.when(F.col("alias").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return rows.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", propagated).alias("verdict"))
