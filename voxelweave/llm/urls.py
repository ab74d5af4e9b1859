"""URL filters: allow and block rules, and redirect equivalence that carries block decisions to aliases."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelweave.llm.common import ascii_lower, spill
from voxelweave.llm.components import components


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


def host_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased; path: then up to ?, # or the end.

    A null url, or one with no ://, has an empty host and path.
    """
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule as host + path, its verdict) of the longest rule that fits, or nulls; allow goes first at a tie.

    A rule fits its host and all subdomains if the path starts with the rule's.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.host) + len(r.path), r.verdict == "allow")):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, F.lit(r.host + r.path)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def _attr(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, quoted or bare; empty if there is none."""
    return F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*([\"']?)(.*?)\1(?=\s|/?>|\z)", 2)


def normal(url: Column) -> Column:
    """One spelling for equivalent URLs: scheme and host lower-cased, no default port, no fragment, no dot segments in the
    path, / for an empty path. Text without :// only loses its fragment; a null stays null."""
    u = F.regexp_replace(url, r"(?s)#.*\z", "")
    scheme = ascii_lower(F.regexp_extract(u, r"\A([^:/?#]*)://", 1))
    host = ascii_lower(F.regexp_extract(u, r"\A[^:/?#]*://([^/?#]*)", 1))
    host = F.when(scheme == "http", F.regexp_replace(host, r":(80)?\z", "")).when(scheme == "https", F.regexp_replace(host, r":(443)?\z", "")).otherwise(host)
    path = F.regexp_extract(u, r"(?s)\A[^:/?#]*://[^/?#]*([^?]*)", 1)
    query = F.regexp_extract(u, r"(?s)\A[^?]*(\?.*)\z", 1)
    parts = F.split(path, "/")
    up = lambda kept: F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))
    kept = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(F.lit("")), lambda k, p: F.when(p == ".", k).when(p == "..", up(k)).otherwise(F.concat(k, F.array(p))))
    plain = F.concat_ws("/", F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept))
    # most paths have no dot segment
    path = F.when(path == "", "/").when(path.contains("/."), F.when(plain == "", "/").otherwise(plain)).otherwise(path)
    return F.when(u.contains("://"), F.concat(scheme, F.lit("://"), host, path, query)).otherwise(u)


def resolve(base: Column, link: Column) -> Column:
    """An absolute URL for link, without its fragment: absolute, //host, /path, ?query or relative to base's folder.

    Null where the link is empty or only a fragment, or where either is null.
    """
    link = F.regexp_replace(F.trim(link), r"(?s)#.*\z", "")
    scheme = F.regexp_extract(base, r"\A([^:/?#]*:)//", 1)
    origin = F.regexp_extract(base, r"\A[^:/?#]*://[^/?#]*", 0)
    page = F.regexp_extract(base, r"\A[^?#]*", 0)
    folder = F.regexp_extract(page, r"(?s)\A([^:/?#]*://[^/]*(?:/.*/|/))", 1)
    folder = F.when(folder == "", F.concat(page, F.lit("/"))).otherwise(folder)
    return (
        F.when(link.rlike(r"(?i)\A[a-z][a-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), F.concat(origin, link))
        .when(link.startswith("?"), F.concat(page, link))
        .when(link == "", F.lit(None).cast("string"))
        .otherwise(F.concat(folder, link))
    )


def aliases(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst) edges: a page's canonical links, og:url and refresh redirects, as absolute URLs.

    The tags are looked for in the whole page, however long or broken; comments and scripts are left out. Links are
    relative to the page's first <base href>, if it has one.
    """
    html = F.regexp_replace(F.col(html_col), r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", "")
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))
    hint = F.col(html_col).rlike(r"(?i)canonical|refresh|og:url")
    x = pages.filter(hint & F.col(url_col).isNotNull()).select(F.col(url_col).alias("src"), F.regexp_extract(html, r"(?is)<base\b[^>]*>", 0).alias("base"), F.explode(tags).alias("tag"))
    canonical = _attr(F.col("tag"), "rel").rlike(r"(?i)(\A|\s)canonical(\s|\z)")
    refresh = F.lower(_attr(F.col("tag"), "http-equiv")) == "refresh"
    og = F.lower(_attr(F.col("tag"), "property")) == "og:url"
    goes = F.regexp_extract(_attr(F.col("tag"), "content"), r"(?is);\s*url\s*=\s*[\"']?([^\"']*)", 1)
    link = F.when(canonical, _attr(F.col("tag"), "href")).when(refresh, goes).when(og, _attr(F.col("tag"), "content"))
    link = F.regexp_replace(link, "&amp;", "&")
    x = spill(x.select("src", _attr(F.col("base"), "href").alias("base"), link.alias("link")).filter("link is not null and link != ''"), "links")
    base = F.coalesce(resolve(F.col("src"), F.col("base")), F.col("src"))
    return x.select("src", resolve(base, F.col("link")).alias("dst")).filter("dst is not null")


def judge(pages: DataFrame, rules: Sequence[Rule], edges: DataFrame | None = None, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """pages with host, path, rule and verdict (columns of these names are replaced).

    The longest rule that fits decides. Where none does, the page takes part in an equivalence class of URLs: those
    that redirects and canonical links join (edges of (src, dst); by default read from the html). If a rule blocks
    any URL of the class, a page of it or only a link's target, the page is blocked; an explicit allow rule always goes
    first, for its own URL alone, and doesn't undo what the class inherits. All others are allowed.

    Equivalent spellings of a URL (see normal) are one node. Null urls have no aliases and are allowed; a null html has
    no links; repeated rows are judged alike; an empty table gives an empty result. Classes are found by distributed star rounds over linked URLs only.
    """
    at = "__node"
    rest = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    host, path = host_path(F.col(url_col))
    own = pages.select(*rest, host.alias("host"), path.alias("path"))
    name, verdict = rule_for(F.col("host"), F.col("path"), rules)
    own = own.withColumn("rule", name).withColumn("__own", verdict)
    e = aliases(pages, url_col, html_col) if edges is None else edges
    e = spill(e.select(normal(F.col("src")).alias("src"), normal(F.col("dst")).alias("dst")).filter("src != dst").distinct(), "aliases")
    cc = components(e)
    nh, np = host_path(F.col("node"))
    blocked = cc.withColumn("__v", rule_for(nh, np, rules)[1]).groupBy("component").agg(F.max((F.col("__v") == "block").cast("int")).alias("hit")).filter("hit = 1").select(F.col("component").alias("c"))
    hit = cc.join(blocked, F.col("component") == F.col("c"), "left_semi").select(F.col("node").alias(at)).distinct()
    # Only pages that no rule decides need the join.
    joined = own.withColumn("__key", F.when(F.col("__own").isNull(), normal(F.col(url_col)))).join(hit, F.col("__key") == F.col(at), "left")
    return joined.select(*rest, "host", "path", "rule", F.coalesce("__own", F.when(F.col(at).isNotNull(), F.lit("block")), F.lit("allow")).alias("verdict"))
