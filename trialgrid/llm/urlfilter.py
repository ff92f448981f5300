"""URL filters: rules by host and path, and block decisions that reach the aliases of a URL."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialgrid.llm.components import connected_components
from trialgrid.session import broadcast_if_small, cut_lineage

ALLOW, BLOCK = "allow", "block"
#: A-Z only, whatever the locale.
#: Parameters that tell where a visitor came from, not which page is shown. Fixed values.
TRACKING = r"^(utm_[^=]*|gclid|fbclid|msclkid)(=|$)"
#: Entities that stand for signs of URLs, `&amp;` last. Fixed values.
ENTITIES = {"&#38;": "&", "&#x26;": "&", "&#47;": "/", "&#x2f;": "/", "&#x2F;": "/", "&sol;": "/", "&amp;": "&"}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with all its subdomains, where the path starts with the rule's."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule(BLOCK, "net", "/"),
    Rule(ALLOW, "example.net", "/en/"),
    Rule(BLOCK, "example.com", "/de/"),
    Rule(ALLOW, "org", "/fr/"),
)


def url_host(url: Column) -> Column:
    """What is between the first `://` and the next `/`, `?`, `#` or the end, in lower case; empty without `://` or for null."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end; empty without `://` or for null."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits; null if none does. Of equally long ones an allow wins."""
    found = F.lit(None)
    for rule in sorted(rules, key=lambda r: (len(r.name), r.verdict == ALLOW, r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def url_node(url: Column) -> Column:
    """Host, path and query: the place a URL names, whatever its scheme and fragment; null without a host."""
    host = url_host(url)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*(\?[^#]*)?", 1)
    return F.when(host != "", F.concat(host, url_path(url), query))


def kept_query(url: Column) -> Column:
    """The query without tracking parameters, with its `?`; empty if nothing is left."""
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*\??([^#]*)", 1)
    rest = F.array_join(F.filter(F.split(query, "&"), lambda one: (one != "") & ~one.rlike(TRACKING)), "&")
    return F.when(rest != "", F.concat(F.lit("?"), rest)).otherwise(F.lit(""))


def canonical_node(url: Column) -> Column:
    """Where sites commonly redirect a URL: no `www.` or `m.`, tracking parameter, trailing `/`, `/index.html` or `.html`."""
    host = F.regexp_replace(url_host(url), r"^(www|m)\.", "")
    path = F.regexp_replace(url_path(url), r"(/index)?(\.html?)?/?$", "")
    return F.when(host != "", F.concat(host, path, kept_query(url)))


def _without_dots(path: Column) -> Column:
    """A path whose `.` and `..` are carried out."""
    parts = F.transform(F.split(path, "/"), lambda p: p)
    nothing = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))  # what is in front of the first `/` stays
        return F.when(part == ".", done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    kept = F.array_join(F.aggregate(parts, nothing, step), "/")
    return F.when(path.rlike(r"(^|/)\.{1,2}$") & ~kept.endswith("/"), F.concat(kept, F.lit("/"))).otherwise(kept)


def resolve_url(url: Column, target: Column) -> Column:
    """The URL that a link in the page `url` leads to; null for one to the page itself, or to no page.

    A target is absolute, or it starts at the scheme (`//`), the host (`/`), the query (`?`) or else the page's folder.
    """
    for entity, sign in ENTITIES.items():
        target = F.replace(target, F.lit(entity), F.lit(sign))
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    site = F.concat(scheme, F.lit("://"), url_host(url))
    folder = F.regexp_replace(F.when(url_path(url) == "", "/").otherwise(url_path(url)), r"[^/]*$", "")
    path = F.regexp_extract(target, r"(?s)^([^?#]*)", 1)
    rest = F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when((url_host(url) == "") | (target == "") | target.startswith("#"), F.lit(None))
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(target.startswith("?"), F.concat(site, url_path(url), target))
        .when(target.startswith("/"), F.concat(site, _without_dots(path), rest))
        .otherwise(F.concat(site, _without_dots(F.concat(folder, path)), rest))
    )


def declared_targets(url: Column, html: Column) -> Column:
    """The URLs that a page names as its canonical links or as targets of a refresh, all of them, resolved."""
    page = F.coalesce(html, F.lit(""))
    value = r"\s*=\s*[\"']?([^\"'\s>]+)"
    link = rf"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*\bhref{value}"
    meta = rf"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*\burl{value}"
    found = F.concat(F.regexp_extract_all(page, F.lit(link), F.lit(1)), F.regexp_extract_all(page, F.lit(meta), F.lit(1)))
    return F.transform(found, lambda target: resolve_url(F.coalesce(url, F.lit("")), target))


def filter_urls(
    pages: DataFrame, ident: str = "page_id", url: str = "url", html: str | None = "html", rules: Sequence[Rule] = RULES
) -> DataFrame:
    """(ident, host, path, rule, verdict, component), one row per page.

    URLs are joined to aliases by their usual redirect, their canonical links and their refresh targets; those may be
    relative, and their entities are decoded. Pages whose queries differ in more than tracking stay apart. A page that a rule
    fits follows the longest one. Any other page follows its aliases: it is allowed if a rule allows one of them, else
    blocked if a rule blocks one, else allowed. Aliases that are only linked to count, too. Null URLs and those without
    `://` have no host, no alias and no rule, and are allowed. Repeated pages and null ids stay as they are.
    """
    address = F.col(url)
    base = pages.select(
        F.col(ident).alias("ident"),
        url_host(address).alias("host"),
        url_path(address).alias("path"),
        url_node(address).alias("node"),
        canonical_node(address).alias("usual"),
        (declared_targets(address, F.col(html)) if html else F.array(F.lit(None).cast("string"))).alias("targets"),
    )
    base = cut_lineage(base)  # html is read once
    links = base.filter("node is not null").select("node", F.explode("targets").alias("target")).filter("target is not null")
    target = F.col("target")
    edges = base.select("node", F.col("usual").alias("other"))
    edges = edges.union(links.select("node", url_node(target))).union(links.select(url_node(target), canonical_node(target)))
    members = cut_lineage(connected_components(edges, "node", "other"))

    place = F.regexp_extract("node", r"(?s)^([^/?#]*)([^?#]*)", 1), F.regexp_extract("node", r"(?s)^([^/?#]*)([^?#]*)", 2)
    ruled = members.select("component", matching_rule(*place, rules).alias("found")).filter("found is not null")
    decided = ruled.groupBy("component").agg(F.min("found.verdict").alias("inherited"))  # "allow" comes before "block"
    inherited = members.join(decided, "component", "left").select(F.col("node").alias("member"), "component", "inherited")
    placed = base.join(broadcast_if_small(cut_lineage(inherited)), F.col("node") == F.col("member"), "left")
    own = matching_rule(F.col("host"), F.col("path"), rules)
    judged = placed.select("ident", "host", "path", own.alias("own"), "inherited", F.coalesce("component", "node").alias("component"))
    return judged.select(
        F.col("ident").alias(ident),
        "host",
        "path",
        F.col("own.rule").alias("rule"),
        F.coalesce(F.col("own.verdict"), F.col("inherited"), F.lit(ALLOW)).alias("verdict"),
        "component",
    )
