"""URL filters: host and path rules, with block decisions passed on over redirects and canonical links."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.llm.components import connected_components
from tablemill.llm.shared import free_name
from tablemill.session import materialize

ALLOW, BLOCK = "allow", "block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules are tried in every row, so their number is bounded.
MOST_RULES = 10_000


@dataclass(frozen=True)
class Rule:
    """A verdict for a host, all its subdomains, and the paths that start with `path`."""

    verdict: str
    host: str
    path: str = "/"


def parse_rule(text: str) -> Rule:
    """From a text like `block example.org/es/`."""
    verdict, _, place = text.partition(" ")
    host, slash, path = place.partition("/")
    if verdict not in (ALLOW, BLOCK) or not host:
        raise ValueError(f"Not a rule: {text!r}")
    return Rule(verdict, host, slash + path)


def host_of(url: Column) -> Column:
    """What follows the first `://`, up to `/`, `?`, `#` or the end, A-Z in lower case; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end; empty without `://`."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def usual_redirect(url: Column) -> Column:
    """Where sites send such a url as a rule: https, no `www.`, no fragment, no tracking parameters, no slash at the end.

    Null for what is no url.
    """
    host, path = F.regexp_replace(host_of(url), r"^www\.", ""), F.regexp_replace(path_of(url), "/+$", "")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    query = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^utm_")), "&")
    plain = F.concat(F.lit("https://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(host != "", plain)


def _flat(path: Column) -> Column:
    """A path without `.` and `..` parts, as browsers read it."""
    parts = F.split(path, "/")
    kept = lambda a, x: F.when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(1)))).when(x == ".", a).otherwise(F.concat(a, F.array(x)))
    flat = F.aggregate(parts, F.array().cast("array<string>"), kept)
    closing = F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise("")
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.concat(F.array_join(flat, "/"), closing)).otherwise(path)


def resolved(link: Column, url: Column) -> Column:
    """The address that a link on a page means, null if it means none: whole, or from the page's scheme, host or folder."""
    scheme, authority = F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1), F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    site = F.concat(scheme, F.lit("://"), authority)
    place, behind = F.regexp_extract(link, r"(?s)^([^?#]*)", 1), F.regexp_extract(link, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.regexp_replace(F.when(path_of(url) == "", "/").otherwise(path_of(url)), r"[^/]*$", "")
    relative = (
        F.when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(site, _flat(place), behind))
        .when(F.startswith(link, F.lit("?")), F.concat(site, path_of(url), link))
        .when((link != "") & ~F.startswith(link, F.lit("#")) & ~link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.concat(site, _flat(F.concat(folder, place)), behind))
    )
    return F.when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), link).when((scheme != "") & (authority != ""), relative)


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst): usual redirects, and the canonical links and immediate redirects that pages state.

    Addresses may be relative to the page and have `&amp;` for `&`; what stands in a comment is
    not stated. Null urls and null pages state nothing.
    """
    shown = F.regexp_replace(F.coalesce(html_col, F.lit("")), r"(?s)<!--.*?(?:-->|\z)", "")
    tags = F.regexp_extract_all(shown, F.lit(r"(?i)<(?:link|meta)\b[^>]*(?:canonical|http-equiv\s*=\s*[\"']?refresh)[^>]*>"), F.lit(0))
    address = lambda t: F.replace(F.regexp_extract(t, r"(?i)(?:href\s*=\s*|url\s*=\s*)[\"']?([^\"'\s>]+)", 1), F.lit("&amp;"), F.lit("&"))
    stated = F.transform(tags, lambda t: resolved(address(t), F.col(url_col)))
    ends = F.concat(F.array(usual_redirect(F.col(url_col))), stated)
    ends = pages.where(F.col(url_col).isNotNull()).select(F.col(url_col).alias("src"), F.explode(ends).alias("dst"))
    return ends.where("dst <> '' and dst <> src")


def _rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES} are taken.")
    ordered = sorted(rules, key=lambda r: (-len(r.host + r.path), r.host + r.path, r.verdict))
    listed = F.array(*[F.struct(F.lit(r.host).alias("host"), F.lit(r.path).alias("path"), F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict")) for r in ordered])
    fits = lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"])
    return F.get(F.filter(listed, fits), F.lit(0)) if rules else F.lit(None).cast("struct<host:string,path:string,rule:string,verdict:string>")


def filter_urls(pages: DataFrame, rules: Sequence[Rule], edges: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, url, host, path, rule, verdict, by_alias for every row.

    The longest fitting rule decides (of equally long ones the first by code points, allow
    before block). A url without a rule is blocked if a url that is equivalent to it is blocked
    by a rule; by_alias tells. Equivalent are urls connected over `edges` (src, dst), in any
    number of steps and either direction. A rule's allow always stands, also among blocked
    aliases, and is not passed on; all else is allowed. Null urls have no host, path, rule or
    aliases and are allowed. Repeated rows get equal verdicts, other columns are ignored.
    """
    url, taken = F.col(url_col), free_name(pages, "_rule")
    judged = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    judged = judged.withColumn(taken, _rule_for(F.col("host"), F.col("path"), rules))
    judged = materialize(judged.select("page_id", "url", "host", "path", f"{taken}.rule", F.col(f"{taken}.verdict").alias("said")), "judged")
    parts = connected_components(page_links(pages, url_col) if edges is None else edges, "src", "dst")
    blocked = judged.where(F.col("said") == BLOCK).select("url").distinct()
    bad = parts.join(blocked, F.col("node") == F.col("url"), "left_semi").select("component").distinct()
    aliases = parts.join(bad, "component", "left_semi").select(F.col("node").alias("url"), F.lit(True).alias("alias"))
    by_alias = F.col("said").isNull() & F.coalesce("alias", F.lit(False))
    verdict = F.coalesce("said", F.when(by_alias, BLOCK).otherwise(ALLOW))
    return judged.join(aliases, "url", "left").select("page_id", "url", "host", "path", "rule", verdict.alias("verdict"), by_alias.alias("by_alias"))
