"""URL filter: host and path rules, carried to aliases over redirects and canonical links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from visitlens.llm.common import ascii_lower, let, written
from visitlens.llm.components import connected_components

ABSOLUTE = r"^[A-Za-z][A-Za-z0-9+.\-]*://"


def _after_scheme(url: Column) -> Column:
    """What follows the first `://`; empty for null and where there is none."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def alias_key(url: Column) -> Column:
    """Host, path and query of a url, without scheme, fragment and campaign parameters; null where there is no host."""
    query = F.regexp_extract(_after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, r"(^|&)utm_[^&]*", ""), "^&", "")
    parts = F.struct(host_of(url).alias("host"), path_of(url).alias("path"), query.alias("query"))
    return let(parts, lambda p: F.when(p["host"] != "", F.concat(
        p["host"], F.when(p["path"] == "", "/").otherwise(p["path"]),
        F.when(p["query"] != "", F.concat(F.lit("?"), p["query"])).otherwise(""))))


def _resolved(target: Column, url: Column) -> Column:
    """A link's target as a full url."""
    scheme = F.regexp_extract(url, r"^(.*?)://", 1)
    origin = F.concat(scheme, F.lit("://"), host_of(url))
    folder = F.concat(origin, F.regexp_extract(path_of(url), r"^(.*)/", 1), F.lit("/"))
    return (
        F.when(target.rlike(ABSOLUTE), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(origin, target))
        .otherwise(F.concat(folder, target)))


def link_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Redirects of a page to another url (`from_url`, `to_url`): canonical links and refresh tags of its markup."""
    def tags(name, test):
        found = F.regexp_extract_all(F.coalesce(pages[html_col], F.lit("")), F.lit(rf"(?i)<{name}\b[^>]*>"), F.lit(0))
        return F.filter(found, lambda tag: tag.rlike(test))

    href = r"""(?i)\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""
    canonical = F.transform(tags("link", r"""(?i)\brel\s*=\s*["']?canonical\b"""), lambda tag: F.concat(
        *[F.regexp_extract(tag, href, i) for i in (1, 2, 3)]))
    refresh = F.transform(tags("meta", r"""(?i)\bhttp-equiv\s*=\s*["']?refresh\b"""), lambda tag: F.regexp_extract(
        tag, r"""(?i)\burl\s*=\s*["']?([^"'>\s]+)""", 1))
    links = pages.select(pages[url_col].alias("from_url"), F.explode(F.concat(canonical, refresh)).alias("target"))
    return links.filter("target != '' and from_url is not null").select(
        "from_url", _resolved(F.col("target"), F.col("from_url")).alias("to_url"))


def rule_for(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """`urls` (with `host`, `path`) with `rule` and `rule_verdict` of the longest rule that fits, or nulls.

    `rules` has `host`, `path`, `verdict`. Only the distinct hosts meet the rules, once per suffix of the host; what fits
    a host goes back to its urls by a join that splits heavy hosts.
    """
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(
        F.slice(labels, i, F.size(labels)), "."))
    hosts = urls.select("host").filter("host != ''").distinct().select("host", F.explode(suffixes).alias("suffix"))
    named = rules.select(F.col("host").alias("suffix"), F.col("path").alias("prefix"), "verdict")
    fitting = hosts.join(named, "suffix").groupBy("host").agg(F.collect_list(F.struct(
        (F.length("suffix") + F.length("prefix")).alias("size"), F.concat("suffix", "prefix").alias("rule"), "verdict",
        "prefix")).alias("fitting"))
    fitting = written(fitting)  # a table of its own, so that the join may split heavy hosts
    best = F.array_max(F.filter("fitting", lambda rule: F.startswith(F.col("path"), rule["prefix"])))
    return urls.join(fitting, "host", "left").withColumn("best", best).select(
        *[c for c in urls.columns], F.col("best")["rule"].alias("rule"), F.col("best")["verdict"].alias("rule_verdict"))


def judge_urls(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, url_col: str = "url",
               html_col: str = "html", carry: list[str] | None = None) -> DataFrame:
    """`pages` (or its columns in `carry`) with `host`, `path`, `rule` and `verdict` (allow or block).

    A rule (`host`, `path`, `verdict`) fits its host and subdomains where the path starts with the rule's; the longest
    decides. Pages no rule fits are blocked if an alias of theirs is blocked by a rule, else allowed; a page that a rule
    allows stays allowed whatever its aliases are. Aliases are urls in one component over `redirects` (`from_url`,
    `to_url`), canonical links and refresh tags; urls that differ in scheme, fragment or campaign parameters only are one.
    A null url, and one without `://`, has empty host and path, no rule and no alias, and is allowed. Null markup has no
    links. Repeated rows are judged alike, and an empty table stays empty. Columns of the input of these names are replaced.
    """
    taken = ("host", "path", "rule", "verdict")
    names = [c for c in (pages.columns if carry is None else carry) if c.lower() not in taken]
    url = pages[url_col]
    rows = pages.select(
        F.struct(*[pages[c] for c in names]).alias("row"),
        host_of(url).alias("host"), path_of(url).alias("path"), alias_key(url).alias("key"))
    links = link_edges(pages, url_col, html_col)
    if redirects is not None:
        links = links.union(redirects.select("from_url", "to_url"))
    edges = links.select(alias_key(F.col("from_url")).alias("a"), alias_key(F.col("to_url")).alias("b"))
    members = connected_components(edges, "a", "b")
    judged_members = rule_for(members.select(
        "node", "component", F.regexp_extract("node", "^[^/?]*", 0).alias("host"),
        F.regexp_extract("node", r"^[^/?]*([^?]*)", 1).alias("path")), rules)
    blocked = judged_members.filter("rule_verdict = 'block'").select("component").distinct()
    blocked_keys = members.join(blocked, "component").select(F.col("node").alias("key"), F.lit(True).alias("by_alias"))
    judged = rule_for(rows, rules).join(blocked_keys, "key", "left")
    verdict = F.coalesce("rule_verdict", F.when(F.col("by_alias"), "block"), F.lit("allow"))
    kept = [F.col("row").getField(c).alias(c) for c in names]
    return judged.select(*kept, "host", "path", "rule", verdict.alias("verdict"))
