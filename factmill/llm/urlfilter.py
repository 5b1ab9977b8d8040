"""URL filters whose decisions spread over redirects and canonical links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factmill.llm.common import ascii_lower, materialize
from factmill.llm.components import connected_components


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null or no ``://``: empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; null or no ``://``: empty."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def page_key(url: Column) -> Column:
    """The node of a url: all of it but its fragment, with A-Z of scheme and host lower-cased. Null where there is no host.
    Urls that differ otherwise are one page only where a link says so."""
    query = F.regexp_extract(_after_scheme(url), r"^[^?#]*(\?[^#]*)", 1)
    scheme = ascii_lower(F.substring_index(url, "://", 1))
    return F.when(host_of(url) != "", F.concat(scheme, F.lit("://"), host_of(url), path_of(url), F.coalesce(query, F.lit(""))))


def html_links(html: Column) -> Column:
    """Targets of canonical links and of refresh redirects that a page declares, as they stand, as an array."""
    canonical = F.regexp_extract_all(html, F.lit(r"""(?i)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""), 1)
    refresh = F.regexp_extract_all(html, F.lit(r"""(?i)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\burl\s*=\s*["']?([^"'\s>;]+)"""), 1)
    return F.concat(canonical, refresh)


def resolved(target: Column, base: Column) -> Column:
    """A link's target as a whole url: as it is, or from the scheme, host or folder of the page that names it. Null for
    targets of other kinds, and where the page has no host. Dot segments stay."""
    scheme = F.regexp_extract(base, "(?s)^(.*?)://", 1)
    root = F.concat(scheme, F.lit("://"), host_of(base))
    folder = F.concat(root, F.regexp_replace(F.when(path_of(base) == "", "/").otherwise(path_of(base)), "[^/]*$", ""))
    inside = F.when(target.startswith("//"), F.concat(scheme, F.lit(":"), target)).when(target.startswith("/"), F.concat(root, target)).when(~target.rlike("^(?:[A-Za-z][A-Za-z0-9+.-]*:|[?#])"), F.concat(folder, target))
    return F.when(F.instr(target, "://") > 0, target).when(host_of(base) != "", inside)


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls: host, path. rules: host, path, verdict (allow or block). Returns host, path, rule, verdict once for each
    pair that some rule fits: a rule fits its host and all subdomains where the path starts with the rule's; the
    longest wins, and of two equal ones allow.

    Only equi-joins: a host is exploded into its suffixes, and for each suffix into the path lengths that its rules
    have, so the work follows the urls and their rules' lengths, however many rules one suffix has.
    """
    lengths = rules.groupBy(F.col("host").alias("suffix")).agg(F.collect_set(F.length("path")).alias("lengths"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    pairs = urls.select("host", "path").where(F.col("host") != "").distinct()
    tried = pairs.select("host", "path", F.explode(suffixes).alias("suffix")).join(lengths, "suffix")
    tried = tried.select("host", "path", "suffix", F.explode("lengths").alias("n")).where(F.col("n") <= F.length("path"))
    keyed = tried.withColumn("start", F.substring(F.col("path"), F.lit(1), F.col("n")))
    named = rules.select(F.col("host").alias("suffix"), F.col("path").alias("start"), "verdict")
    fitting = keyed.join(named, ["suffix", "start"])
    rule = F.concat("suffix", "start")
    best = fitting.groupBy("host", "path").agg(F.max(F.struct(F.length(rule).alias("n"), (F.col("verdict") == "allow").alias("allow"), rule.alias("rule"))).alias("b"))
    return best.select("host", "path", F.col("b.rule").alias("rule"), F.when(F.col("b.allow"), "allow").otherwise("block").alias("verdict"))


def judge_urls(pages: DataFrame, rules: DataFrame, links: DataFrame) -> DataFrame:
    """pages: page_id, url (any other columns are ignored). links: two columns of urls, a redirect or canonical link
    each; nothing else makes two urls aliases. Returns per page: page_id, url, host, path, rule, verdict, alias_group, basis.

    A page's own rule decides first, so an explicit allow holds even among blocked aliases. A page without a rule is
    blocked if any member of its component of links is blocked by a rule, and else allowed. alias_group is the
    smallest key of the component, null where a url has no links. Null and odd urls have an empty host, no rule and
    no links: allow. Repeated pages get a row each; no pages: no rows.
    """
    slim = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), page_key(F.col("url")).alias("key"))
    a, b = links.columns
    links = materialize(links, "links")
    groups = materialize(connected_components(links.select(page_key(F.col(a)).alias("a"), page_key(F.col(b)).alias("b"))), "aliases")
    nodes = groups.select("node", host_of(F.col("node")).alias("host"), path_of(F.col("node")).alias("path"))
    ruled = materialize(match_rules(slim.select("host", "path").union(nodes.select("host", "path")), rules), "ruled")
    # These tables grow with the pages: merge joins, whatever their size looks like.
    sorted_ = lambda df: df.hint("merge")
    blocked = nodes.join(sorted_(ruled.where(F.col("verdict") == "block")), ["host", "path"]).join(sorted_(groups), "node").select("component").distinct()
    spread = materialize(groups.join(sorted_(blocked.withColumn("hit", F.lit(True))), "component", "left").select(F.col("node").alias("key"), F.col("component").alias("alias_group"), "hit"), "spread")
    judged = slim.join(sorted_(ruled), ["host", "path"], "left").join(sorted_(spread), "key", "left")
    own, hit = F.col("verdict"), F.coalesce("hit", F.lit(False))
    basis = F.when(own.isNotNull(), "rule").when(hit, "alias").otherwise("default")
    return judged.select("page_id", "url", "host", "path", "rule", F.coalesce(own, F.when(hit, "block").otherwise("allow")).alias("verdict"), "alias_group", basis.alias("basis"))


def page_links(pages: DataFrame) -> DataFrame:
    """The links that the pages' own html declares: src, dst (a whole url)."""
    some = F.lower("html").contains("canonical") | F.lower("html").contains("refresh")
    each = pages.where(some).select(F.col("url").alias("src"), F.explode(html_links(F.col("html"))).alias("target"))
    return each.select("src", resolved(F.col("target"), F.col("src")).alias("dst")).where("dst is not null")
