"""URL rules with decisions carried along redirects and canonical links, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staytide.llm.components import connected_components
from staytide.llm.text import lower_ascii
from staytide.sources.tables import checkpointed

#: Rules in the form ``host/path``; the parameters of the registered query.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"),
         ("block", "net/fr/")]

_AFTER_SCHEME = r"(?s)^.*?://(.*)$"
_TRACKING = r"(?:^|&)(?:utm_[a-z]+|gclid|fbclid|ref)=[^&]*"
_CANONICAL = r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_REFRESH = r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*\burl\s*=\s*[\"']?([^\"'\s>]+)"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty if there is none."""
    return F.coalesce(F.regexp_extract(url, _AFTER_SCHEME, 1), F.lit(""))


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*(/[^?#]*)?", 1)


def node_of(url: Column) -> Column:
    """One name for trivial aliases of a page: without scheme, ``www.`` or
    ``m.``, tracking parameters, fragment and closing slash. Null without a host."""
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, _TRACKING, ""), "^&", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    return F.when(host != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def absolute(link: Column, base: Column) -> Column:
    """A link of a page as a whole URL."""
    root = F.concat(F.regexp_extract(base, r"^([^:/?#]*://)", 1), host_of(base))
    folder = F.regexp_replace(path_of(base), r"[^/]*$", "")
    return (F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link)
            .when(link.startswith("//"), F.concat(F.lit("http:"), link))
            .when(link.startswith("/"), F.concat(root, link))
            .when(~link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"),
                  F.concat(root, F.when(folder == "", "/").otherwise(folder), link)))


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Struct of the longest rule (``rule``, ``verdict``) for a host and its
    subdomains whose path starts with the rule's; null if none fits. Of two
    rules with one text, allow wins. The rules are compiled into one
    expression, longest first."""
    found = F.lit(None)
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[0] == "allow", r[1])):
        name, slash, tail = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + tail)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``url``, ``target``: redirects (meta refresh) and canonical links of the pages."""
    targets = F.array_compact(F.array(*[
        F.when(F.regexp_extract(html, p, 1) != "", absolute(F.regexp_extract(html, p, 1), F.col(url)))
        for p in (_CANONICAL, _REFRESH)]))
    return pages.select(F.col(url).alias("url"), F.explode(targets).alias("target")).filter(F.col(url).isNotNull())


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], links: DataFrame | None = None) -> DataFrame:
    """Verdict for every row of ``pages`` (``page_id``, ``url``, ``html``).

    A page under a rule follows the longest one. Every other page follows its
    redirect class, the connected component of its URL over ``links`` (by
    default the canonical links and redirects in the pages' HTML): allow if a
    URL of the class is explicitly allowed, else block if one is blocked, else
    allow. Links may point to URLs without a page; rules hold for them too.
    Null URLs and URLs without ``://`` have empty host and path, no rule and
    no aliases. Repeated rows are judged alike; other columns are not read.
    """
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
                        node_of(F.col("url")).alias("node"))
    rows = rows.withColumns({c: F.coalesce(c, F.lit("")) for c in ("host", "path")})
    rule = matching_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule["rule"], "own": rule["verdict"]})
    edges = checkpointed((link_edges(pages) if links is None else links.select("url", "target"))
                         .select("url", "target", node_of(F.col("url")).alias("a"), node_of(F.col("target")).alias("b"))
                         .filter("a is not null and b is not null"))
    ends = edges.select(F.col("url"), F.col("a").alias("node")).unionByName(edges.select(F.col("target").alias("url"), F.col("b").alias("node")))
    stated = ends.select("node", matching_rule(host_of(F.col("url")), path_of(F.col("url")), rules)["verdict"].alias("own"))
    said = (rows.select("node", "own").unionByName(stated).filter("node is not null and own is not null")
            .groupBy("node").agg(F.max(F.col("own") == "allow").alias("allowed"), F.max(F.col("own") == "block").alias("blocked")))
    classes = checkpointed(connected_components(edges.select("a", "b")))
    by_class = (said.join(classes, "node", "left").select(F.coalesce("component", "node").alias("class"), "allowed", "blocked")
                .groupBy("class").agg(F.max("allowed").alias("allowed"), F.max("blocked").alias("blocked")))
    # Verdicts of nodes: only nodes under a decision of their class get a row, and the look-up is by node,
    # the finest key, so that a large class meets no single task.
    members = (said.select("node").unionByName(classes.select("node")).distinct()
               .join(classes, "node", "left").select("node", F.coalesce("component", "node").alias("class")))
    verdicts = checkpointed(members.join(by_class, "class").select(
        F.col("node").alias("alias"), F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").alias("class_verdict")))
    free = rows.filter(F.col("own").isNull() & F.col("node").isNotNull())
    free = free.join(verdicts, F.col("node") == F.col("alias"), "left")
    done = rows.filter(F.col("own").isNotNull() | F.col("node").isNull()).withColumn("class_verdict", F.lit(None).cast("string"))
    columns = ["page_id", "host", "path", "rule", "verdict"]
    verdict = F.coalesce("own", "class_verdict", F.lit("allow")).alias("verdict")
    return (done.select(*columns[:4], verdict).unionByName(free.select(*columns[:4], verdict)))


_NODE = r"""case when {h} <> '' then regexp_replace({h}, '^(www|m)\.', '') || regexp_replace({p}, '/+$', '')
  || case when {q} <> '' then '?' || {q} else '' end end"""
_H = r"translate(regexp_extract(regexp_extract({u}, '^.*?://(.*)$', 1, 's'), '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_P = r"regexp_extract(regexp_extract({u}, '^.*?://(.*)$', 1, 's'), '^[^/?#]*(/[^?#]*)?', 1)"
_Q = (r"regexp_replace(regexp_replace(regexp_extract(regexp_extract({u}, '^.*?://(.*)$', 1, 's'), '^[^?#]*\?([^#]*)', 1), "
      r"'(?:^|&)(?:utm_[a-z]+|gclid|fbclid|ref)=[^&]*', '', 'g'), '^&', '')")
#: DuckDB: rules by join, classes by a recursive walk. For tables whose pages state no links; with links only aliases by name are told.
SQL = rf"""
with rules(verdict, host, path) as (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
  ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
u as (select row_number() over () as rid, page_id, coalesce({_H.format(u='url')}, '') as host,
        coalesce({_P.format(u='url')}, '') as path, coalesce({_Q.format(u='url')}, '') as q from pages),
n as (select u.*, {_NODE.format(h='host', p='path', q='q')} as node from u),
fit as (select n.*, r.host || r.path as rule, r.verdict as own from n left join rules r
        on (n.host = r.host or ends_with(n.host, '.' || r.host)) and starts_with(n.path, r.path)
        qualify row_number() over (partition by rid order by length(r.host || r.path) desc) = 1),
said as (select node, bool_or(own = 'allow') as allowed, bool_or(own = 'block') as blocked from fit where node is not null group by node)
select page_id, host, path, rule,
  coalesce(own, case when allowed then 'allow' when blocked then 'block' end, 'allow') as verdict
from fit left join said using (node)
"""
