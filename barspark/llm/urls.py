"""URL filters with redirect equivalence, in DataFrame functions only.

Rules name a host, all its subdomains and a path prefix; the longest rule that fits decides. A page
without a rule takes the decision of its aliases: pages that are joined by canonical links or
redirects (``<link rel=canonical>``, ``<meta http-equiv=refresh>``) are one resource, found as
connected components, and a block of any of them holds for all that no rule allows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from barspark.llm.frames import components, stored


class Rule(NamedTuple):
    """``action`` is allow or block; ``text`` is host and path, as in ``example.org/en/``."""

    action: str
    text: str

    @property
    def host(self) -> str:
        return self.text.split("/", 1)[0]

    @property
    def path(self) -> str:
        return self.text[len(self.host):]


#: Rules that one expression holds; each is tested on each row.
MAX_RULES = 1000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule], what: str = "text") -> Column:
    """The longest rule that fits (or its action), else null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    fits = [F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.lit(getattr(r, what)))
            for r in sorted(rules, key=lambda r: (-len(r.text), r.text))]
    return F.coalesce(*fits, F.lit(None).cast("string"))


def resource(url: Column) -> Column:
    """A resource's name: host, path and query; scheme and fragment do not count."""
    return F.concat(host_of(url), F.when(path_of(url) == "", "/").otherwise(path_of(url)), F.regexp_extract(_after_scheme(url), r"^[^?#]*(\?[^#]*)?", 1))


def _resolved(target: Column, url: Column) -> Column:
    """A link's absolute address: with scheme, ``//host...`` or ``/path``; null for others."""
    return (F.when(target.rlike(r"^(?i:https?)://"), target)
            .when(target.startswith("//"), F.concat(F.lit("http:"), target))
            .when(target.startswith("/") & (host_of(url) != ""), F.concat(F.lit("http://"), host_of(url), target)))


def links(pages: DataFrame) -> DataFrame:
    """``url, target``: canonical links and refresh redirects that the html states."""
    html = F.col("html")
    tag = lambda name: F.regexp_extract_all(html, F.lit(rf"(?is)<{name}\b[^>]*>"), F.lit(0))
    canonical = F.transform(F.filter(tag("link"), lambda x: x.rlike(r"(?is)\brel\s*=\s*[\"']?\s*canonical\b")),
                            lambda x: F.regexp_extract(x, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1))
    refresh = F.transform(F.filter(tag("meta"), lambda x: x.rlike(r"(?is)\bhttp-equiv\s*=\s*[\"']?\s*refresh\b")),
                          lambda x: F.regexp_extract(x, r"(?is)\burl\s*=\s*[\"']?([^\"'\s>;]+)", 1))
    found = pages.where(F.col("url").isNotNull() & html.rlike(r"(?i)canonical|refresh")).select("url", F.explode(F.concat(canonical, refresh)).alias("target"))
    return found.select("url", _resolved(F.col("target"), F.col("url")).alias("target")).where("target is not null")


def url_verdicts(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every page.

    The verdict is the rule's action. Without a rule it is block if the page's component holds a page or a
    link target that a rule blocks, and allow otherwise, so an allowed member keeps its allowance
    and frees no other. Null urls and urls without ``://`` have empty host and path, fit no rule and
    are allowed. Null html states no links; repeated rows each give a row.
    """
    stated = stored(links(pages.select("url", "html")), "links")
    edge = stated.select(F.xxhash64(resource(F.col("url"))).alias("a"), F.xxhash64(resource(F.col("target"))).alias("b"))
    nodes = stated.select(F.explode(F.array("url", "target")).alias("url")).select(
        F.xxhash64(resource(F.col("url"))).alias("node"), rule_of(host_of(F.col("url")), path_of(F.col("url")), rules, "action").alias("action"))
    member = components(edge)
    blocked = nodes.where("action = 'block'").select("node").distinct().join(member, "node").select("root").distinct()
    reached = member.join(blocked, "root", "left_semi").select(F.col("node").alias("__op_node"), F.lit("block").alias("__op_alias"))
    own = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
                       F.when(F.col("url").isNotNull(), F.xxhash64(resource(F.col("url")))).alias("__op_node"))
    ruled = own.withColumns({"rule": rule_of(F.col("host"), F.col("path"), rules), "__op_action": rule_of(F.col("host"), F.col("path"), rules, "action")})
    return ruled.join(reached, "__op_node", "left").select("page_id", "host", "path", "rule", F.coalesce("__op_action", "__op_alias", F.lit("allow")).alias("verdict"))


def oracle(rules: list[Rule]) -> str:
    """DuckDB SQL for ``url_verdicts`` over ``pages``."""
    rest = "CASE WHEN strpos({u}, '://') > 0 THEN substr({u}, strpos({u}, '://') + 3) ELSE '' END"
    host = lambda u: f"coalesce(translate(regexp_extract({rest.format(u=u)}, '^[^/?#]*'), '{_UPPER}', '{_LOWER}'), '')"
    path = lambda u: f"coalesce(regexp_extract({rest.format(u=u)}, '^[^/?#]*([^?#]*)', 1), '')"
    key = lambda u: f"{host(u)} || CASE WHEN {path(u)} = '' THEN '/' ELSE {path(u)} END || coalesce(regexp_extract({rest.format(u=u)}, '^[^?#]*(\\?[^#]*)?', 1), '')"
    case = lambda what: "CASE " + " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{getattr(r, what)}'" for r in sorted(rules, key=lambda r: (-len(r.text), r.text))) + " END"
    return f"""
WITH RECURSIVE tags AS (
  SELECT url, unnest(list_concat(regexp_extract_all(html, '(?is)<link\\b[^>]*>'), regexp_extract_all(html, '(?is)<meta\\b[^>]*>'))) AS tag FROM pages WHERE url IS NOT NULL),
stated AS (
  SELECT url, regexp_extract(tag, '(?is)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1) AS target FROM tags WHERE regexp_matches(tag, '(?is)^<link') AND regexp_matches(tag, '(?is)\\brel\\s*=\\s*["'']?\\s*canonical\\b')
  UNION ALL
  SELECT url, regexp_extract(tag, '(?is)\\burl\\s*=\\s*["'']?([^"''\\s>;]+)', 1) FROM tags WHERE regexp_matches(tag, '(?is)^<meta') AND regexp_matches(tag, '(?is)\\bhttp-equiv\\s*=\\s*["'']?\\s*refresh\\b')),
resolved AS (
  SELECT url, CASE WHEN regexp_matches(target, '(?i)^https?://') THEN target WHEN starts_with(target, '//') THEN 'http:' || target
    WHEN starts_with(target, '/') AND {host('url')} <> '' THEN 'http://' || {host('url')} || target END AS target FROM stated),
edges AS (SELECT {key('url')} AS a, {key('target')} AS b FROM resolved WHERE target IS NOT NULL),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
addresses AS (SELECT url FROM resolved WHERE target IS NOT NULL UNION SELECT target FROM resolved WHERE target IS NOT NULL),
nodes AS (SELECT {key('url')} AS node, {host('url')} AS host, {path('url')} AS path FROM addresses),
hit(node) AS (SELECT node FROM nodes WHERE {case('action')} = 'block' UNION SELECT b FROM hit JOIN both_ways ON a = node),
own AS (SELECT page_id, {host('url')} AS host, {path('url')} AS path, CASE WHEN url IS NOT NULL THEN {key('url')} END AS node FROM pages)
SELECT page_id, host, path, {case('text')} AS rule,
  coalesce({case('action')}, CASE WHEN node IN (SELECT node FROM hit) THEN 'block' END, 'allow') AS verdict FROM own"""
