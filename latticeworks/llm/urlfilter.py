"""URL filters with redirect equivalence.

Rules (host, path prefix) judge a URL by its host and path. Redirect (meta refresh) and canonical-link edges make URLs aliases:
connected components over those edges pass a block on to every URL that no rule names. An allow takes precedence: a URL's own rule
always wins, and a component in which any URL is allowed by a rule passes no block on.

A URL is known by its host and path, which is all that rules look at; as a node of the links its path is rid of `.` and `..`
segments, and an empty one is `/`. A component is judged by its nodes and by the URLs of its pages as they are written.

Links are read from tags, by attribute: what only looks like one in a comment, a script, a style sheet or another attribute's value is
none, and a quoted value may hold `>`. Of an attribute that is given twice the first counts; the entities of &, <, > and quotes are
decoded. Targets are resolved against the page: absolute (a scheme and `://` in front), `//host/..`, `/path` or relative to the page's
folder; a fragment or query alone is the page itself, and other schemes (`mailto:` and the like) are no link.

Defined results: a null url or one without `://` has empty host and path, no rule, no edges and verdict allow; a null html has no
edges; repeated rows are judged alike. Of several refresh or canonical tags of one kind the first counts. Other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .store import Workspace

#: (host, path prefix, verdict); a rule's name is its host and path.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
#: So many rules are part of the expression; a longer list is joined by host and path prefix.
INLINE = 200
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits as a struct (size, rule, verdict), or null. Of equally long ones allow wins over block."""
    fits = [F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("size"), F.lit(v == "allow").alias("allow"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in rules]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<size:int,allow:boolean,rule:string,verdict:string>")


#: What is no markup, a tag's attributes up to its end, and one attribute as name and value. Possessive, so that long tags need no stack.
HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script|\z)|<style\b.*?(?:</style|\z)"
REST = r"""(?=[\s/>])(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
ATTRIBUTE = r"""[\s/"']([^\s"'<>/=]++)\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++)"""
#: Entities that a target may hold; the ampersand's comes last.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&#38;", "&"), ("&amp;", "&")]


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's first attribute of that name, or null."""
    names = F.transform(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), 1), F.lower)
    raw = F.get(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), 2), F.array_position(names, name).cast("int") - 1)
    return F.when(F.substring(raw, 1, 1).isin('"', "'"), F.substr(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)


def targets(html: Column) -> Column:
    """The raw targets of a page's first canonical link and first meta refresh that have one; null where there is none."""
    shown = F.regexp_replace(html, HIDDEN, " ")
    tags = lambda name: F.regexp_extract_all(shown, F.lit(rf"(?i)<{name}{REST}"), 0)
    canonical = F.transform(F.filter(tags("link"), lambda t: F.array_contains(F.split(F.lower(attribute(t, "rel")), r"\s+"), "canonical")), lambda t: F.trim(attribute(t, "href")))
    refresh = F.filter(tags("meta"), lambda t: F.lower(F.trim(attribute(t, "http-equiv"))) == "refresh")
    refresh = F.transform(refresh, lambda t: F.regexp_extract(attribute(t, "content"), r"""(?i)^\s*[\d.]*\s*[;,]?\s*url\s*=\s*["']?\s*([^"'\s]*)""", 1))
    found = F.array(*(F.get(F.filter(x, lambda t: t != ""), F.lit(0)) for x in (canonical, refresh)))

    def decoded(t: Column) -> Column:
        for entity, char in ENTITIES:
            t = F.replace(t, F.lit(entity), F.lit(char))
        return t

    return F.transform(found, decoded)


def without_dots(path: Column) -> Column:
    """A path rid of `.` and `..` segments; an empty one is `/`."""
    parts = F.split(path, "/")
    kept = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array(F.lit("")), lambda a, x: F.when(x == ".", a).when(x == "..", F.when(F.size(a) > 1, F.slice(a, 1, F.size(a) - 1)).otherwise(a)).otherwise(F.concat(a, F.array(x))))
    open_ = F.element_at(parts, -1).isin(".", "..")
    clean = F.array_join(F.when(open_, F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")
    return F.when(path == "", "/").when(path.rlike(r"/\.\.?(/|$)"), clean).otherwise(path)


def resolved(target: Column, host: Column, path: Column) -> Column:
    """Host and path, as written, of a target seen from a page; null where the target is no link."""
    plain = F.regexp_extract(target, r"^[^?#]*", 0)
    there = F.concat(F.lit("x:"), target)
    folder = F.concat(F.regexp_replace(path, r"[^/]*$", ""), F.when(path.contains("/"), F.lit("")).otherwise(F.lit("/")))
    pair = lambda h, p: F.struct(h.alias("host"), p.alias("path"))
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), pair(host_of(target), path_of(target)))
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(target.startswith("//"), pair(host_of(there), path_of(there)))
        .when(plain == "", pair(host, path))
        .when(plain.startswith("/"), pair(host, plain))
        .otherwise(pair(host, F.concat(folder, plain)))
    )


def with_rule(urls: DataFrame, rules: list[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """urls (host, path and others) with m, the longest rule that fits (see matched). rules: a list, or a table (host, prefix, verdict).

    A long list is hashed by host and prefix: each distinct URL looks up the suffixes of its host with its prefixes of those lengths that
    rules have, so that neither rules nor URLs are compared with each other.
    """
    if isinstance(rules, list):
        if len(rules) <= INLINE:
            return urls.withColumn("m", matched(F.col("host"), F.col("path"), rules))
        rules = urls.sparkSession.createDataFrame(rules, "host string, prefix string, verdict string")
    listed = rules.select(F.col("host").alias("h"), F.col("prefix").alias("p"), (F.col("verdict") == "allow").alias("allow"), "verdict").distinct()
    lengths = [r.n for r in listed.select(F.length("p").alias("n")).distinct().collect()]  # no more than a path has characters
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    looked = urls.select("host", "path").distinct().withColumn("h", F.explode(suffixes)).withColumn("n", F.explode(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("path"))))
    fits = looked.withColumn("p", F.substr("path", F.lit(1), F.col("n"))).join(listed, ["h", "p"])
    best = fits.groupBy("host", "path").agg(F.max(F.struct((F.length("h") + F.length("p")).alias("size"), "allow", F.concat("h", "p").alias("rule"), "verdict")).alias("m"))
    return urls.join(best, ["host", "path"], "left")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of pages (page_id, url, html)."""
    work = Workspace(pages.sparkSession, "urls")
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), F.col("html").cast("string").alias("html"))
    node = lambda host, path: F.concat(F.col(host), without_dots(F.col(path)))
    named = own.where("host <> '' OR path <> ''")
    found = named.select("host", "path", F.explode(F.array_distinct(F.filter(targets(F.col("html")), lambda t: t != ""))).alias("target"))
    found = found.withColumn("t", resolved(F.col("target"), F.col("host"), F.col("path"))).where("t IS NOT NULL").select("host", "path", F.col("t.host").alias("th"), F.col("t.path").alias("tp"))
    links = work.put(found.select(node("host", "path").alias("a"), node("th", "tp").alias("b")).where("a <> b").distinct(), "links")
    groups = work.put(components(links, work), "groups")
    # rules look at nodes, and at every page's URL as it is written
    there = F.regexp_extract("node", r"^[^/]*", 0)
    urls = groups.select("node", there.alias("host"), F.substr(F.col("node"), F.length(there) + 1).alias("path"))
    urls = urls.unionByName(named.select(node("host", "path").alias("node"), "host", "path").distinct()).distinct()
    ruled = with_rule(urls.join(groups, "node"), rules).withColumn("v", F.col("m.verdict"))
    decided = ruled.groupBy("component").agg(F.bool_or(F.col("v") == "allow").alias("allowed"), F.bool_or(F.col("v") == "block").alias("blocked"))
    blocked = work.put(groups.join(decided.where("blocked AND NOT coalesce(allowed, false)"), "component", "left_semi").select("node"), "blocked")
    judged = with_rule(named.select("page_id", "host", "path"), rules).withColumn("node", node("host", "path"))
    judged = judged.join(blocked.withColumn("alias", F.lit(True)), "node", "left")
    judged = judged.select("page_id", "host", "path", F.col("m.rule").alias("rule"), F.coalesce(F.col("m.verdict"), F.when(F.col("alias"), F.lit("block")), F.lit("allow")).alias("verdict"))
    bare = own.where("host = '' AND path = ''").select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    return judged.unionByName(bare)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


_NORM = r"""CASE WHEN {p} = '' THEN '/' WHEN regexp_matches({p}, '/\.\.?(/|$)') THEN array_to_string(list_concat(list_reduce(list_concat([['']], list_transform(string_split({p}, '/')[2:], lambda x: [x])),
    lambda a, b: CASE WHEN b[1] = '.' THEN a WHEN b[1] = '..' THEN CASE WHEN len(a) > 1 THEN a[1:len(a) - 1] ELSE a END ELSE list_concat(a, b) END), CASE WHEN string_split({p}, '/')[-1] IN ('.', '..') THEN [''] ELSE [] END), '/') ELSE {p} END"""
ORACLE = r"""
WITH RECURSIVE u AS (SELECT page_id, html, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
p AS (SELECT *, host || PATH_NORM AS node FROM q),
rules(h, p, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
shown AS (SELECT host, path, node, regexp_replace(html, '(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script|\z)|<style\b.*?(?:</style|\z)', ' ', 'g') AS html FROM p WHERE host <> '' OR path <> ''),
tags AS (SELECT host, path, node, list_filter(regexp_extract_all(html, '(?i)<link[\s/](?:[^>"'']|"[^"]*"|''[^'']*'')*>'), lambda t: list_contains(regexp_split_to_array(lower(ATTR(rel)), '\s+'), 'canonical')) AS link,
                list_filter(regexp_extract_all(html, '(?i)<meta[\s/](?:[^>"'']|"[^"]*"|''[^'']*'')*>'), lambda t: lower(trim(ATTR(http-equiv))) = 'refresh') AS meta FROM shown),
seen AS (SELECT host, path, node, unnest([list_filter(list_transform(link, lambda t: trim(ATTR(href))), lambda x: x <> '')[1],
                list_filter(list_transform(meta, lambda t: regexp_extract(ATTR(content), '(?i)^\s*[\d.]*\s*[;,]?\s*url\s*=\s*["'']?\s*([^"''\s]*)', 1)), lambda x: x <> '')[1]]) AS t FROM tags),
raw AS (SELECT host, path, node, replace(replace(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#34;', '"'), '&#39;', ''''), '&apos;', ''''), '&#38;', '&'), '&amp;', '&') AS t FROM seen),
abs AS (SELECT node, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN substr(t, strpos(t, '://') + 3) WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL WHEN t LIKE '//%' THEN substr(t, 3)
               WHEN regexp_extract(t, '^[^?#]*') = '' THEN host || path WHEN t LIKE '/%' THEN host || regexp_extract(t, '^[^?#]*')
               ELSE host || regexp_replace(path, '[^/]*$', '') || CASE WHEN path LIKE '%/%' THEN '' ELSE '/' END || regexp_extract(t, '^[^?#]*') END AS r FROM raw WHERE t <> ''),
cut AS (SELECT node AS a, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM abs WHERE r IS NOT NULL),
e AS (SELECT DISTINCT a, host || PATH_NORM AS b FROM cut),
s AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
c AS (SELECT a AS n, a AS m FROM s UNION SELECT c.n, s.b FROM c JOIN s ON c.m = s.a),
urls AS (SELECT node, host, path FROM p WHERE host <> '' OR path <> '' UNION SELECT a, regexp_extract(a, '^[^/]*'), substr(a, length(regexp_extract(a, '^[^/]*')) + 1) FROM s),
known AS (SELECT host, path FROM urls UNION SELECT host, path FROM p),
ruled AS (SELECT k.host, k.path, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(r.verdict, length(r.h || r.p)) AS verdict
          FROM known k JOIN rules r ON (k.host = r.h OR ends_with(k.host, '.' || r.h)) AND starts_with(k.path, r.p) GROUP BY k.host, k.path),
alias AS (SELECT c.n FROM c JOIN urls w ON c.m = w.node JOIN ruled r ON r.host = w.host AND r.path = w.path GROUP BY c.n HAVING bool_or(r.verdict = 'block') AND NOT bool_or(r.verdict = 'allow'))
SELECT p.page_id, p.host, p.path, r.rule, coalesce(r.verdict, CASE WHEN a.n IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM p LEFT JOIN ruled r USING (host, path) LEFT JOIN alias a ON a.n = p.node AND (p.host <> '' OR p.path <> '')
""".replace("PATH_NORM", _NORM.replace("{p}", "path"))
_FIND = r"""[\s/"'']([^\s"''<>/=]+)\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)"""
_VALUE = f"regexp_extract_all(t, '{_FIND}', 2)[list_position(list_transform(regexp_extract_all(t, '{_FIND}', 1), lambda n: lower(n)), 'NAME')]"
_BARE = f"regexp_replace({_VALUE}, '^([\"''])(.*)[\"'']$', '\\2', 's')"
for _name in ("rel", "http-equiv", "href", "content"):
    ORACLE = ORACLE.replace(f"ATTR({_name})", _BARE.replace("NAME", _name))
