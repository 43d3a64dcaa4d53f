"""URL rules that also hold for redirects and canonical aliases.

A rule fits a host with its subdomains and a path prefix; the longest rule wins. Pages without a rule follow their
aliases: redirect targets (meta refresh) and canonical links are edges between addresses, and the connected
components of those edges are alias classes. A class with a page that a rule allows is allowed, since explicit allows
take precedence; else a class with a blocked page is blocked; all others are allowed.

Defined cases: a null url or one without "://" has an empty host and path, fits no rule, and is allowed unless its
text itself is an alias; links without a target, in comments or scripts, and to the page itself make no difference;
repeated urls are one node; a null html has no links.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.llm.common import kept_once, pick
from driftwell.llm.components import components

RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(verdict, rule) of the longest rule that fits, else null. Of equally long ones the first counts."""
    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    best = None
    for verdict, domain, prefix in longest:
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(prefix)
        found = F.struct(F.lit(verdict).alias("verdict"), F.lit(domain + prefix).alias("rule"))
        best = F.when(fits, found) if best is None else best.when(fits, found)
    return best if best is not None else F.lit(None).cast("struct<verdict:string,rule:string>")


def address(url: Column) -> Column:
    """The form in which addresses are compared: host in lower case, no fragment, no empty path."""
    tail = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    scheme = lower_ascii(F.regexp_extract(url, r"(?s)^(.*?)://", 1))
    tail = F.when(tail.startswith("/"), tail).otherwise(F.concat(F.lit("/"), tail))
    return F.when(F.instr(url, "://") > 0, F.concat(scheme, F.lit("://"), host_of(url), tail)).otherwise(url)


def resolved(link: Column, base: Column) -> Column:
    """A link's address as seen from a page: absolute, //host, /path, ?query or relative to the page's folder."""
    link = F.regexp_replace(F.trim(link), "&amp;", "&")
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    site = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    page = F.regexp_extract(base, r"(?s)^([^?#]*)", 1)
    folder = F.when(F.length(path_of(base)) == 0, F.concat(site, F.lit("/"))).otherwise(F.regexp_extract(base, r"(?s)^([^?#]*/)", 1))
    return (
        F.when((F.length(link) == 0) | link.startswith("#"), None)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(site, link))
        .when(link.startswith("?"), F.concat(page, link))
        .otherwise(F.concat(folder, link))
    )


def alias_links(pages: DataFrame) -> DataFrame:
    """(a, b): addresses that a canonical link or a redirect declares to be one page."""
    pages = pick(pages, "url", "html").filter("url is not null")
    # Only pages that mention either word are searched further.
    named = pages.filter(F.col("html").rlike(r"(?i)canonical|http-equiv"))
    head = F.regexp_replace("html", r"(?is)<!--.*?-->|<script\b.*?</script>", "")
    tags = named.select("url", F.explode(F.regexp_extract_all(head, F.lit(r"(?is)(<(?:link|meta)\b[^>]*>)"), F.lit(1))).alias("tag"))
    canonical = F.col("tag").rlike(r"(?is)^<link\b(?=[^>]*\brel\s*=\s*[\"']?[^\"'>]*\bcanonical\b)")
    refresh = F.col("tag").rlike(r"(?is)^<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?\s*refresh\b)")
    href = F.regexp_extract("tag", r"(?is)\shref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", 0)
    target = F.regexp_extract("tag", r"(?is)\burl\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\"'>]+))", 0)
    bare = lambda found: F.trim(F.regexp_replace(found, r"(?is)^[^=]*=\s*[\"']?|[\"']$", ""))
    link = F.when(canonical, bare(href)).when(refresh, bare(target))
    links = tags.select("url", link.alias("link")).filter("link is not null and link != ''")
    # Step by step, as each step uses the one before several times.
    ends = links.withColumn("target", resolved(F.col("link"), F.col("url"))).filter("target is not null")
    return ends.select(address(F.col("url")).alias("a"), address(F.col("target")).alias("b"))


def judged(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Per input row: page_id, host, path, rule, verdict, alias (the class's smallest address, null without links)."""
    rows = pick(pages, "page_id", "url").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rows = rows.withColumn("found", rule_for(F.col("host"), F.col("path"), rules))
    rows = rows.select("page_id", "host", "path", "found", address(F.col("url")).alias("address"))
    links = kept_once(alias_links(pages))
    if links.isEmpty():
        rows = rows.withColumn("alias", F.lit(None).cast("string")).withColumn("class_verdict", F.lit(None).cast("string"))
    else:
        classes = kept_once(components(links, "a", "b"))
        # Every address of a class is judged, also those that are named by links only.
        own = rule_for(host_of(F.col("node")), path_of(F.col("node")), rules)
        verdicts = classes.withColumn("own", own).groupBy("root").agg(
            F.bool_or(F.col("own.verdict") == "allow").alias("allows"), F.bool_or(F.col("own.verdict") == "block").alias("blocks"))
        verdicts = verdicts.select(F.col("root").alias("alias"), F.when(F.col("allows"), "allow").when(F.col("blocks"), "block").alias("class_verdict"))
        known = classes.join(verdicts, F.col("root") == F.col("alias")).select("node", "alias", "class_verdict")
        rows = rows.join(known, F.col("address") == F.col("node"), "left")
    verdict = F.coalesce("found.verdict", "class_verdict", F.lit("allow"))
    return rows.select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), "alias")


def op6_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return judged(spark.read.parquet(f"{folder}/pages.parquet"))


_FITS = "(host = '{d}' OR host LIKE '%.{d}') AND starts_with(path, '{p}')"
_LONGEST = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
_RULE = "CASE " + " ".join(f"WHEN {_FITS.format(d=d, p=p)} THEN '{d}{p}'" for _, d, p in _LONGEST) + " END"
_OWN = "CASE " + " ".join(f"WHEN {_FITS.format(d=d, p=p)} THEN '{v}'" for v, d, p in _LONGEST) + " END"
_PARTS = """coalesce(translate(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract({u}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path"""

# The links are read in their plainest form: a canonical link with an absolute address in double quotes.
SQL = f"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html, regexp_replace(url, '#.*$', '', 's') AS addr, {_PARTS.format(u='url')} FROM pages
), links AS (
  SELECT addr AS a, regexp_replace(unnest(regexp_extract_all(html, '<link rel="canonical" href="([^"]*://[^"]*)"', 1)), '#.*$', '', 's') AS b
  FROM p WHERE addr IS NOT NULL
), edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(n, m) AS (SELECT a, a FROM edges UNION SELECT r.n, e.b FROM reach r JOIN edges e ON r.m = e.a),
members AS (SELECT n, m, {_PARTS.format(u='m')} FROM reach),
classes AS (
  SELECT n, min(m) AS alias, CASE WHEN bool_or({_OWN} = 'allow') THEN 'allow' WHEN bool_or({_OWN} = 'block') THEN 'block' END AS verdict
  FROM members GROUP BY n
)
SELECT page_id, host, path, {_RULE} AS rule, coalesce({_OWN}, c.verdict, 'allow') AS verdict, c.alias
FROM p LEFT JOIN classes c ON p.addr = c.n
"""
