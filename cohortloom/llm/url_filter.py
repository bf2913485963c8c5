"""URL rules whose block decisions follow redirects and canonical links.

A rule is ``host/path`` with an action. It fits its host and all subdomains where the URL's path
starts with the rule's path; the longest rule wins, an allow rule among equally long ones. Pages that
redirect to each other or name each other as canonical, over any number of steps, are aliases. A page
that no rule fits is blocked if some alias is blocked by a rule and none is allowed by one; an own
rule, above all an explicit allow, always stands. Everything else is allowed.

Rules are found by equality: each URL looks up its host suffixes and path directories, no deeper than
any rule goes, so neither table is compared with all of the other. Aliases are connected components.

Defined cases: a null URL, or one without ``://``, has an empty host and path, fits no rule and has no
aliases by its address. Null html has no links. Rows are judged one by one, also where they repeat.
Only the named columns are read. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm.graph import components, stage
from cohortloom.llm.quality import let

PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)([^#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def address(url: Column) -> Column:
    """What aliases are told by: host, path and query, without scheme and fragment; null without a host."""
    path = path_of(url)
    whole = F.concat(host_of(url), F.when(path == "", "/").otherwise(path), F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 3))
    return F.when(host_of(url) != "", whole)


def _attribute(tag: Column, name: str) -> Column:
    value = F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    return F.regexp_replace(F.regexp_replace(value, r"""^["']|["']$""", ""), "&amp;", "&")


def links(html: Column) -> Column:
    """Canonical links and refresh targets of a page, as they are written."""
    shown = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<!--.*?-->|<(script|style|textarea)\b.*?</\1\s*>", " ")
    canonical = F.filter(F.regexp_extract_all(shown, F.lit(r"(?is)<link\b[^>]*>"), 0), lambda t: F.lower(_attribute(t, "rel")).rlike(r"(^|\s)canonical(\s|$)"))
    refresh = F.filter(F.regexp_extract_all(shown, F.lit(r"(?is)<meta\b[^>]*>"), 0), lambda t: F.lower(_attribute(t, "http-equiv")) == "refresh")
    target = lambda t: F.regexp_extract(_attribute(t, "content"), r"""(?is)^[\s\d.]*[;,]\s*url\s*=\s*['"]?([^'"]*)""", 1)
    found = F.concat(F.transform(canonical, lambda t: _attribute(t, "href")), F.transform(refresh, target))
    found = F.filter(F.transform(found, lambda u: F.trim(u)), lambda u: u != "")
    return F.when(F.lower("html").rlike("canonical|refresh"), found).otherwise(F.array().cast("array<string>"))


def resolve(link: Column, url: Column) -> Column:
    """A link as an absolute URL, seen from ``url``."""
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    root = F.concat(scheme, F.lit("://"), host_of(url))
    folder = F.regexp_extract(path_of(url), r"(?s)^(.*/)", 1)
    return (
        F.when(link.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("?"), F.concat(root, path_of(url), link))
        .when(link.startswith("#"), url)
        .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), link))
    )


def fitting(places: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, action) of the distinct ``places`` (host, path) that some rule fits."""
    cut = rules.select(
        "rule", "action", F.regexp_extract("rule", "(?s)^([^/]*)", 1).alias("rule_host"), F.regexp_extract("rule", "(?s)^[^/]*(.*)$", 1).alias("rule_path"),
    ).withColumn("folder", F.regexp_extract("rule_path", "(?s)^(.*/)", 1))
    deepest = cut.agg(F.max(F.size(F.split("rule_host", r"\."))).alias("labels"), F.max(F.size(F.split("folder", "/"))).alias("parts")).first()
    labels, parts = deepest["labels"] or 0, deepest["parts"] or 0

    def suffixes(names: Column) -> Column:
        n = F.size(names)
        return F.transform(F.sequence(F.lit(1), F.least(n, F.lit(max(labels, 1)))), lambda k: F.array_join(F.slice(names, n - k + 1, k), "."))

    def folders(names: Column) -> Column:
        count = F.least(F.size(names) - 1, F.lit(max(parts, 1)))
        deeper = F.transform(F.sequence(F.lit(1), count), lambda k: F.concat(F.array_join(F.slice(names, F.lit(1), k), "/"), F.lit("/")))
        return F.concat(F.array(F.lit("")), F.when(count >= 1, deeper).otherwise(F.array().cast("array<string>")))

    keys = places.where("host <> ''").distinct().select("host", "path", F.explode(let(F.split("host", r"\."), suffixes)).alias("rule_host"))
    keys = keys.select("*", F.explode(let(F.split("path", "/"), folders)).alias("folder"))
    fits = keys.join(cut, ["rule_host", "folder"]).where(F.col("path").startswith(F.col("rule_path")))
    # "allow" sorts before "block": the largest is the longest, then allow, then the first rule by name.
    order = F.struct(F.length("rule"), F.col("action") == "allow", F.col("rule"))
    return fits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "action"), order).alias("best")).select("host", "path", "best.rule", "best.action")


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row. ``redirects`` has (source, target) URLs seen elsewhere."""
    url = F.col(url_col).cast("string")
    told = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), address(url).alias("node"))
    edges = pages.sparkSession.createDataFrame([], "a string, b string")
    if html_col:
        seen = pages.select(url.alias("url"), F.col(html_col).cast("string").alias("html"))
        named = seen.select("url", F.explode(links(F.col("html"))).alias("link")).select("url", resolve(F.col("link"), F.col("url")).alias("to"))
        edges = edges.unionByName(named.select(address(F.col("url")).alias("a"), address(F.col("to")).alias("b")))
    if redirects is not None:
        edges = edges.unionByName(redirects.select(address(F.col("source")).alias("a"), address(F.col("target")).alias("b")))
    edges = stage(edges.where("a is not null and b is not null and a <> b").distinct())
    member = components(edges)
    # Every node is its own URL, so its place can be read from it.
    there = F.concat(F.lit("x://"), F.col("node"))
    placed = member.select("node", "component", host_of(there).alias("host"), path_of(there).alias("path"))
    best = stage(fitting(told.select("host", "path").unionByName(placed.select("host", "path")), rules))
    ruled = placed.join(best, ["host", "path"])
    decided = ruled.groupBy("component").agg(F.max(F.col("action") == "allow").alias("some_allow"), F.max(F.col("action") == "block").alias("some_block"))
    blocked = member.join(decided.where("some_block and not some_allow"), "component").select("node", F.lit("block").alias("passed_on"))
    out = told.join(best, ["host", "path"], "left").join(blocked, "node", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("action", "passed_on", F.lit("allow")).alias("verdict"))


def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.createDataFrame(RULES, "rule string, action string"))
