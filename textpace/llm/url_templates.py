"""URL filtering by path templates, in DataFrame operations only.

A list of rules judges the urls it covers and thereby labels them. For all others a tree
of path templates is grown per host, one segment at a time: numbers, dates and hex strings
become their class at once; among the other branches of a node, those with little support
and those whose mix of blocked, allowed and unlabelled pages does not differ from the
node's are merged into a wildcard, kept apart by what most of their pages are. A template
is rejected when the smoothed share of blocked pages among its labelled ones is high.

Rules for odd input: a null url, or one without ``://``, has empty host and path and no
rule; urls without a path fit no rule, as every rule's path begins with a slash; segments
beyond ``MAX_DEPTH`` count as one tail; repeated rows are judged alike and each count; an
empty table gives an empty result; input columns named like output columns are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from textpace.llm.common import lower_ascii, staged, without

RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
MAX_DEPTH = 8
# Pages that a branch needs to be kept apart, and blocked pages that a rejection needs.
MIN_SUPPORT = 5
# Chance of keeping a branch apart by mere luck.
LUCK = 0.05
# Weight of the overall blocked share in a template's purity, in pages.
PRIOR_PAGES = 4.0
REJECT_AT = 0.9
COUNTS = ("pages", "blocked", "allowed")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def covering_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def segment_class(segment: Column) -> Column:
    """Segments that vary by nature, as their class."""
    return (F.when(segment.rlike(r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$"), F.lit("<date>"))
            .when(segment.rlike(r"^[0-9]+$"), F.lit("<number>"))
            .when(segment.rlike(r"^[0-9]+\.[A-Za-z0-9]+$"), F.regexp_replace(segment, "^[0-9]+", "<number>"))
            .when(segment.rlike(r"^[0-9a-fA-F-]{16,}$"), F.lit("<hex>"))
            .otherwise(segment))


def _sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in COUNTS]


def grow(paths: DataFrame) -> DataFrame:
    """Templates of distinct (host, path) rows with their page, blocked and allowed counts."""
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    short = F.when(F.size(parts) > MAX_DEPTH, F.concat(F.slice(parts, 1, MAX_DEPTH), F.array(F.lit("**")))).otherwise(parts)
    nodes = staged(paths.select("host", "path", *COUNTS, short.alias("parts"), F.lit("").alias("template")), "url-paths")
    depth = nodes.agg(F.coalesce(F.max(F.size("parts")), F.lit(0)).alias("d")).first()["d"]
    for d in range(depth):
        nodes = nodes.withColumn("branch", segment_class(F.get("parts", F.lit(d))))
        kids = nodes.where("branch is not null").groupBy("host", "template", "branch").agg(*_sums())
        node = kids.groupBy("host", "template").agg(
            *[F.sum(c).alias(f"all_{c}") for c in COUNTS], F.count("*").alias("branches"))
        other = F.col("pages") - F.col("blocked") - F.col("allowed")
        all_other = F.col("all_pages") - F.col("all_blocked") - F.col("all_allowed")
        apart = F.greatest(*[F.abs(mine / F.col("pages") - whole / F.col("all_pages")) for mine, whole in (
            (F.col("blocked"), F.col("all_blocked")), (F.col("allowed"), F.col("all_allowed")), (other, all_other))])
        alike = apart <= F.sqrt(F.lit(math.log(2 / LUCK)) / (2 * F.col("pages")))
        mostly = F.when((F.col("blocked") >= F.col("allowed")) & (F.col("blocked") >= other), "blocked") \
            .when(F.col("allowed") >= other, "allowed").otherwise("unlabelled")
        label = F.when((F.col("branches") == 1) | F.col("branch").startswith("<"), F.col("branch")) \
            .when((F.col("pages") < MIN_SUPPORT) | alike, F.concat(F.lit("*"), mostly)) \
            .otherwise(F.col("branch"))
        named = kids.join(node, ["host", "template"]).select("host", "template", "branch", label.alias("label"))
        nodes = staged(nodes.join(named, ["host", "template", "branch"], "left").select(
            "host", "path", *COUNTS, "parts",
            F.when(F.col("label").isNull(), F.col("template"))
            .otherwise(F.concat("template", F.lit("/"), "label")).alias("template")), "url-level")
    return nodes.drop("parts")


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """Add host, path, rule, verdict, template and purity to every row (url)."""
    pages = without(pages, "host", "path", "rule", "verdict", "template", "purity", "_fit")
    host, path = host_and_path(F.col("url"))
    seen = pages.withColumns({"host": host, "path": path}) \
        .withColumn("_fit", covering_rule(F.col("host"), F.col("path"), rules))
    paths = seen.groupBy("host", "path").agg(
        F.count("*").alias("pages"), F.count_if(F.col("_fit.verdict") == "block").alias("blocked"),
        F.count_if(F.col("_fit.verdict") == "allow").alias("allowed"))
    leaves = grow(paths)
    prior = leaves.agg((F.sum("blocked") / F.nullif(F.sum("blocked") + F.sum("allowed"), F.lit(0))).alias("p")).first()["p"] or 0.0
    purity = (F.col("blocked") + PRIOR_PAGES * prior) / (F.col("blocked") + F.col("allowed") + PRIOR_PAGES)
    templates = leaves.groupBy("host", "template").agg(*_sums()).select(
        "host", "template", purity.alias("purity"),
        ((purity >= REJECT_AT) & (F.col("blocked") >= MIN_SUPPORT)).alias("_reject"))
    by_path = leaves.select("host", "path", "template").join(templates, ["host", "template"])
    kept = [F.col(c) for c in pages.columns]
    return seen.join(by_path, ["host", "path"]).select(
        *kept, "host", "path", F.col("_fit.rule").alias("rule"),
        F.coalesce(F.col("_fit.verdict"), F.when(F.col("_reject"), "block").otherwise("allow")).alias("verdict"),
        "template", "purity")
