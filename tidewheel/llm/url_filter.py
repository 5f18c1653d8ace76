"""URL filter: explicit rules first, then a path-template tree with smoothed labelled purity.

Paths become segments; segments that look like identifiers are wildcards at once. Level by
level and host by host, a segment also becomes a wildcard when its labelled purity does not differ from
that of all its siblings (two-proportion z test), which merges statistically similar branches, rare ones and those
without labels included. A branch goes on as deep as its paths, and ends early (``/**``) where no further level can
tell its pages apart: without labels, or with labels all of one kind. A template is rejected when its purity (share of allowed
among labelled pages, smoothed toward its host, the host toward its parent domain, that toward all
pages) is below one half.

All statistics are aggregated map-side over distinct (host, shape); pages join back once.

Defined results: a null URL, or one without ``://``, has empty host and path, and is judged as the
template of the empty host; repeated rows each give a row; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Labelled pages that a parent's purity counts for, and the z value of a difference.
PRIOR, DIFFERENT = 4.0, 2.58


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))


def longest_rule(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null."""
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fit = fits(rule, host, path)
        name, verdict = F.when(fit, F.lit(rule.name)).otherwise(name), F.when(fit, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def path_shape(path: Column) -> Column:
    """The path's segments as one string, identifiers as ``*``."""
    parts = F.split(F.regexp_replace(path, r"^/+|/+$", ""), "/+")
    return F.array_join(F.transform(parts, lambda s: F.when(F.rlike(s, F.lit(r"^(\d+|[0-9a-fA-F-]{8,}|[^/]*\d{4,}[^/]*)(\.[A-Za-z]{1,5})?$")), F.lit("*")).otherwise(s)), "/")


def _purity(allowed: Column, labelled: Column, prior: Column) -> Column:
    return (allowed + PRIOR * prior) / (labelled + PRIOR)


def learn_templates(shapes: DataFrame) -> DataFrame:
    """(host, shape, template, purity) of shapes (host, shape, pages, allowed, labelled)."""
    now = shapes.withColumn("segments", F.split("shape", "/")).withColumn("template", F.lit(""))
    total = shapes.agg((F.sum("allowed") / F.nullif(F.sum("labelled"), F.lit(0))).alias("p")).first()[0]
    total = 0.5 if total is None else float(total)
    done, level = None, 0
    while True:
        here = now.withColumn("s", F.coalesce(F.get("segments", F.lit(level)), F.lit("")))
        child = here.groupBy("host", "template", "s").agg(F.sum("allowed").alias("a"), F.sum("labelled").alias("l"))
        parent = child.groupBy("host", "template").agg(F.count(F.lit(1)).alias("children"), F.sum("a").alias("all_a"), F.sum("l").alias("all_l"))
        rest = F.col("all_l") - F.col("l")
        pooled = F.col("all_a") / F.nullif(F.col("all_l"), F.lit(0))
        spread = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), F.col("l")) + F.try_divide(F.lit(1.0), rest)))
        z = F.try_divide(F.abs(F.try_divide(F.col("a"), F.col("l")) - F.try_divide(F.col("all_a") - F.col("a"), rest)), spread)
        similar = (F.col("children") > 1) & ~F.coalesce(z >= DIFFERENT, F.lit(False))
        mixed = (F.col("all_a") > 0) & (F.col("all_a") < F.col("all_l"))
        step = F.when(F.col("s") == "", F.lit("")).when(~mixed, F.lit("/**")).when(similar, F.lit("/*")).otherwise(F.concat(F.lit("/"), "s"))
        names = child.join(parent, ["host", "template"]).select("host", "template", "s", step.alias("step"))
        now = here.join(names, ["host", "template", "s"]).select("host", "shape", "pages", "allowed", "labelled", "segments", F.concat("template", "step").alias("template"), ((F.col("step") == "/**") | (F.size("segments") <= level + 1)).alias("ends"))
        now = materialise(now, "tree")
        ended = now.filter("ends").drop("segments", "ends")
        done = ended if done is None else done.unionByName(ended)
        now, level = now.filter("not ends").drop("ends"), level + 1
        if now.isEmpty():
            break
    now = done
    domain = F.regexp_extract("host", r"([^.]*\.[^.]*)$", 1)
    domains = now.groupBy(domain.alias("domain")).agg(_purity(F.sum("allowed"), F.sum("labelled"), F.lit(total)).alias("p_domain"))
    hosts = now.groupBy("host").agg(F.sum("allowed").alias("a"), F.sum("labelled").alias("l")).withColumn("domain", domain).join(domains, "domain").select("host", _purity(F.col("a"), F.col("l"), F.col("p_domain")).alias("p_host"))
    templates = now.groupBy("host", "template").agg(F.sum("allowed").alias("a"), F.sum("labelled").alias("l")).join(hosts, "host").select("host", "template", _purity(F.col("a"), F.col("l"), F.col("p_host")).alias("purity"))
    return now.select("host", "shape", "template").join(templates, ["host", "template"])


def judge(pages: DataFrame, rules: list[Rule], least_purity: float = 0.5, labels: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) for every row of ``pages`` (page_id, url).

    Labelled pages are those that a rule decides, or those of ``labels`` (page_id, allowed boolean).
    """
    host, path = split_url(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = longest_rule(rules, F.col("host"), F.col("path"))
    ruled = parts.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), path_shape(F.col("path")).alias("shape"))
    if labels is None:
        marked = ruled.withColumn("label", F.col("ruled") == "allow")
    else:
        marked = ruled.join(labels.select("page_id", F.col("allowed").alias("label")).dropDuplicates(["page_id"]), "page_id", "left")
    shapes = marked.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("pages"), F.count_if("label").alias("allowed"), F.count("label").alias("labelled"))
    learned = learn_templates(materialise(shapes, "shapes"))
    own = F.when(F.col("purity") >= least_purity, F.lit("allow")).otherwise(F.lit("block"))
    return ruled.join(learned, ["host", "shape"], "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "template", "purity")
