"""URL filter: explicit rules first, then path templates judged by the labels of the urls that they cover.

Level by level, a host's paths grow a template tree. Below a node, segments of text that repeat stay literal; the others,
digits and hexadecimal become the wildcard of their shape. Templates of a
host that differ in literal segments only, and whose label shares do not differ more than chance would have it, are
merged into one with a wildcard there. A template's purity is its share of good labels, smoothed towards its host's,
which is smoothed towards the share of all; templates below the threshold are rejected.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from schemahelm.llm.common import stash

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``allow`` or ``block`` for a domain with all its subdomains, and a prefix of the path."""

    action: str
    domain: str
    prefix: str

    @property
    def text(self) -> str:
        return self.domain + self.prefix


#: Fixed values of the query.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


@dataclass(frozen=True)
class TreePlan:
    repeats: float = 4.0  # urls of a literal segment at a node, at least, for it to stay
    z: float = 2.0  # standard errors that branches may differ by and still be merged
    weight: float = 8.0  # labels that the prior share weighs as much as
    threshold: float = 0.5  # least purity


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty if it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(text, action) of the longest rule that fits, null where none does; equally long ones in order of their text."""
    texts, actions = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text), reverse=True):
        fits = ((host == r.domain) | host.endswith("." + r.domain)) & path.startswith(r.prefix)
        texts, actions = F.when(fits, r.text).otherwise(texts), F.when(fits, r.action).otherwise(actions)
    return texts, actions


def _shape(segment: Column) -> Column:
    return (
        F.when(segment.rlike(r"^[0-9]+$"), "{number}")
        .when(segment.rlike(r"^[0-9]+\.[A-Za-z0-9]{1,5}$"), "{number.ext}")
        .when(segment.rlike(r"^(?=.*[0-9])[0-9A-Fa-f-]{8,}$"), "{hex}")
        .otherwise("{text}")
    )


def path_templates(paths: DataFrame, plan: TreePlan) -> DataFrame:
    """(host, path, n) with distinct paths -> the same plus ``template``.

    All levels are keyed by (host, template so far) and counts are pre-aggregated. Each {text} segment is judged by its own urls,
    however many there are at a node: with ``plan.repeats`` it stays, else it becomes the wildcard. Levels go on while a node
    has segments left and urls enough for one to stay; below all others every segment has its shape.
    """
    segments = F.split(F.regexp_replace("path", r"^/", ""), "/")
    open_ = paths.select("host", "path", "n", segments.alias("segments"), F.lit("").alias("template"))
    done, level = [], 0
    while level == 0 or not open_.isEmpty():
        here = F.get(F.col("segments"), F.lit(level))
        grown = open_.withColumn("here", here).withColumn("shape", _shape(here))
        literals = grown.where("shape = '{text}'").groupBy("host", "template", "here").agg(F.sum("n").alias("urls"))
        stay = literals.where(F.col("urls") >= plan.repeats).select("host", "template", "here", F.lit(True).alias("stays"))
        grown = grown.join(stay, ["host", "template", "here"], "left")
        step = F.concat(F.lit("/"), F.when(F.col("stays"), F.col("here")).otherwise(F.col("shape")))
        grown = stash(grown.select("host", "path", "n", "segments", F.concat("template", step).alias("template")), "tree")
        level += 1
        longer = F.size("segments") > level
        crowded = grown.where(longer).groupBy("host", "template").agg(F.sum("n").alias("urls")).where(F.col("urls") >= plan.repeats)
        key = ["host", "template"]
        rest = F.transform(F.slice("segments", level + 1, F.greatest(F.size("segments") - level, F.lit(0))), lambda s: F.concat(F.lit("/"), _shape(s)))
        few = grown.where(longer).join(crowded.select(*key), key, "left_anti").unionByName(grown.where(~longer))
        done.append(few.select("host", "path", "n", F.concat("template", F.array_join(rest, "")).alias("template")))
        open_ = grown.where(longer).join(crowded.select(*key), key, "left_semi").select(grown.columns)
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def template_purity(urls: DataFrame, plan: TreePlan) -> DataFrame:
    """(host, template, good: 1, 0 or null) -> host, template, merged, urls, labelled, purity, rejected; a row for each template.

    Literal segments of a template give its outline when they are replaced by a wildcard; templates of a host with one
    outline are merged into it unless their share of good labels is too far from that of all of them.
    """
    counts = urls.groupBy("host", "template").agg(
        F.count("*").alias("urls"), F.count("good").alias("labelled"), F.coalesce(F.sum("good"), F.lit(0)).alias("good")
    )
    outline = F.regexp_replace("template", r"/(?!\{)[^/]+", "/{*}")
    counts = counts.withColumn("outline", outline)
    pooled = counts.groupBy("host", "outline").agg(F.sum("labelled").alias("all_labelled"), F.sum("good").alias("all_good"))
    seen = counts.join(pooled, ["host", "outline"])
    share = F.when(F.col("all_labelled") > 0, F.col("all_good") / F.col("all_labelled")).otherwise(F.lit(0.5))
    error = F.sqrt(F.greatest(share * (1 - share), F.lit(0.01)) / F.greatest("labelled", F.lit(1)))
    alike = (F.col("labelled") == 0) | (F.abs(F.col("good") / F.greatest("labelled", F.lit(1)) - share) <= plan.z * error)
    seen = seen.withColumn("merged", F.when(alike, F.col("outline")).otherwise(F.col("template")))
    merged = seen.groupBy("host", "merged").agg(F.sum("urls").alias("urls"), F.sum("labelled").alias("labelled"), F.sum("good").alias("good"))
    hosts = counts.groupBy("host").agg(F.sum("labelled").alias("h_labelled"), F.sum("good").alias("h_good"))
    total = hosts.agg(F.sum("h_labelled").alias("n"), F.sum("h_good").alias("g")).first()
    prior = (total["g"] + 1) / (total["n"] + 2) if total["n"] is not None else 0.5
    host_share = (F.col("h_good") + plan.weight * prior) / (F.col("h_labelled") + plan.weight)
    purity = (F.col("good") + plan.weight * host_share) / (F.col("labelled") + plan.weight)
    judged = merged.join(hosts, "host").select("host", "merged", "urls", "labelled", purity.alias("purity"), (purity < plan.threshold).alias("rejected"))
    return seen.select("host", "template", "merged").join(judged, ["host", "merged"])


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[Rule] = RULES, plan: TreePlan = TreePlan()) -> DataFrame:
    """(page_id, url) and labels (page_id, good: 0 or 1) -> page_id, host, path, rule, verdict, template; a row for each page.

    The verdict is the longest fitting rule's, else ``block`` for a rejected template and ``allow`` for any other. Null urls and
    such without ``://`` have an empty host and path and belong to one template; a page of several labels takes their
    mean; null labels are none; repeated rows and null ids are kept as they are. Without labels nothing is rejected (purity 0.5).
    """
    host, path = split_url(F.col("url"))
    seen = stash(pages.select("page_id", host.alias("host"), path.alias("path")), "urls")
    paths = seen.groupBy("host", "path").agg(F.count("*").alias("n"))
    templates = stash(path_templates(paths, plan).select("host", "path", "template"), "templates")
    placed = stash(seen.join(templates, ["host", "path"]), "placed")
    marks = labels.dropna().groupBy("page_id").agg(F.avg("good").alias("good"))
    purity = template_purity(placed.join(marks, "page_id", "left").select("host", "template", "good"), plan)
    text, action = matching_rule(F.col("host"), F.col("path"), rules)
    judged = placed.join(purity.select("host", "template", "rejected"), ["host", "template"], "left")
    other = F.when(F.col("rejected"), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", text.alias("rule"), F.coalesce(action, other).alias("verdict"), "template")


def document_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels of pages whose path ends in the number of a labelled document: page_id, good (its quality)."""
    _, path = split_url(F.col("url"))
    number = F.regexp_extract(path, r"/([0-9]{1,18})(?:\.[A-Za-z0-9]+)?/?$", 1)
    numbered = pages.select("page_id", F.when(number != "", number.cast("bigint")).alias("doc_id")).dropna()
    marks = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.avg("quality").alias("good"))
    return numbered.join(marks, "doc_id").select("page_id", "good")
