"""URL filter by a tree of path templates.

The paths of a host are a tree of segments. Level by level, segments that vary (numbers, ids, rare
ones) become a wildcard, and branches whose labels do not differ statistically from their parent's
are merged into it. A leaf of the reduced tree is a template; a template is rejected when its
smoothed purity, the share of good among its labelled pages, is too low. Fixed rules come first.
Built from column expressions alone.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinframe.llm.shared import stash

WILDCARD = "*"
#: Levels grown in any case; deeper ones only where labels of both kinds are left, which could be split.
PLAIN_LEVELS = 4
#: A branch stands for itself if its labels would come about among its siblings' by chance with less than
#: this probability, over all branches of its parent together; else it merges into them.
LEAST_CHANCE = 0.01
#: Labelled pages the prior counts for, and the purity below which a template is rejected.
PRIOR_PAGES = 10.0
LEAST_PURITY = 0.5

# A to Z and the lower-case letters they turn into.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first :// up to a slash, question mark, hash or the end; empty without one."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does.

    A rule is (verdict, "host/path"): it fits the host and its subdomains where the path starts
    with the rule's, slash included.
    """
    rule = verdict = None
    for judged, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, judged) if verdict is None else verdict.when(fits, judged)
    if rule is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return rule, verdict


def general_segments(path: Column) -> Column:
    """The segments of a path with numbers and ids as wildcards."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(
        parts,
        lambda s: F.when(s.rlike(r"^\d+(\.\w+)?$"), F.regexp_replace(s, r"^\d+", WILDCARD))
        .when(s.rlike(r"^[0-9A-Fa-f]{8,}$") | s.rlike(r"^[0-9A-Fa-f-]{36}$"), F.lit(WILDCARD))
        .otherwise(s),
    )


def chance_of_branch() -> Column:
    """Bound of the logarithm of the chance that some branch differs from its parent as much as this one.

    The number of good among a branch's labels is hypergeometric given the counts of its parent. Its
    tail is at most exp(-labels x divergence), for one label as for a million; the bound is counted
    twice for two sides and once for each branch. Pages without labels do not matter.
    """
    labelled, here = F.col("labelled").cast("double"), F.col("good") / F.col("labelled")
    there = F.col("all_good") / F.col("all_labelled")
    good = F.when(F.col("good") > 0, here * F.log(here / there)).otherwise(0.0)
    bad = F.when(F.col("good") < F.col("labelled"), (1 - here) * F.log((1 - here) / (1 - there))).otherwise(0.0)
    return F.when(labelled > 0, F.log(2.0 * F.col("branches")) - labelled * (good + bad)).otherwise(F.lit(math.inf))


def grow_templates(pages: DataFrame) -> DataFrame:
    """Template of each (host, segments) of (host, segments, good): the reduced tree of every host.

    `good` is 1 or 0 for a label, null for a page. Pages are added up by equal segments first, so a host that fills a third
    of the table arrives as sums. Each level joins the sums of a branch with those of its parent, as
    long as segments are left. From PLAIN_LEVELS on, what lies below a branch without labels of both
    kinds is one last wildcard: nothing below it can differ from it.
    Returns (host, segments, template, pages, labelled, good).
    """
    leaves = stash(
        pages.groupBy("host", "segments").agg(
            F.count(F.when(F.col("good").isNull(), 1)).alias("pages"), F.count("good").alias("labelled"), F.coalesce(F.sum("good"), F.lit(0)).alias("good")
        ),
        "paths",
    ).withColumns({"template": F.lit("").cast("string"), "ended": F.lit(False)})
    level = 0
    while not leaves.where(~F.col("ended") & (F.size("segments") > level)).isEmpty():
        segment = F.when(~F.col("ended") & (F.size("segments") > level), F.element_at("segments", level + 1))
        rows = leaves.withColumn("segment", segment)
        sums = [F.sum(c).alias(c) for c in ("pages", "labelled", "good")]
        branches = rows.where("segment is not null").groupBy("host", "template", "segment").agg(*sums)
        parents = branches.groupBy("host", "template").agg(
            *[F.sum(c).alias(f"all_{c}") for c in ("pages", "labelled", "good")], F.count("*").alias("branches")
        )
        stands = (F.col("branches") == 1) | (chance_of_branch() <= math.log(LEAST_CHANCE))
        ends = F.lit(level >= PLAIN_LEVELS) & ((F.col("all_good") == 0) | (F.col("all_good") == F.col("all_labelled")))
        shown = F.when(ends, WILDCARD * 2).when(stands, F.col("segment")).otherwise(WILDCARD)
        kept = branches.join(parents, ["host", "template"]).select("host", "template", "segment", shown.alias("shown"), ends.alias("ends"))
        leaves = rows.join(kept, ["host", "template", "segment"], "left").select(
            "host",
            "segments",
            "pages",
            "labelled",
            "good",
            F.when(F.col("shown").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), "shown")).alias("template"),
            (F.col("ended") | F.coalesce("ends", F.lit(False))).alias("ended"),
        )
        leaves = stash(leaves, f"level-{level}")
        level += 1
    return leaves.drop("ended")


def judge_templates(leaves: DataFrame, prior_pages: float = PRIOR_PAGES, least_purity: float = LEAST_PURITY) -> DataFrame:
    """(host, template, purity, rejected): purity is smoothed towards that of all labelled pages."""
    sums = leaves.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("good").alias("good"))
    known = leaves.agg(F.sum("good").alias("good"), F.sum("labelled").alias("labelled")).first()  # one row
    prior = (known["good"] or 0) / known["labelled"] if known["labelled"] else 1.0
    purity = (F.col("good") + F.lit(prior * prior_pages)) / (F.col("labelled") + F.lit(prior_pages))
    return sums.select("host", "template", purity.alias("purity"), (purity < least_purity).alias("rejected"))


def judge(
    pages: DataFrame,
    labels: DataFrame,
    rules: Sequence[tuple[str, str]] = (),
    least_purity: float = LEAST_PURITY,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """(id, host, path, rule, verdict, template, purity) of every page.

    `labels` is (host, path, good), good 1 or 0, in any number for an address; rows with a null are
    left out. A url without :// or a null one has an empty host and path and is judged like any
    other; a template nobody labelled has the purity of all labelled pages. Repeated rows stay.
    """
    rows = pages.select(
        F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")
    )
    named = rows.select("host", general_segments(F.col("path")).alias("segments"), F.lit(None).cast("int").alias("good"))
    known = labels.where("host is not null and path is not null and good is not null").select(
        "host", general_segments(F.col("path")).alias("segments"), F.col("good").cast("int").alias("good")
    )
    leaves = grow_templates(named.unionByName(known))
    judged = leaves.select("host", "segments", "template").join(judge_templates(leaves, least_purity=least_purity), ["host", "template"])
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("rejected"), "block").otherwise("allow")
    return (
        rows.withColumn("segments", general_segments(F.col("path")))
        .join(judged, ["host", "segments"])
        .select("id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "template", "purity")
    )
