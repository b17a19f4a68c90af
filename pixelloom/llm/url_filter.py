"""URL verdicts by a path-template tree for each host.

Level by level, the segments of all paths become parts of templates. Runs of digits are `#`. A segment that too few URLs
of its parent share is variable and becomes `*`, unless it has enough labels and these differ from its parent's by more than chance, whatever its share. A
frequent segment stays as it is only if its labelled purity differs so; frequent segments that don't are merged into one branch, `~`. A finished template's purity is smoothed
towards its host's, and the host's towards that of all labels; templates below the threshold are rejected. Given rules come
first.

All steps are aggregations and equi-joins keyed by host, template so far and segment. Counts are summed before each shuffle. Levels go on to
the deepest path, with only the unfinished paths in each; a template of too few URLs to branch is finished at once.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.llm.common import fold_case, table
from pixelloom.plans.storage import write_shared

#: A segment is frequent with this share of its parent's URLs, and this many.
MIN_SHARE, MIN_COUNT = 0.02, 5
#: Labels with which a segment of any share can stay.
MIN_LABELS = 5
#: Standard errors from the parent's purity beyond which a branch is not merged.
MERGE_Z = 3.0
#: Labels that the prior weighs as.
SMOOTHING = 20.0
#: Templates of a smoothed purity below this are rejected.
MIN_PURITY = 0.5


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the query.
RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or a URL without `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.substring(url, F.instr(url, "://") + 3, F.length(url)), "?", 1))
    rest = F.substring_index(F.coalesce(rest, F.lit("")), "#", 1)
    host = F.substring_index(rest, "/", 1)
    return fold_case(host), F.substring(rest, F.length(host) + 1, F.length(rest))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """`struct(rule, verdict)` of the longest rule that fits, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def _level(paths: DataFrame, depth: int) -> DataFrame:
    """Add segment number `depth` to the templates of `paths`, all of which have one."""
    at = F.get("segments", F.lit(depth))
    here = paths.withColumn("segment", at)
    key = ["host", "template", "segment"]
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "good")]
    branches = here.groupBy(*key).agg(*sums)
    parents = branches.groupBy("host", "template").agg(*(F.sum(c).alias(f"all_{c}") for c in ("n", "labelled", "good")))
    joined = branches.join(parents, ["host", "template"])
    frequent = (F.col("n") >= MIN_COUNT) & (F.col("n") >= MIN_SHARE * F.col("all_n"))
    enough = (F.col("n") >= MIN_COUNT) & (F.col("labelled") >= MIN_LABELS)
    p = (F.col("all_good") + 0.5) / (F.col("all_labelled") + 1)
    z = F.when(F.col("labelled") > 0, F.abs(F.col("good") / F.col("labelled") - p) / F.sqrt(p * (1 - p) / F.col("labelled"))).otherwise(0.0)
    part = F.when((frequent | enough) & (z > MERGE_Z), F.col("segment")).when(frequent, "~")
    kept = write_shared(joined.select(*key, part.alias("part")).where("part is not null"), "branches")
    rare = parents.where(F.col("all_n") < MIN_COUNT).select("host", "template", F.lit(True).alias("rare"))
    named = here.join(kept, key, "left").join(rare, ["host", "template"], "left")
    tail = F.when(F.col("rare"), F.expr(f"repeat('/*', size(segments) - {depth})")).otherwise(F.concat(F.lit("/"), F.coalesce("part", F.lit("*"))))
    segments = F.when(F.col("rare"), F.slice("segments", 1, depth + 1)).otherwise(F.col("segments"))
    return named.select(*[F.concat("template", tail).alias(c) if c == "template" else segments.alias(c) if c == "segments" else c for c in paths.columns])


def path_templates(urls: DataFrame) -> DataFrame:
    """`(host, path, template, purity)` for each distinct host and path of `urls` (host, path, labelled, good)."""
    paths = urls.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("labelled").alias("labelled"), F.sum("good").alias("good"))
    segments = F.split(F.regexp_replace("path", "[0-9]+", "#"), "/")
    segments = F.slice(segments, F.lit(2), F.size(segments))
    unfinished = write_shared(paths.withColumn("segments", segments).withColumn("template", F.lit("")), "paths")
    finished, depth = [], 0
    while True:
        finished.append(unfinished.where(F.size("segments") <= depth))
        unfinished = unfinished.where(F.size("segments") > depth)
        if unfinished.isEmpty():
            break
        unfinished = write_shared(_level(unfinished, depth), "level")
        depth += 1
    paths = reduce(DataFrame.unionByName, finished)
    paths = write_shared(paths.select("host", "path", "template", "labelled", "good"), "templates")
    smooth = lambda good, labelled, prior: (good + SMOOTHING * prior) / (labelled + SMOOTHING)
    every = paths.agg(F.sum("good").alias("good"), F.sum("labelled").alias("labelled")).first()
    overall = ((every["good"] or 0) + 1) / ((every["labelled"] or 0) + 1)
    templates = paths.groupBy("host", "template").agg(F.sum("good").alias("good"), F.sum("labelled").alias("labelled"))
    hosts = templates.groupBy("host").agg(smooth(F.sum("good"), F.sum("labelled"), F.lit(overall)).alias("host_purity"))
    pure = templates.join(hosts, "host").select("host", "template", smooth(F.col("good"), F.col("labelled"), F.col("host_purity")).alias("purity"))
    return paths.select("host", "path", "template").join(write_shared(pure, "purity"), ["host", "template"])


def judge_urls(pages: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES, min_purity: float = MIN_PURITY) -> DataFrame:
    """`(page_id, url, host, path, rule, template, purity, verdict)`, one row for each row of `pages`.

    `labels` has `doc_id` and `quality` (1 good, 0 bad); a page has the label of the document whose number ends its path. A null
    URL and one without `://` have an empty host and path; they form a template like any other. Null labels are left out; a document with several labels
    counts as its worst. Without any labels nothing is rejected. Repeated pages keep their rows. Other columns are not looked at.
    """
    host, path = split_url(F.col("url"))
    split = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    number = F.expr(r"try_cast(nullif(regexp_extract(path, '([0-9]+)[^0-9]*$', 1), '') as bigint)")
    marks = labels.where(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").alias("number")).agg(F.min("quality").cast("long").alias("good"))
    marked = split.withColumn("number", number).join(marks, "number", "left")
    urls = marked.select("host", "path", F.col("good").isNotNull().cast("long").alias("labelled"), F.coalesce("good", F.lit(0)).alias("good"))
    judged = split.join(path_templates(urls), ["host", "path"]).withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    learned = F.when(F.col("purity") < min_purity, "block").otherwise("allow")
    return judged.select(
        "page_id", "url", "host", "path", F.col("fit.rule").alias("rule"), "template", "purity", F.coalesce("fit.verdict", learned).alias("verdict")
    )


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's URL."""
    judged = judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "template", F.round("purity", 6).alias("purity"))
