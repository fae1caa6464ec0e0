"""URL filter by a path-template tree.

A url's host and path come from its text. Per host:

1. Path segments are generalised: a run of digits becomes ``{n}``. Equal typed
   paths are counted once, with their labelled and good pages.
2. Level by level, until no path has a further segment, the children of a
   template node are named; an only child's path is followed at once as far as
   it does not branch. A child becomes
   the wildcard ``*`` if its share of good pages does not differ from its
   siblings' (two-proportion z-test, whatever their number and its size): like
   branches and variable segments merge, odd ones stay apart.
3. A template's purity is its share of good labelled pages, smoothed towards
   its host's, which is smoothed towards that of all pages. Templates of purity
   below LEAST are blocked.

Fixed rules (host, path, verdict) come before the templates: a rule fits its
host and all subdomains if the url's path starts with the rule's; the longest
wins (host and path together; then the first given).

Everything is built from counts (partial aggregation first), so a hot host is
spread until its typed paths are few. Defined results: a null url, or one
without ``://``, has empty host and path; pages without a label count as
pages only; conflicting labels of a page: good only if all are; repeated rows
are judged alike; an empty table gives no rows; input columns named like an
output are carried as ``<name>_input``. A level costs the driver one round of
jobs over the counted paths that still have segments; the rounds are as many as
the deepest path has places where it branches, whatever its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsift.llm.work import Work, free_names, set_aside

Z = 1.96
WEIGHT = 10.0
LEAST = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OUTPUTS = {"host", "path", "rule", "verdict", "template", "purity"}


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, null if none fits. The rule
    list is configuration of a few entries."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # the first of the longest is tried first, so it is wrapped last
    for h, p, v in sorted(reversed(rules), key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _typed(path: Column) -> Column:
    """The path's segments, typed."""
    return F.filter(F.split(F.regexp_replace(path, "[0-9]+", "{n}"), "/"), lambda s: s != "")


def templates(counted: DataFrame, work: Work) -> DataFrame:
    """(host, parts, labelled, good, template) of typed paths (host, parts,
    labelled, good); a written table for each level."""
    columns = ["host", "parts", "labelled", "good"]
    # tail: the segments that the template does not hold yet
    t = counted.select(*columns, F.lit("").alias("template"), F.col("parts").alias("tail"))
    levels = []
    while True:
        levels.append(f"level{len(levels)}")
        t = work.table(t, levels[-1])
        left = t.filter(F.size("tail") > 0).withColumn("seg", F.get("tail", F.lit(0)))
        if left.isEmpty():
            break
        kids = left.groupBy("host", "template", "seg").agg(
            *(F.sum(c).alias(c) for c in ("labelled", "good")), F.min("tail").alias("lo"), F.max("tail").alias("hi"))
        nodes = kids.groupBy("host", "template").agg(
            F.count(F.lit(1)).alias("kids"), *(F.sum(c).alias(f"all_{c}") for c in ("labelled", "good")))
        other, other_good = F.col("all_labelled") - F.col("labelled"), F.col("all_good") - F.col("good")
        share = F.col("all_good") / F.col("all_labelled")
        spread = share * (1 - share) * (1 / F.col("labelled") + 1 / other)
        gap = F.abs(F.col("good") / F.col("labelled") - other_good / other)
        # siblings that cannot be told apart, too: no labels, or one share for all
        alike = (F.when((F.col("labelled") == 0) | (other == 0), F.lit(True))
                 .otherwise((spread <= 0) | (gap < Z * F.sqrt(spread))))
        # what the least and the greatest tail begin with, all between them do
        same = F.zip_with("lo", "hi", lambda x, y: F.coalesce(x == y, F.lit(False)))
        apart = F.array_position(same, F.lit(False)).cast("int")
        common = F.when(apart > 0, apart - 1).otherwise(F.size("lo"))
        named = (kids.join(nodes, ["host", "template"]).withColumn("step", F.when(F.col("kids") > 1, 1).otherwise(common))
                 .select("host", "template", "seg", "step",
                         F.when((F.col("kids") > 1) & alike, F.lit("*"))
                         .otherwise(F.array_join(F.slice("lo", F.lit(1), F.col("step")), "/")).alias("name")))
        t = left.join(named, ["host", "template", "seg"]).select(
            *columns, F.concat("template", F.lit("/"), "name").alias("template"),
            F.slice("tail", F.col("step") + 1, F.greatest(F.size("tail") - F.col("step"), F.lit(0))).alias("tail"))
    ended = t.sparkSession.read.schema(t.schema).parquet(*map(work.path, levels)).filter(F.size("tail") == 0)
    return ended.drop("tail")


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] = (), url: str = "url",
          page_id: str = "page_id", work: Work | None = None) -> DataFrame:
    """The input's columns with host, path, rule, verdict, template and purity.
    ``labels``: (page_id, good)."""
    work = work or Work(pages.sparkSession, "path-tree")
    pages = set_aside(pages, OUTPUTS)
    host, path = host_path(F.col(url).cast("string"))
    parts, labelled, good = free_names(pages, "_parts", "_labelled", "_good")
    seen = pages.withColumn("host", host).withColumn("path", path).withColumn(parts, _typed(F.col("path")))
    known = labels.groupBy(F.col(page_id).alias(labelled)).agg(F.min(F.col("good").cast("int")).alias(good))
    # small beside the pages, and read by every level
    counted = work.table(
        seen.select(page_id, "host", parts).join(known, F.col(page_id) == F.col(labelled), "left")
        .groupBy("host", F.col(parts).alias("parts"))
        .agg(F.count(good).alias("labelled"), F.coalesce(F.sum(good), F.lit(0)).alias("good")), "counted")
    tree = templates(counted, work)
    total = counted.agg(((F.sum("good") + 1) / (F.sum("labelled") + 2)).alias("p"))
    hosts = counted.groupBy("host").agg(F.sum("labelled").alias("hl"), F.sum("good").alias("hg")).select(
        "host", ((F.col("hg") + WEIGHT * total.scalar()) / (F.col("hl") + WEIGHT)).alias("hp"))
    pure = (tree.groupBy("host", "template").agg(F.sum("labelled").alias("tl"), F.sum("good").alias("tg"))
            .join(hosts, "host").select("host", "template", ((F.col("tg") + WEIGHT * F.col("hp")) / (F.col("tl") + WEIGHT)).alias("purity")))
    verdicts = tree.select("host", F.col("parts").alias(parts), "template").join(pure, ["host", "template"])
    rule, verdict = rule_of(F.col("host"), F.col("path"), list(rules))
    return (seen.join(verdicts, ["host", parts])
            .select(*pages.columns, "host", "path", rule.alias("rule"),
                    F.coalesce(verdict, F.when(F.col("purity") < LEAST, "block").otherwise("allow")).alias("verdict"),
                    "template", "purity"))
