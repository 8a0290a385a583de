"""URL filter: rules first, and for other urls a path-template tree per host, judged by smoothed labelled purity.

Paths become templates: digits are a wildcard at once, other segments where they vary: many at their place in the host's tree,
none with a fair share of it, or seen once. Branches that differ in names only are merged if a chi-square test sees no difference from all
such branches of the host, neither in the urls' tails nor in the mix of labels, and if the shares of labels are near each
other (a test of few urls sees nothing, and a branch without labels must not take those of its neighbours). The rules' verdicts
are the labels; a template is rejected if its smoothed share of blocked urls is high and enough of its urls are labelled. A
url is evidence once, however often it occurs.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenant.llm.common import checkpoint

#: (verdict, host, path): a rule fits its host and all subdomains, if the path starts with the rule's; the longest wins.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: A segment stays a name if at least so many urls have it, and it is one of so few at its place, or this share of those there have it.
LEAST, FEW, SHARE = 2, 16, 0.1
#: Chi-square of six shares above which a branch isn't merged (one in a thousand by chance), and the most by which its shares of
#: labels may differ.
CHI_SQUARE, NEAR = 22.46, 0.25
#: Pseudo-counts of either label, the purity from which a template is rejected, the share of its urls that need labels.
SMOOTHING, PURITY, LABELLED = 1.0, 0.9, 0.2

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TAILS = ("query", "fragment", "slash", "extension")
_LABELS = ("blocked", "labelled")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path; both empty if the url is null or has no '://'."""
    after = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The name (host and path) and verdict of the longest rule that fits, else null. The list of rules is a parameter."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return name, verdict


def templates(shapes: DataFrame) -> DataFrame:
    """host, shape, urls -> host, shape, template: level by level, rare segments become '*'.

    A shape that is alone at its place is finished at once, as what follows is either all rare or none of it. So there are as many
    levels as the longest common start of two shapes has segments, and each reads only what is open yet.
    """
    wild = lambda x: x.rlike(r"^\{n\}(\.\w+)?$|^$")
    rows = shapes.select("host", "shape", "urls", F.split(F.expr("substring(shape, 2)"), "/").alias("segments"), F.lit("").alias("template"))
    done, level = [], 0
    while True:
        rows = rows.withColumn("segment", F.get("segments", F.lit(level)))
        named = rows.groupBy("host", "template", "segment").agg(F.sum("urls").alias("having"), F.count(F.lit(1)).alias("kinds"))
        around = named.groupBy("host", "template").agg(F.sum("having").alias("here"), F.sum("kinds").alias("shapes"), F.count(F.lit(1)).alias("names"))
        stays = (F.col("having") >= LEAST) & ((F.col("names") <= FEW) | (F.col("having") >= SHARE * F.col("here")))
        told = named.join(around, ["host", "template"]).select("host", "template", "segment", stays.alias("stays"), (F.col("shapes") == 1).alias("alone"))
        own = F.when(F.col("stays") | wild(F.col("segment")), F.col("segment")).otherwise(F.lit("*"))
        rest = F.transform(F.slice("segments", level + 2, F.size("segments")), lambda x: F.when((F.col("urls") >= LEAST) | wild(x), x).otherwise(F.lit("*")))
        grown = F.when(F.col("alone"), F.array_join(F.concat(F.array(own), rest), "/")).otherwise(own)
        over = F.col("alone") | (F.size("segments") == level + 1)
        rows = checkpoint(rows.join(told, ["host", "template", "segment"]).select("host", "shape", "urls", "segments", F.concat("template", F.lit("/"), grown).alias("template"), over.alias("over")))
        done.append(rows.where("over").select("host", "shape", "template"))
        rows = rows.where("NOT over").drop("over")
        level += 1
        if rows.isEmpty():
            return reduce(DataFrame.union, done)


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Per row of pages: page_id, host, path, rule, verdict, template, purity.

    The verdict is the fitting rule's, else block if the url's template is rejected, else allow. Urls without a host (null
    or odd ones) have an empty host and path, no template, and are allowed. Repeated urls are one evidence; an empty table
    gives no rows; other columns are not read. The tree is built from one row per host and shape, so a large host costs no
    more than its shapes; urls meet them in one join whose large keys Spark splits.
    """
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("said", said).withColumn("shape", F.regexp_replace("path", "[0-9]+", "{n}"))
    flags = {
        "query": F.contains("url", F.lit("?")),
        "fragment": F.contains("url", F.lit("#")),
        "slash": F.endswith("path", F.lit("/")),
        "extension": F.col("path").rlike(r"\.[A-Za-z]{2,5}$"),
    }
    count = F.count_if
    marks = {n: F.coalesce(x, F.lit(False)) for n, x in flags.items()} | {"blocked": F.coalesce(F.col("said") == "block", F.lit(False)), "labelled": F.col("said").isNotNull()}
    urls = rows.where("host <> ''").select("url", "host", "shape", *[x.alias(n) for n, x in marks.items()]).distinct()
    shapes = checkpoint(urls.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("urls"), *[count(F.col(n)).alias(n) for n in marks]))
    found = checkpoint(templates(shapes))

    # A branch's skeleton has its names as wildcards; branches like their host's average of a skeleton are merged into it.
    sums = [F.sum(n).alias(n) for n in ("urls", *marks)]
    skeleton = F.regexp_replace("template", r"/[^/{*]+(?=/|$)", "/*")
    branches = checkpoint(shapes.join(found, ["host", "shape"]).groupBy("host", "template").agg(*sums).withColumn("skeleton", skeleton))
    pooled = branches.groupBy("host", "skeleton").agg(*[F.sum(n).alias(f"all_{n}") for n in ("urls", *marks)])
    off, near = F.lit(0.0), F.lit(True)
    for n in marks:
        share = F.col(f"all_{n}") / F.col("all_urls")
        spread = F.col("urls") * share * (1 - share)
        off = off + F.when(spread > 0, F.pow(F.col(n) - F.col("urls") * share, F.lit(2)) / spread).otherwise(0.0)
        if n in _LABELS:
            near = near & (F.abs(F.col(n) / F.col("urls") - share) <= NEAR)
    merged = checkpoint(branches.join(pooled, ["host", "skeleton"]).select("host", "template", "urls", "blocked", "labelled", (off <= CHI_SQUARE).alias("like"), near.alias("near"), "skeleton").withColumn("merged", F.col("like") & F.col("near")).withColumn("node", F.when(F.col("merged"), F.col("skeleton")).otherwise(F.col("template"))))
    purity = (F.col("node_blocked") + SMOOTHING) / (F.col("node_labelled") + 2 * SMOOTHING)
    nodes = merged.groupBy("host", "node", "merged").agg(F.sum("urls").alias("node_urls"), F.sum("blocked").alias("node_blocked"), F.sum("labelled").alias("node_labelled"))
    nodes = nodes.select("host", "node", "merged", purity.alias("purity"), ((purity >= PURITY) & (F.col("node_labelled") >= LABELLED * F.col("node_urls"))).alias("rejected"))
    judged = found.join(merged.select("host", "template", "node", "merged"), ["host", "template"]).join(nodes, ["host", "node", "merged"])
    judged = judged.select(F.col("host").alias("tree_host"), F.col("shape").alias("tree_shape"), F.col("node").alias("template"), "purity", "rejected")
    verdict = F.coalesce("said", F.when(F.col("rejected"), F.lit("block")), F.lit("allow"))
    return rows.join(judged, (F.col("host") == F.col("tree_host")) & (F.col("shape") == F.col("tree_shape")), "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
