"""URL filter: allow and block rules by host and path, gradient-boosted trees where no rule fits.

A rule `host/path` fits its host and all subdomains if the URL's path starts with the rule's; of the
rules that fit, the longest holds. URLs that a rule judges are the labelled ones; trees are boosted on
their lexical features (length, depth, digit share, entropy, parameter counts, suffix statistics) and
judge all other URLs. Everything is DataFrame functions and Spark's own tree learner.

The trees learn from at most `SAMPLE` labelled rows, taken by a hash of the URL; the statistics of host
suffixes are counted over all labelled rows.

Edge cases: a null URL or one without `://` has empty host and path, fits no rule and is judged by the
trees like any other; if the labelled rows lack a class, all other URLs get the class there is, `allow`
if there is none; an empty table gives no rows; repeated rows get the same verdict; extra columns are
ignored.
"""

from __future__ import annotations

import string

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_summary, settle

#: (verdict, rule)
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"),
         ("block", "net/fr/")]
SAMPLE = 100_000
TREES, DEPTH, SEED = 20, 4, 17
PRIOR_ROWS, FOLDS = 20.0, 5

FEATURES = ["f_length", "f_host_length", "f_path_length", "f_depth", "f_labels", "f_digits", "f_entropy", "f_params",
            "f_query", "f_fragment", "f_hyphens", "f_extension", "f_suffix_rate", "f_suffix_rows"]


def parsed(urls: DataFrame) -> DataFrame:
    """`urls` with host (A-Z lower-cased) and path."""
    url = F.coalesce(F.col("url"), F.lit(""))
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return urls.withColumns({"host": host, "path": F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)})


def _fits(rule: str) -> Column:
    host, _, path = rule.partition("/")
    own = (F.col("host") == host) | F.endswith("host", F.lit("." + host))
    return own & F.startswith("path", F.lit("/" + path))


def judged(urls: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """Parsed URLs with the longest rule that fits and its verdict (null without one)."""
    rule = verdict = F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: (len(x[1]), x[1])):
        rule, verdict = F.when(_fits(r), F.lit(r)).otherwise(rule), F.when(_fits(r), F.lit(v)).otherwise(verdict)
    return urls.withColumns({"rule": rule, "rule_verdict": verdict})


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def features(urls: DataFrame) -> DataFrame:
    """Lexical features of parsed URLs, and the host's last label as `suffix`."""
    url = F.coalesce(F.col("url"), F.lit(""))
    size = F.greatest(F.length(url), F.lit(1))
    share = lambda c: (F.length(url) - F.length(F.replace(url, c))) / size
    chars = F.array_distinct(F.split(url, ""))
    entropy = F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    return urls.withColumns({
        "f_length": F.length(url).cast("double"), "f_host_length": F.length("host").cast("double"),
        "f_path_length": F.length("path").cast("double"), "f_depth": _count(F.col("path"), "/").cast("double"),
        "f_labels": (_count(F.col("host"), ".") + 1).cast("double"), "f_digits": _count(url, string.digits) / size,
        "f_entropy": entropy, "f_params": F.size(F.filter(F.split(query, "&"), lambda p: p != "")).cast("double"),
        "f_query": F.length(query).cast("double"), "f_fragment": _count(url, "#").cast("double"),
        "f_hyphens": _count(F.col("host"), "-").cast("double"),
        "f_extension": F.col("path").rlike(r"\.[A-Za-z0-9]{1,5}$").cast("double"),
        "suffix": F.regexp_extract("host", r"([^.]*)$", 1)})


def verdicts(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score (share of block) of every page's URL."""
    rows = settle(features(judged(parsed(pages.select("page_id", "url")), rules)).drop("url"))
    rows = rows.withColumn("label", F.when(F.col("rule_verdict").isNotNull(),
                                           (F.col("rule_verdict") == "block").cast("double")))
    known = rows.filter("label is not null")
    total = known.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("blocked")).first()
    out = ["page_id", "host", "path", "rule"]
    if not total["n"] or total["blocked"] in (0.0, float(total["n"])):
        only = "block" if total["blocked"] else "allow"
        return rows.select(*out, F.coalesce("rule_verdict", F.lit(only)).alias("verdict"),
                           F.coalesce("label", F.lit(float(only == "block"))).alias("score"))
    mean = total["blocked"] / total["n"]
    # suffix statistics over all labelled rows, for a labelled row over those of the other folds, so that its own
    # label is not among them; drawn towards the overall rate where rows are few
    rows = rows.withColumn("fold", F.when(F.col("label").isNotNull(), F.pmod(
        F.xxhash64(F.lit("fold"), "host", "path", "page_id"), F.lit(FOLDS))).cast("int"))
    by_fold = [F.col("fold") == k for k in range(FOLDS)]
    suffix = settle(rows.groupBy("suffix").agg(
        F.array(*[F.coalesce(F.sum(F.when(k, F.col("label"))), F.lit(0.0)) for k in by_fold]).alias("blocked"),
        F.array(*[F.count_if(k) for k in by_fold]).alias("seen")))
    rows = join_summary(rows, suffix, ["suffix"])

    def others(column: str) -> Column:
        every = F.aggregate(column, F.lit(0.0), lambda a, x: a + x)
        return every - F.coalesce(F.get(F.col(column), F.col("fold")), F.lit(0.0))
    rows = rows.withColumns({
        "f_suffix_rate": (others("blocked") + mean * PRIOR_ROWS) / (others("seen") + PRIOR_ROWS),
        "f_suffix_rows": F.log1p(others("seen"))}).drop("blocked", "seen")
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    share = min(1.0, SAMPLE / total["n"])
    drawn = F.pmod(F.xxhash64(F.lit("train"), "host", "path", "page_id"), F.lit(1_000_000)) < int(share * 1_000_000)
    taught = settle(rows.filter("label is not null").filter(drawn).select("label", "features"))
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=SEED, maxMemoryInMB=64).fit(taught)
    scored = trees.transform(rows).withColumn("score", vector_to_array("probability")[1])
    method = F.when(F.col("score") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(*out, F.coalesce("rule_verdict", method).alias("verdict"), "score")
