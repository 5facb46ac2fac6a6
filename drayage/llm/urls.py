"""Judge URLs by host and path rules, by joining hashes of their expressions.

A URL is expanded into every pair of a host suffix (the host and its parent
domains, of the numbers of labels that occur in the rules) and a path prefix (of the
lengths that occur there).  Pairs meet
rules by the first bytes of a digest; a meeting counts when the whole digest
agrees.  Of the rules that fit, the longest wins; among equally long ones the
longer host, then block before allow, then the rule's text.  A URL that no rule
fits is allowed.

Distinct (host, path) pairs are judged once.  A null URL and one without `://`
have an empty host and path, which fits no rule unless one has an empty host.
Repeated rows each get the verdict.  An empty table gives no rows, and without
rules every URL is allowed.  Further columns are passed over.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

DEFAULT = "allow"
#: Hexadecimal digits of the digest that are joined on.
SHORT = 8


def host_of(url) -> "F.Column":
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _UPPER.lower())


def path_of(url) -> "F.Column":
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules as (action, host, path)."""
    return spark.createDataFrame(rules, "action string, host string, path string")


def _digest(host, path) -> "F.Column":
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def _labels(host: str) -> "F.Column":
    """Number of a host's labels: one more than its dots."""
    return F.length(host) - F.length(F.replace(F.col(host), F.lit("."), F.lit(""))) + 1


def verdicts(pages: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """Distinct host and path, the rule that wins (null if none) and the verdict."""
    urls = pages.select(host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")).distinct()
    # one row each, bounded by the longest path and the most labels of a rule
    lengths = rules.agg(F.array_sort(F.collect_set(F.length("path"))).alias("lengths"))
    depths = rules.agg(F.array_sort(F.collect_set(_labels("host"))).alias("depths"))
    reached = F.filter("depths", lambda k: k <= F.col("labels"))
    suffixes = F.transform(reached, lambda k: F.call_function("substring_index", F.col("host"), F.lit("."), -k))
    fitting = F.filter("lengths", lambda n: n <= F.length("path"))
    expressions = F.flatten(
        F.transform(
            suffixes,
            lambda s: F.transform(
                fitting, lambda n: F.struct(s.alias("suffix"), F.col("path").substr(F.lit(1), n).alias("prefix"))
            ),
        )
    )
    urls = urls.withColumns({"lengths": lengths.scalar(), "depths": depths.scalar(), "labels": _labels("host")})
    expanded = urls.select("host", "path", F.explode(expressions).alias("e"))
    expanded = expanded.select("host", "path", _digest(F.col("e.suffix"), F.col("e.prefix")).alias("digest"))
    known = rules.select(
        "action",
        F.col("host").alias("rule_host"),
        F.concat("host", "path").alias("rule"),
        _digest(F.col("host"), F.col("path")).alias("rule_digest"),
    ).distinct()
    met = expanded.withColumn("short", F.substring("digest", 1, SHORT)).join(
        known.withColumn("short", F.substring("rule_digest", 1, SHORT)), "short"
    )
    met = met.filter(F.col("digest") == F.col("rule_digest"))
    best = F.max(F.struct(F.length("rule"), F.length("rule_host"), F.col("action") == "block", "rule", "action"))
    won = met.groupBy("host", "path").agg(best.alias("best"))
    return won.select("host", "path", F.col("best.rule").alias("rule"), F.col("best.action").alias("verdict"))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: id, host, path, rule, verdict."""
    rows = pages.select(
        F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")
    )
    judged = rows.join(verdicts(pages, rules, url_col), ["host", "path"], "left")
    return judged.select("id", "host", "path", "rule", F.coalesce("verdict", F.lit(DEFAULT)).alias("verdict"))
