"""Allow and block rules for page addresses, matched by hashed host and path expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MAX_RULE_PATH = 2048
PREFIX_HEX = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): the host lies between the first ``://`` and a slash, question mark, hash
    or the end, A-Z lower-cased; the path follows up to a question mark or hash."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return (F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1))


def _labels(host: Column) -> Column:
    return F.split(host, r"\.")


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict: the rule that decides each address.

    ``pages``: page_id, url; other columns are ignored. ``rules``: host, path, verdict
    (``allow`` or ``block``). The engine's own records hold no addresses, so this works on any
    table of addresses. A rule fits its host and all subdomains when the path starts with the
    rule's; the rule with most characters wins, block before allow and then the smaller text on a tie. ``rule``
    is host and path together, null when none fits; then ``default`` is the verdict.

    Method: distinct targets are expanded into host suffixes and path prefixes, but only with
    label counts and path lengths that some rule has (bounded by ``MAX_RULE_PATH``, a longer
    rule is an error). Expressions meet rules in an equi-join on the first 8 hex digits of a
    digest; the full digest confirms, precedence picks. A rule that fits a third of all
    targets is one hot join key, which the adaptive skew join splits.

    A null address or one without ``://`` has an empty host and path and no rule. Repeated pages
    each get their row. No rules: every page gets ``default``. Rules with null parts are skipped.
    """
    host, path = url_parts(F.col("url"))
    pages = pages.select("page_id", host.alias("host"), path.alias("path"))
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict")).dropna()
    expression = F.concat("rule_host", "rule_path")
    rules = rules.select(expression.alias("rule"), "rule_verdict", F.sha2(expression, 256).alias("digest"), F.size(_labels(F.col("rule_host"))).alias("labels"), F.length("rule_path").alias("length"))
    # At most MAX_RULE_PATH lengths times the label counts of hosts; a host has 127 labels at most.
    shapes = [(r.labels, r.length) for r in rules.select(F.least("labels", F.lit(128)).alias("labels"), F.least("length", F.lit(MAX_RULE_PATH + 1)).alias("length")).distinct().collect()]
    if any(labels > 127 or length > MAX_RULE_PATH for labels, length in shapes):
        raise ValueError(f"a rule has more than 127 labels or a path longer than {MAX_RULE_PATH}")
    if not shapes:
        none = F.lit(None).cast("string")
        return pages.select("page_id", "host", "path", none.alias("rule"), F.lit(default).alias("verdict"))

    targets = pages.where("host <> ''").select("host", "path").distinct().withColumn("labels", _labels(F.col("host")))
    count = F.size("labels")
    shape = F.explode(F.array(*(F.struct(F.lit(a).alias("labels"), F.lit(b).alias("length")) for a, b in shapes))).alias("shape")
    tried = targets.select("host", "path", "labels", shape).where((count >= F.col("shape.labels")) & (F.length("path") >= F.col("shape.length")))
    suffix = F.array_join(F.slice("labels", count - F.col("shape.labels") + 1, F.col("shape.labels")), ".")
    tried = tried.select("host", "path", F.sha2(F.concat(suffix, F.substr("path", F.lit(1), F.col("shape.length"))), 256).alias("tried"))
    tried = tried.withColumn("prefix", F.substring("tried", 1, PREFIX_HEX))
    known = rules.select("rule", "rule_verdict", "digest", F.substring("digest", 1, PREFIX_HEX).alias("prefix"))
    met = tried.join(known, "prefix").where("tried = digest")
    best = F.struct((-F.length("rule")).alias("length"), (F.col("rule_verdict") != "block").alias("allows"), F.col("rule"), F.col("rule_verdict"))
    picked = met.groupBy("host", "path").agg(F.min(best).alias("best"))
    return pages.join(picked, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))
