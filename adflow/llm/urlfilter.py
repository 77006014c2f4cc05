"""URL filter by hashed host-suffix and path-prefix expressions.

Every URL is expanded into the expressions host suffix + path prefix that a rule
could equal: the suffix lengths (in labels) and prefix lengths (in characters)
that occur among the rules. Expressions meet the rules in an equi-join on the
first ``SHORT`` hex digits of their SHA-256; the full digests are then compared,
so a clash of short prefixes decides nothing. The longest rule wins; of two rules
with one expression, block wins.

Distinct (host, path) pairs are judged once and joined back to all rows. The rule
side is broadcast only after its rows are counted; above ``BROADCAST_RULES`` it
is shuffled, and adaptive execution splits the partitions of hot suffixes.

Defined results: a null URL, or one without ``://``, has an empty host and path,
which no rule fits. Without a rule the verdict is ``default``. Rules must have a
host; a null path counts as empty. Repeated rows are judged alike, and a null id is an
id like any other. Very long URLs are cut by the rules' lengths only. An empty table
gives an empty result. Columns are taken by name into fresh ones, so that other columns
cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHORT = 8
BROADCAST_RULES = 200_000


def ascii_lower(column: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(column, upper, upper.lower())


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased. Path: then up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    pattern = r"^([^/?#]*)([^?#]*)"
    return ascii_lower(F.regexp_extract(rest, pattern, 1)), F.regexp_extract(rest, pattern, 2)


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def compiled_rules(rules: DataFrame) -> DataFrame:
    """rule, verdict, digest, short from (host, path, verdict), one row a rule."""
    host, path = ascii_lower(F.col("host")), F.coalesce(F.col("path"), F.lit(""))
    return (rules.select(F.concat(host, path).alias("rule"), host.alias("host"), path.alias("path"), "verdict")
            .groupBy("rule", "host", "path").agg(F.max("verdict").alias("verdict"))  # block after allow
            .withColumn("digest", F.sha2("rule", 256)).withColumn("short", F.substring("digest", 1, SHORT)))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", page_id: str = "page_id",
          default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict for every row of ``pages``. ``rules``
    is (host, path, verdict) with verdicts allow and block."""
    host, path = host_and_path(F.col(f"`{url}`"))
    urls = pages.select(F.col(f"`{page_id}`").alias(page_id), host.alias("host"), path.alias("path"))
    table = compiled_rules(rules)
    shape = table.agg(F.collect_set(_labels(F.col("host"))).alias("labels"),  # lengths, a handful of numbers
                      F.collect_set(F.length("path")).alias("chars"), F.count(F.lit(1)).alias("n")).first()
    pairs = [F.when((_labels(F.col("host")) >= k) & (F.length("path") >= m),
                    F.concat(F.substring_index("host", ".", -k), F.substring("path", 1, m)))
             for k in sorted(shape["labels"]) for m in sorted(shape["chars"])]
    expressions = F.filter(F.array(*(pairs or [F.lit(None).cast("string")])), lambda x: x.isNotNull())
    expanded = (urls.select("host", "path").distinct()
                .select("host", "path", F.explode(expressions).alias("expression"))
                .withColumn("full", F.sha2("expression", 256)).withColumn("short", F.substring("full", 1, SHORT)))
    side = table.select("rule", "verdict", "digest", "short")
    if shape["n"] <= BROADCAST_RULES:
        side = F.broadcast(side)
    best = (expanded.join(side, "short").filter(F.col("full") == F.col("digest"))
            .groupBy("host", "path")
            .agg(F.max(F.struct(F.length("rule").alias("n"), "verdict", "rule")).alias("best")))
    return urls.join(best, ["host", "path"], "left").select(
        page_id, "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
