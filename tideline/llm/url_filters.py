"""URL filters: allow and block rules on host suffixes and path prefixes, native DataFrame functions only.

Every URL is expanded into its host-suffix and path-prefix expressions, of the shapes that the rules
have (so many labels, so many path characters); expressions join the rules on the first 8 digits of a
SHA-256 and are confirmed by all 64.  The longest fitting rule wins.

Cases: a null URL, and one without ``://``, has an empty host and path; repeated and null keys get a row
each; without any rule that fits, the verdict is ``default``; of two rules on the same host and path the
block wins, of rules of equal length the longer host; a rule whose host holds ``/ ? #``, or whose
path neither is empty nor begins with ``/``, fits nothing; an empty table gives no rows; other columns
are ignored.  URLs of any length are read whole: the expansion is bounded by the rules' shapes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first ``://``: the lower-cased host up to ``/ ? #``, and the path up to ``? #``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _labels(host: str) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."))) + 1


def _digest(expression: Column) -> list[Column]:
    full = F.sha2(expression, 256)
    return [F.substring(full, 1, 8).alias("short"), full.alias("digest")]


def compiled(rules: DataFrame, host: str = "host", path: str = "path", verdict: str = "verdict") -> DataFrame:
    """``short, digest, rule, rule_host, blocks`` of every rule that can fit, one row for each host and path."""
    named = rules.select(F.translate(host, _UPPER, _LOWER).alias("rule_host"), F.col(path).alias("rule_path"), (F.col(verdict) == "block").alias("blocks"))
    sound = named.filter(~F.col("rule_host").rlike("[/?#]") & ((F.col("rule_path") == "") | F.col("rule_path").startswith("/")))
    one = sound.groupBy("rule_host", "rule_path").agg(F.bool_or("blocks").alias("blocks"))
    rule = F.concat("rule_host", "rule_path")
    return one.select(*_digest(rule), rule.alias("rule"), "rule_host", "blocks")


def expressions(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``host, path, short, digest``: the expressions of ``urls`` that have the shape of a rule.

    The shapes come from a scalar subquery, so nothing passes through the driver's Python; there are at
    most as many as pairs of label counts and path lengths among the rules.
    """
    size = F.length("rule") - F.length("rule_host")
    shapes = rules.agg(F.collect_set(F.struct(_labels("rule_host").alias("labels"), size.alias("size")))).scalar()
    shaped = urls.select("host", "path", shapes.alias("shapes"), _labels("host").alias("n"), F.length("path").alias("m"))
    fitting = F.filter("shapes", lambda s: (s["labels"] <= F.col("n")) & (s["size"] <= F.col("m")))
    each = shaped.select("host", "path", F.inline(fitting))
    suffix = F.expr("substring_index(host, '.', -labels)")
    return each.select("host", "path", *_digest(F.concat(suffix, F.expr("substring(path, 1, size)"))))


def judge(pages: DataFrame, rules: DataFrame, *, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """``key, host, path, rule, verdict`` of every row of ``pages``.

    Expansion and joins run over distinct (host, path) pairs.  Rules have one row per digest: Spark broadcasts
    them where their size allows, and splits the URL side of a hot expression where it does not.
    """
    host, path = host_and_path(F.col(url))
    parsed = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"))
    table = compiled(rules)
    met = expressions(parsed.select("host", "path").distinct(), table).join(table, ["short", "digest"])
    best = met.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("size"), F.length("rule_host").alias("host_size"), "rule", "blocks")).alias("best"))
    verdict = F.when(F.col("best.blocks"), "block").when(~F.col("best.blocks"), "allow").otherwise(default)
    return parsed.join(best, ["host", "path"], "left").select(F.col("key").alias(key), "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"))
