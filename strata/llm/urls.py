"""URL rules as a sort-merge range join: reversed-host keys turn rules into nested intervals that a sorted sweep keeps on a stack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def _key(labels: Column, path: Column) -> Column:
    """Host labels from the top level down, a slash, which no host holds, and the path, as bytes (which sort unsigned)."""
    return F.encode(F.concat(F.concat_ws(".", F.reverse(labels)), F.lit("/"), path), "UTF-8")


def _boundaries(rules: DataFrame) -> DataFrame:
    """The points at which the innermost active rule changes: (key, active), where active is that rule or null.

    A rule holds from its key up to its key followed by byte FF, which no UTF-8 text contains. Two such intervals are
    nested or apart, so at the end of a rule the top of the stack becomes its parent, the longest other rule whose key
    is a prefix. Parents are found by an equi-join on the prefixes of the rule keys.
    """
    marked = rules.withColumn("_key", _key(F.split("host", r"\."), F.col("path"))).dropDuplicates(["_key"])
    rule = F.struct(F.length("_key").alias("n"), F.concat("host", "path").alias("rule"), "verdict")
    own = marked.select("_key", rule.alias("_rule"))
    prefixes = own.select("_key", F.explode(F.expr("transform(sequence(0, length(_key) - 1), i -> substring(_key, 1, i))")).alias("_prefix"))
    parents = (
        prefixes.join(own.select(F.col("_key").alias("_prefix"), F.col("_rule").alias("_outer")), "_prefix")
        .groupBy("_key").agg(F.max("_outer").alias("_outer"))
    )
    starts = own.select("_key", F.col("_rule").alias("active"))
    ends = own.join(parents, "_key", "left").select(F.concat("_key", F.lit(b"\xff")).alias("_key"), F.col("_outer").alias("active"))
    # a rule and its parent can end at different keys only, as the longer key sorts first
    return starts.unionByName(ends)


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", salts: int = 1024) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (null if none fits) and ``verdict`` (of the longest fitting rule, else ``default``).

    ``rules`` has host, path and verdict; a rule fits its host and all subdomains if the path starts with the rule's.
    Each url asks with one key per suffix of its host, up to the most labels of a rule. Urls are dealt to ``salts``
    groups whatever their host, and every group gets the boundaries of the rules; within a group a window sorts both
    and carries the last boundary forward, which is the top of the stack of active rules. All keys of a url meet in
    its group, so urls are shuffled once. Of rules with equal host and path one stays. Null and malformed urls have
    empty host and path and fit no rule; without rules every page gets the default. Input columns named host, path,
    rule or verdict are replaced; repeated pages are judged alike.
    """
    most = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 0
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    known = pages.select(*kept).withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    known = known.withColumn("_row", F.monotonically_increasing_id()).withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(salts)).cast("int"))
    labels = F.split("host", r"\.")
    depths = F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(most, 1))))
    asked = known.select("*", F.explode(depths).alias("_depth")).withColumn("_key", _key(F.slice(labels, F.size(labels) - F.col("_depth") + 1, F.col("_depth")), F.col("path")))
    events = asked.withColumn("_active", F.lit(None).cast("struct<n:int,rule:string,verdict:string>")).withColumn("_kind", F.lit(1))
    salted = _boundaries(rules).select("_key", F.col("active").alias("_active"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"), F.lit(0).alias("_kind"))
    sweep = Window.partitionBy("_salt").orderBy("_key", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    # a boundary always carries a struct, so that a boundary without active rule ends the one before it
    top = F.last(F.when(F.col("_kind") == 0, F.struct(F.col("_active").alias("rule"))), ignorenulls=True).over(sweep)
    swept = events.unionByName(salted, allowMissingColumns=True).withColumn("_top", top["rule"]).where("_kind = 1")
    found = swept.groupBy("_salt", "_row").agg(
        F.max("_top").alias("_best"), *[F.first(c).alias(c) for c in [*kept, "host", "path"]]
    )
    return found.select(
        *kept, "host", "path", F.col("_best.rule").alias("rule"), F.coalesce(F.col("_best.verdict"), F.lit(default)).alias("verdict")
    )
