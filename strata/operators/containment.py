"""Which texts contain which patterns: a posting table of n-grams joined by equality, then confirmed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZES = (8, 4, 2, 1)  # lengths of the n-grams; a pattern uses the longest that it can fill


def grams(text: Column, size: int) -> Column:
    """The distinct substrings of ``size`` characters; none of a shorter text."""
    places = F.sequence(F.lit(1), F.length(text) - size + 1)
    cut = F.array_distinct(F.transform(places, lambda at: F.substring(text, at, F.lit(size))))
    return F.when(F.length(text) >= size, cut).otherwise(F.array().cast("array<string>"))


def containing(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(text, pattern) of all pairs in which the text contains the pattern, from the only column of either frame.

    Every text is posted under its n-grams. A pattern asks under one n-gram only, the one that the fewest texts hold, so
    frequent parts such as a common prefix bring no candidates unless a pattern consists of nothing else; candidates are
    confirmed on the whole strings. The plan does not depend on the number of patterns. Repeated values count once, null
    takes no part; the empty pattern is in every text.
    """
    text, pattern = F.col(texts.columns[0]).alias("text"), F.col(patterns.columns[0]).alias("pattern")
    texts = texts.select(text).where("text IS NOT NULL").distinct()
    patterns = patterns.select(pattern).where("pattern IS NOT NULL").distinct()
    own = F.array(F.lit(""))
    for size in reversed(SIZES):
        own = F.when(F.length("pattern") >= size, grams(F.col("pattern"), size)).otherwise(own)
    asked = patterns.select("pattern", F.explode(own).alias("gram"))
    held = F.concat(F.array(F.lit("")), *[grams(F.col("text"), size) for size in SIZES])
    posted = texts.select("text", F.explode(held).alias("gram")).join(asked.select("gram").distinct(), "gram", "left_semi")
    counts = posted.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = (
        asked.join(counts, "gram", "left")
        .groupBy("pattern")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("least"))
        .where("least.n > 0")
        .select("pattern", F.col("least.gram").alias("gram"))
    )
    return posted.join(rarest, "gram").where(F.contains("text", "pattern")).select("text", "pattern")
