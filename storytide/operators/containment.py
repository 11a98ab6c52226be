"""Which texts hold which terms, as substrings: joined on a rare run of letters instead of every text with every term."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import first_per

#: Characters of the runs that are indexed; shorter terms are runs of their own.
RUN = 3


def _runs(x: Column, size: Column) -> Column:
    """The distinct runs of `size` characters of a text that has as many."""
    return F.when(F.length(x) >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(x) - size + 1), lambda k: F.substr(x, k, size))))


def containing(texts: DataFrame, key: str, text: str, terms: DataFrame, term: str) -> DataFrame:
    """key, term: the texts and the terms that they hold, letter by letter, each pair once. An empty term is nowhere.

    Each term is looked up by the one of its runs of `RUN` characters that the fewest texts have, and compared with the
    texts that have it.
    """
    wanted = terms.select(F.col(term).alias("term")).where(F.length("term") > 0).distinct().withColumn("size", F.least(F.length("term"), F.lit(RUN)))
    sizes = sorted(r[0] for r in wanted.select("size").distinct().collect())  # RUN at most
    there = texts.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text IS NOT NULL")
    if not sizes:
        return there.select(F.col("key").alias(key), F.col("text").alias(term)).limit(0)
    index = there.select("key", F.explode(F.flatten(F.array_compact(F.array(*[_runs(F.col("text"), F.lit(s)) for s in sizes])))).alias("run"))
    counts = index.groupBy("run").agg(F.count("*").alias("df"))
    by_run = wanted.select("term", F.explode(_runs(F.col("term"), F.col("size"))).alias("run")).join(counts, "run", "left")
    rarest = first_per(by_run, ["term"], F.asc_nulls_first("df"), F.asc("run")).where("df IS NOT NULL").select("term", "run")
    met = rarest.join(index, "run").select("key", "term")
    return met.join(there, "key").where(F.contains("text", "term")).select(F.col("key").alias(key), F.col("term").alias(term))
