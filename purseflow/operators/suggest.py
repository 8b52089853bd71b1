"""Name suggestions by equality, prefix and containment, as equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from purseflow.functions.text import suggestion_key


def _prefixes(key: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(key)), lambda n: F.substring(key, F.lit(1), n))


def _substrings(key: Column) -> Column:
    starts = F.sequence(F.lit(1), F.length(key))
    return F.array_distinct(F.flatten(F.transform(starts, lambda s: F.transform(F.sequence(F.lit(1), F.length(key) - s + 1), lambda n: F.substring(key, s, n)))))


def suggest_names(queries: DataFrame, names: DataFrame, k: int = 5, allow_contains: bool = False) -> DataFrame:
    """(query, name, score, rank) for ``queries`` (query) and ``names`` (name, ord): score 0
    for equal keys, 1 if one begins with the other, 2 if one holds the other; ties by ord.

    Keys are joined with the prefixes (or substrings) of the other side's different keys,
    so there is no comparison of all pairs; names are short, and so are their lists."""
    q = queries.select("query", suggestion_key("query").alias("q")).where("q <> ''").distinct()
    n = names.select("name", "ord", suggestion_key("name").alias("n")).where("n <> ''")
    qs, ns = q.select("q").distinct(), n.select("n").distinct()
    parts = _substrings if allow_contains else _prefixes
    inside = qs.join(ns.select("n", F.explode(parts(F.col("n"))).alias("q")), "q")
    around = ns.join(qs.select("q", F.explode(parts(F.col("q"))).alias("n")), "n").select("q", "n")
    pairs = inside.select("q", "n").union(around).distinct()
    starts = F.col("n").startswith(F.col("q")) | F.col("q").startswith(F.col("n"))
    score = F.when(F.col("q") == F.col("n"), 0).when(starts, 1).otherwise(2)
    rows = q.join(pairs.withColumn("score", score), "q").join(n, "n")
    order = Window.partitionBy("query").orderBy("score", "ord")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "name", "score", "rank")
