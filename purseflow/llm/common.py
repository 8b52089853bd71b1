"""Small helpers that the operators of this folder share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Classes up to which a sample's shares are broadcast, so that rows outside it are dropped where they are read.
BROADCAST_CLASSES = 1 << 17
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores in front until no column of ``df`` has it, in upper or lower case."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        found.append(name)
    return found


def fold(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; null keys count as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % parts


def _unit(key: str, seed: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def bounded_sample(rows: DataFrame, key: str, classes: str, per_class: int, seed: int = 7) -> DataFrame:
    """At most ``per_class`` rows of each class, and all if there are no more: those with the
    smallest hashes of their key, repeated keys by the hash of the row. Deterministic; the
    bound holds at any size, and only about twice as many rows are ranked."""
    shares = rows.where(F.col(classes).isNotNull()).groupBy(F.col(classes).alias("__class")).agg((F.lit(float(2 * per_class)) / F.count("*")).alias("__share"))
    if shares.count() <= BROADCAST_CLASSES:  # else both sides are shuffled
        shares = F.broadcast(shares)
    some = rows.join(shares, F.col(classes) == F.col("__class")).where(_unit(key, seed) < F.col("__share")).select(*rows.columns)
    order = Window.partitionBy(classes).orderBy(F.xxhash64(key, F.lit(seed)), key, F.xxhash64(*rows.columns))
    return some.withColumn("__place", F.row_number().over(order)).where(F.col("__place") <= per_class).drop("__place")


def few_rows(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """At most ``n`` rows, those with the smallest hashes of their key; only about twice as many are sorted."""
    total = rows.count()
    some = rows.where(_unit(key, seed) < 2 * n / max(1, total))
    return some.orderBy(F.xxhash64(key, F.lit(seed)), key, F.xxhash64(*rows.columns)).limit(n)
