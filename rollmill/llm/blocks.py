"""Equality joins on blocking keys of which some may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def grid_join(a: DataFrame, b: DataFrame, key: str, a_id: str, b_id: str, block: int = 1_000) -> DataFrame:
    """``a.join(b, key)``, every pair once, with no task that holds all pairs of a hot key.

    A key of more than ``block`` x ``block`` pairs is joined in a grid: each side is cut into parts
    of about ``block`` rows by the hash of its id, and every part meets every part of the other
    side.  ``block`` changes the plan, not the pairs.  NULL keys join nothing.
    """
    sides = a.select(key, F.lit(1).alias("na"), F.lit(0).alias("nb")).unionByName(b.select(key, F.lit(0).alias("na"), F.lit(1).alias("nb")))
    counts = sides.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    many = counts.where(F.col("na") * F.col("nb") > block * block)
    hot = cut(many.select(key, F.ceil(F.col("na") / block).alias("parts_a"), F.ceil(F.col("nb") / block).alias("parts_b")))
    if hot.isEmpty():
        return a.join(b, key)

    def grid(side: DataFrame, name: str, own: str, other: str) -> DataFrame:
        """Each row in its own part, once per part of the other side."""
        parts = lambda n: F.coalesce(n, F.lit(1).cast("bigint"))
        placed = side.join(hot, key, "left")
        return placed.select(*side.columns, F.pmod(F.xxhash64(name), parts(F.col(own))).alias(own), F.explode(F.sequence(F.lit(0).cast("bigint"), parts(F.col(other)) - 1)).alias(other))

    ga, gb = grid(a, a_id, "parts_a", "parts_b"), grid(b, b_id, "parts_b", "parts_a")
    return ga.join(gb, [key, "parts_a", "parts_b"]).drop("parts_a", "parts_b")


def grid_self_join(df: DataFrame, key: str, id_col: str, block: int = 1_000) -> DataFrame:
    """``df`` joined with itself on ``key`` as ``a`` and ``b``, every ordered pair once, as ``grid_join``.

    Without hot keys both sides are one exchange.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    hot = cut(counts.where(F.col("n") > block).select(key, F.ceil(F.col("n") / block).alias("parts")))
    if hot.isEmpty():
        return df.alias("a").join(df.alias("b"), F.col(f"a.{key}") == F.col(f"b.{key}"))
    placed = df.join(hot, key, "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("bigint"))).withColumn("own", F.pmod(F.xxhash64(id_col), F.col("parts")))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("other")
    a, b = placed.select(*df.columns, "own", other), placed.select(*df.columns, "own", other)
    on = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.own") == F.col("b.other")) & (F.col("a.other") == F.col("b.own"))
    return a.alias("a").join(b.alias("b"), on)
