"""Joins by keys of which few may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT = 1000


def dealt_join(rows: DataFrame, keys: DataFrame, on: list[str], total: int, by: list[str], how: str = "left_semi") -> DataFrame:
    """``rows`` joined with ``keys``, which tell in ``n`` how many rows have the key.

    A key with over a thousandth of the ``total`` rows is dealt to several tasks, by the columns
    ``by``. Fewer than 1000 keys can be that frequent, so these are broadcast; rows of ``keys``
    are repeated for each task of their key only. Null keys join nothing.
    """
    hot = F.col("n") * HOT > total
    parts = F.ceil(F.col("n") * HOT / F.lit(max(total, 1)))
    left = rows.join(F.broadcast(keys.where(hot).select(*on, parts.alias("parts")).distinct()), on, "left")
    left = left.withColumn("part", F.coalesce(F.pmod(F.xxhash64(*by), "parts"), F.lit(0))).drop("parts")
    right = keys.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.when(hot, parts).otherwise(1) - 1)))
    return left.join(right.select(*on, "part") if how == "left_semi" else right, [*on, "part"], how).drop("part")
