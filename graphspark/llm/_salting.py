"""Joins of rows with a table of groups in which one group may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_groups(rows: DataFrame, groups: DataFrame, key: str, per_key: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``groups`` (one row a key, with ``n``, the key's number of rows) by ``key``; ``n`` goes.

    A key of more than ``per_key`` rows is dealt over as many sub-keys as its rows need. What is broadcast for that has at
    most one row for each ``per_key`` rows of the table. A row's sub-key follows its place in the partitions of ``rows``,
    which must be a written table (or a scan of one), so that a task that runs again deals alike.
    """
    parts = F.ceil(F.col("n") / per_key).cast("int")
    heavy = groups.where(F.col("n") > per_key).select(key, parts.alias("__parts"))
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("__parts"))
    dealt = rows.join(F.broadcast(heavy), key, "left").withColumn("__part", F.coalesce(place, F.lit(0)).cast("int")).drop("__parts")
    spread = groups.withColumn("__part", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1))).drop("n")
    return dealt.join(spread, [key, "__part"], how).drop("__part")
