"""Join helpers.  No broadcast hints: the planner and AQE broadcast a side only
when its size in bytes, from the plan's statistics or measured at run time, is
below ``spark.sql.autoBroadcastJoinThreshold``; else the join shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_members(posts: DataFrame, members: DataFrame, key: str, member_key: str | None = None) -> DataFrame:
    """Rows of ``posts`` whose ``key`` is in the id list (left-semi join).
    Both sides are compared as strings (P14), so a list read from csv matches
    numeric ids.  A semi join needs no ``distinct``: duplicates in the list
    cannot multiply rows."""
    ids = members.select(F.col(member_key or key).cast("string").alias("__member")).where(F.col("__member").isNotNull())
    return posts.join(ids, F.col(key).cast("string") == F.col("__member"), "left_semi")
