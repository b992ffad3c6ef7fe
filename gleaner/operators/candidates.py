"""Steps shared by the scoring channels."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def item_weights(histories: DataFrame) -> DataFrame:
    """History as (user, item, m): repeats are counted before any join fans them out."""
    return histories.groupBy("user_idx", "item_idx").agg(F.count(F.lit(1)).alias("m"))


def drop_seen(candidates: DataFrame, weights: DataFrame) -> DataFrame:
    """Remove items of the user's own history. Keyed by (user, item), so no user is a hot key."""
    return candidates.join(weights.select("user_idx", "item_idx"), ["user_idx", "item_idx"],
                           "left_anti")
