"""Development samples: whole users, chosen by hash."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import hash_bucket

SCALE = 1_000_000


def sample_users(interactions: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """All rows of a hashed share of the users, ids unchanged. A filter; nothing is shuffled."""
    if not 0 < fraction < 1:
        raise ValueError(f"fraction must lie between 0 and 1, got {fraction}")
    if fraction * SCALE < 1:
        raise ValueError(f"fraction is in steps of 1/{SCALE}; {fraction} would choose nobody")
    return interactions.filter(hash_bucket("user_idx", seed, SCALE) < int(fraction * SCALE))


def sample_stats(interactions: DataFrame, sample: DataFrame) -> DataFrame:
    """One row: users, interactions and items of the sample, and the source's sizes."""
    source_rows = interactions.agg(F.count(F.lit(1)))
    source_users = interactions.agg(F.countDistinct("user_idx"))
    return (sample.agg(F.count(F.lit(1)).alias("interactions"),
                       F.countDistinct("user_idx").alias("users"),
                       F.countDistinct("item_idx").alias("items"))
            .select("*", source_rows.scalar().alias("source_interactions"),
                    source_users.scalar().alias("source_users"))
            .withColumn("actual_user_fraction",
                        F.col("users") / F.greatest("source_users", F.lit(1))))
