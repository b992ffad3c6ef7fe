"""Recent popularity: one ranked pool for everyone, minus what each user has seen."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import int_array
from gleaner.operators.daily import DailyCounts, counted

# the pool is a constant of the plan; about a megabyte at most
LARGEST_POOL = 100_000


@dataclass
class Popularity:
    window_days: int | None = 90
    pool_size: int = 2_000
    name = "popularity"
    pool: list[int] | None = None

    def ranked(self, interactions: DataFrame | DailyCounts, cutoff: int) -> DataFrame:
        """Pool items with their counts, most frequent first, ties by item."""
        return (counted(interactions, cutoff, self.window_days, "item_idx")
                .orderBy(F.desc("n"), "item_idx").limit(self.pool_size))

    def fit(self, interactions: DataFrame | DailyCounts, cutoff: int) -> Popularity:
        if not 0 < self.pool_size <= LARGEST_POOL:
            raise ValueError(f"pool_size must lie between 1 and {LARGEST_POOL}")
        # at most pool_size ids
        self.pool = [row["item_idx"] for row in self.ranked(interactions, cutoff).collect()]
        return self

    def recommend(self, histories: DataFrame, k: int, users: DataFrame | None = None) -> DataFrame:
        """First k unseen pool items per user.

        Only history items that are in the pool matter, so what is kept per user is bounded
        by the pool, not by the history; one shuffle, and no user x pool table.
        """
        if not self.pool:
            raise RuntimeError("fit() has not been called, or found no items")
        # pool_size rows at most
        table = (histories.sparkSession.range(1)
                 .select(F.explode(int_array(self.pool)).alias("_pool_item")))
        seen = (histories.select("user_idx", "item_idx")
                .join(table, F.col("item_idx") == F.col("_pool_item"), "left")
                .groupBy("user_idx").agg(F.collect_set("_pool_item").alias("_seen")))
        if users is not None:
            seen = users.select("user_idx").join(seen, "user_idx", "left")
        taken = F.coalesce("_seen", F.array().cast("array<int>"))
        unseen = F.array_except(F.slice(int_array(self.pool), F.lit(1), F.lit(k) + F.size(taken)), taken)
        return (seen.select("user_idx", F.posexplode(F.slice(unseen, 1, k)))
                .select("user_idx", (F.col("pos") + 1).alias("rank"),
                        F.col("col").alias("item_idx")))
