"""Popularity inside the categories a user has bought from."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import dealt, top_k
from gleaner.operators.candidates import item_weights
from gleaner.operators.daily import DailyCounts, counted
from gleaner.session import snapshot

# room for rounding when a bound on scores decides what can be skipped
_SLACK = 1e-9
# entries of a shelf that share a bound
_BLOCK = 64


@dataclass
class CategoryPopularity:
    """score(item) = sum over categories of (user's rows there) / (rank_constant + rank there)."""

    window_days: int | None = 90
    per_category: int = 2_000
    rank_constant: float = 60.0
    name = "category_popularity"
    item_categories: DataFrame | None = None
    pool: DataFrame | None = None
    shelves: DataFrame | None = None

    def ranked(self, interactions: DataFrame | DailyCounts, cutoff: int) -> DataFrame:
        """(category, item, pop, rn), the best items of each category in the window."""
        counts = counted(interactions, cutoff, self.window_days, "category_idx", "item_idx", name="pop")
        return top_k(counts, ["category_idx"], [F.desc("pop"), F.asc("item_idx")],
                     self.per_category, rank="rn", spread_by=["item_idx"])

    @staticmethod
    def membership(interactions: DataFrame | DailyCounts, cutoff: int) -> DataFrame:
        """(item, category) over all history: old items keep their category."""
        return counted(interactions, cutoff, None, "item_idx", "category_idx").drop("n")

    def fit(self, interactions: DataFrame | DailyCounts, cutoff: int) -> CategoryPopularity:
        self.item_categories = snapshot(self.membership(interactions, cutoff), "catpop-items")
        self.pool = snapshot(self.ranked(interactions, cutoff), "catpop-pool")
        self.shelves = snapshot(self._shelves(), "catpop-shelves")
        return self

    def stats(self) -> DataFrame:
        if self.pool is None:
            raise RuntimeError("fit() has not been called")
        return self.pool.agg(F.count(F.lit(1)).alias("pool_rows"),
                             F.countDistinct("category_idx").alias("categories"))

    def _shelves(self) -> DataFrame:
        """One row per category: its pool in two arrays, at most per_category entries together.

        `alone` holds the items of this pool only, by place. `shared` holds the others, with
        all the pools they sit in as `places`, in falling order of the score that an item can
        reach; `bounds` holds the highest of each block of _BLOCK of them.
        """
        where = (self.pool.groupBy("item_idx")
                 .agg(F.collect_list(F.struct("category_idx", "rn")).alias("places"))
                 .filter(F.size("places") > 1))
        entry = F.struct("rn", "item_idx", "places")
        single = F.col("places").isNull()
        # no item scores more per unit of weight than its pools times its best place allows here
        bound = F.size("places") / (F.lit(float(self.rank_constant)) + F.col("rn"))
        ordered = F.sort_array(F.collect_list(F.when(~single, F.struct((-bound).alias("_below"), entry.alias("e")))))
        firsts = F.filter("_shared", lambda e, n: n % _BLOCK == 0)
        return (self.pool.join(where, "item_idx", "left")
                .groupBy("category_idx")
                .agg(F.count(F.lit(1)).alias("size"), F.count("places").alias("shared_n"),
                     F.sort_array(F.collect_list(F.when(single, entry))).alias("alone"),
                     ordered.alias("_shared"))
                .select("category_idx", "size", "shared_n", "alone",
                        F.transform("_shared", lambda e: e["e"]).alias("shared"),
                        F.transform(firsts, lambda e: -e["_below"]).alias("bounds")))

    def _reach(self, taste: DataFrame, weights: DataFrame, k: int) -> DataFrame:
        """Adds `floor`, a score that a user's k-th best item reaches for certain, and the
        user's weights by category.

        With h history items, k of any k + h different pool items are unseen. So the floor is
        a score t that at least k + h pool entries reach: either all those of one category
        down to place k + h, or, usually higher, those of all categories together that score
        t, for the t at which their number should come to k + h. Entries shared by several
        pools are not counted, as they are the same item.
        """
        c, n, w, size = float(self.rank_constant), F.count(F.lit(1)), F.col("w"), F.col("size")
        user = Window.partitionBy("user_idx")
        lengths = weights.groupBy("user_idx").agg(F.count(F.lit(1)).alias("h"))
        sizes = self.shelves.select("category_idx", "size", "shared_n")
        deep = F.lit(k) + F.col("h")
        level = F.sum("w").over(user) / (deep + n.over(user) * F.lit(c + 1))
        reaching = F.least(F.greatest(F.floor(w / F.col("level") - F.lit(c)), F.lit(0)), size)
        one = F.max(F.when(size >= deep, w / (F.lit(c) + deep))).over(user)
        return (taste.join(sizes, "category_idx").join(lengths, "user_idx")
                .withColumn("level", level)
                .withColumn("floor", F.greatest(one, F.when(
                    F.sum(reaching - F.col("shared_n")).over(user) >= deep, F.col("level")))
                    - F.lit(_SLACK))
                .withColumn("tastes", F.map_from_entries(F.collect_list(
                    F.struct("category_idx", "w")).over(user)))
                .select("user_idx", "category_idx", "w", "floor", "tastes"))

    def recommend(self, histories: DataFrame, k: int, users: DataFrame | None = None) -> DataFrame:
        """Best k unseen items by the summed score.

        Users x categories x pool would be the largest table here, so entries that cannot
        reach the user's best k are not generated. The score of a generated entry is complete: it
        adds up the item's places in all of the user's categories.

        Entries stay in their user's partition until the list is made. Only history items that are
        in the pool matter there, so what is kept per user is bounded by the pool, not by the history.
        """
        if self.pool is None or self.item_categories is None:
            raise RuntimeError("fit() has not been called")
        weights = snapshot(item_weights(histories), "catpop-weights")
        seen = (weights.join(self.pool.select("item_idx").distinct(), "item_idx", "left_semi")
                .groupBy("user_idx").agg(F.collect_set("item_idx").alias("_seen")))
        best = (self.entries(weights, k).groupBy("user_idx", "item_idx")
                .agg(F.max("score").alias("score")))
        unseen = (best.join(seen, "user_idx", "left")
                  .filter(~F.coalesce(F.array_contains("_seen", F.col("item_idx")), F.lit(False))).drop("_seen"))
        return top_k(unseen, ["user_idx"], [F.desc("score"), F.asc("item_idx")], k)

    def entries(self, weights: DataFrame, k: int) -> DataFrame:
        """(user, item, score): all pool items that can be among a user's best k, some repeatedly.

        An item of p pools can only score the floor if its share in one of them is floor / p or
        more; blocks of shared entries whose bound is below that are skipped, and of the others
        only items are generated whose complete score reaches the floor.
        """
        c, w = float(self.rank_constant), F.col("w")
        taste = (weights.join(self.item_categories, "item_idx")
                 .groupBy("user_idx", "category_idx").agg(F.sum("m").alias("w")))
        bounded = F.coalesce(F.col("floor"), F.lit(0.0)) > 0
        # no more than this many entries of `alone` have a place good enough
        first = F.when(bounded, F.greatest(F.ceil(w / F.col("floor") - F.lit(c)), F.lit(0))) \
            .otherwise(F.size("alone")).cast("int")
        blocks = F.size(F.filter("bounds", lambda b: ~bounded | (b * w >= F.col("floor"))))

        def elsewhere(acc, place):
            return acc + F.coalesce(F.col("tastes")[place["category_idx"]], F.lit(0)) / (
                F.lit(c) + place["rn"])

        def whole(places):
            return F.aggregate(places, F.lit(0.0), elsewhere)

        shared = F.filter(F.slice("shared", F.lit(1), blocks * _BLOCK),
                          lambda e: ~bounded | (whole(e["places"]) >= F.col("floor")))
        score = F.when(F.col("places").isNull(), w / (F.lit(c) + F.col("rn"))).otherwise(whole(F.col("places")))
        return (self._reach(dealt(taste, "user_idx"), weights, k)
                .join(self.shelves.drop("size", "shared_n"), "category_idx")
                .select("user_idx", "w", "tastes", F.inline(F.concat(F.slice("alone", F.lit(1), first), shared)))
                .select("user_idx", "item_idx", F.round(score, 10).alias("score")))
