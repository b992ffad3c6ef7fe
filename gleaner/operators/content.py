"""Content: same store, same category, similar price. Reaches items nobody has bought yet."""
from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import global_positions, top_k
from gleaner.operators.candidates import drop_seen, item_weights
from gleaner.operators.daily import DailyCounts, counted
from gleaner.session import snapshot

# functions sent to the workers travel with the plan; the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values of the score.
STORE_SIGNAL = 2.0       # an item of a store the user bought from
CATEGORY_DAMPING = 3.0   # category signal w / (w + 3)
PRICE_BONUS = 0.5        # price within the tolerance of the user's median

# Grades of the stores' counts: the places of all pools' entries in the order of the lists, by equal
# parts of their logarithm, and price by eighths of octaves. Finer ones leave fewer entries above a
# floor; any grades give the same lists. Popularity itself would be no grade: where it is spread
# evenly, most of a pool is of one.
LEVELS, PRICES_AN_OCTAVE = 40, 8
UNIT = 5_040             # an item with r metadata rows counts as UNIT / r for each of them, rounded down
_EDGE = 1e-9             # a price this near to a bound of the band is not counted


@dataclass
class Content:
    items: DataFrame                  # item_idx, main_category_idx, store_idx, price
    per_store: int = 200
    per_category: int = 400
    cold_slots: int = 50
    price_tolerance: float = 0.5
    dedupe_items: bool = False        # keep one candidate where metadata repeats an item
    name = "content"
    catalogue: DataFrame | None = None
    stores: DataFrame | None = None
    stores_shelf: DataFrame | None = None
    stores_depth: DataFrame | None = None
    categories: DataFrame | None = None

    def with_popularity(self, interactions: DataFrame | DailyCounts, cutoff: int) -> DataFrame:
        """Attributes plus the number of interactions before the cutoff; 0 marks a cold item."""
        pop = counted(interactions, cutoff, None, "item_idx", name="pop")
        return (self.items.join(pop, "item_idx", "left")
                .select("item_idx", "main_category_idx", "store_idx", "price",
                        F.coalesce("pop", F.lit(0).cast("bigint")).alias("pop")))

    def store_pool(self, catalogue: DataFrame) -> DataFrame:
        """Per store: the most popular items, plus reserved places for cold ones.

        Taken as two top-k selections, each cut before its shuffle; a store that owns a
        large part of the catalogue is ranked in parts.
        """
        listed = (catalogue.filter(F.col("store_idx").isNotNull())
                  .select("store_idx", "item_idx", "price", "pop"))
        warm = top_k(listed, ["store_idx"], [F.desc("pop"), F.asc("item_idx"), F.asc("price")],
                     self.per_store, rank="_rank", spread_by=["item_idx"])
        cold = top_k(listed.filter(F.col("pop") == 0), ["store_idx"],
                     [F.asc("item_idx"), F.asc("price")],
                     self.cold_slots, rank="_rank", spread_by=["item_idx"])
        return warm.unionByName(cold).drop("_rank").distinct()

    def _shelf(self) -> DataFrame:
        """One row per store: its pool as an array of at most per_store + cold_slots entries.

        `level` grades the entry's place among those of all pools, in the order in which equal
        scores are listed. `weight` is what it counts: an item's rows come to one item at most.
        """
        rows = self.catalogue.groupBy("item_idx").agg(F.count(F.lit(1)).alias("rows"))
        placed = global_positions(self.stores.withColumn("_less", -F.col("pop")), ["_less", "item_idx", "price", "store_idx"],
                                  "_at", "content-order")
        last = F.log2(F.greatest(self.stores.agg(F.count(F.lit(1))).scalar(), F.lit(2)).cast("double"))
        level = F.floor(LEVELS * (1 - F.log2(F.col("_at") + F.lit(1.0)) / last))
        entry = F.struct("item_idx", "price", "pop",
                         F.greatest(F.least(level, F.lit(LEVELS - 1)), F.lit(0)).cast("int").alias("level"),
                         F.floor(F.lit(UNIT) / F.col("rows")).alias("weight"))
        return (placed.join(rows, "item_idx")
                .groupBy("store_idx").agg(F.collect_list(entry).alias("entries")))

    def _depth(self) -> DataFrame:
        """(store, first, width, listed, grid): the weights of a store's entries, summed up.

        `listed` holds for each level the weight of entries of that level or higher. `grid` holds,
        level by level, the same by price: the weight of those up to each of `width` price
        grades, the lowest being `first`. So the weight in any price band from any level on is
        the difference of two places.
        """
        cells = F.transform(F.filter("entries", lambda e: e["weight"] > 0), lambda e: F.struct(
            e["level"].alias("level"), e["weight"].alias("weight"), F.when(e["price"] > 0, _grade(e["price"])).alias("grade")))
        own = self.stores_shelf.select("store_idx", cells.alias("cells")).filter(F.size("cells") > 0)
        priced = F.filter("cells", lambda c: c["grade"].isNotNull())
        kind = own.schema["store_idx"].dataType.simpleString()
        return own.select("store_idx", F.col("cells.level").alias("level"), F.col("cells.weight").alias("weight"),
                          priced["level"].alias("priced_level"), priced["weight"].alias("priced_weight"),
                          priced["grade"].alias("grade")).mapInPandas(
            _summed, f"store_idx {kind}, first int, width int, listed array<bigint>, grid array<bigint>")

    def category_pool(self, catalogue: DataFrame) -> DataFrame:
        listed = (catalogue.filter(F.col("main_category_idx").isNotNull())
                  .select("main_category_idx", "item_idx", "price", "pop"))
        return top_k(listed, ["main_category_idx"],
                     [F.desc("pop"), F.asc("item_idx"), F.asc("price")],
                     self.per_category, rank="_rank", spread_by=["item_idx"]).drop("_rank")

    def fit(self, interactions: DataFrame | DailyCounts, cutoff: int) -> Content:
        self.catalogue = snapshot(self.with_popularity(interactions, cutoff), "content-items")
        self.stores = snapshot(self.store_pool(self.catalogue), "content-stores")
        self.stores_shelf = snapshot(self._shelf(), "content-shelves")
        self.stores_depth = snapshot(self._depth(), "content-depths")
        self.categories = snapshot(self.category_pool(self.catalogue), "content-categories")
        return self

    def stats(self) -> DataFrame:
        if self.catalogue is None:
            raise RuntimeError("fit() has not been called")
        return self.catalogue.agg(
            F.count(F.lit(1)).alias("items_with_attributes"),
            F.count_if(F.col("pop") == 0).alias("cold_items"),
        ).select("*", self.stores.agg(F.count(F.lit(1))).scalar().alias("store_pool_rows"),
                 self.categories.agg(F.count(F.lit(1))).scalar().alias("category_pool_rows"))

    def profile(self, weights: DataFrame) -> DataFrame:
        """(user, store, category, price, m, items): attributes of the history, with the number
        of its rows and of its metadata rows."""
        return (weights.join(self.catalogue.drop("pop"), "item_idx")
                .groupBy("user_idx", "store_idx", "main_category_idx", "price")
                .agg(F.sum("m").alias("m"), F.count(F.lit(1)).alias("items")))

    @staticmethod
    def median_prices(profile: DataFrame) -> DataFrame:
        """Exact median price per user, from (user, price) counts."""
        counts = (profile.filter(F.col("price").isNotNull())
                  .groupBy("user_idx", "price").agg(F.sum("m").alias("m")))
        return counts.groupBy("user_idx").agg(F.percentile("price", 0.5, F.col("m")).alias("med_price"))

    def _needs(self, own: DataFrame, k: int) -> DataFrame:
        """(user, floor, wide_floor, full): how much of the user's store pools can matter.

        If h of the items in the user's stores are in the history, k unseen ones are among any
        k + h different items. `floor` is a level at which the pools hold that many in the
        price band: the best k are then in the band and of that level or higher. `wide_floor` is a
        level at which they hold that many at any price: the best k are then in the band, or of that
        level or higher. `full` says that the pools hold that many at all: a category candidate
        scores under 1.5 and a store item 2 or more, so none is needed. Entries
        count by their weights, which for the rows of one item come to one at most.

        The counts are read off the stores' sums, a row for each (user, store) and two places for
        each level; no shelf is opened. Price grades that are only partly in the band are not counted,
        so a floor may be lower than it could be, never higher.
        """
        med, tol = F.col("med_price"), self.price_tolerance
        low = F.ceil(_octaves(med * (1 - tol) * (1 + _EDGE))).cast("int") if tol < 1 else F.col("first")
        high = (F.floor(_octaves(med * (1 + tol) * (1 - _EDGE))) - 1).cast("int")
        width = F.col("width")

        def below(level: int, at: Column) -> Column:
            place = F.least(at - F.col("first"), width - 1)
            return F.when(place >= 0, F.get("grid", F.lit(level) * width + place)).otherwise(0)

        zero = F.lit(0)
        counted = own.join(self.stores_depth, "store_idx", "left").withColumns({"low": low, "high": high}).select(
            "user_idx", "h",
            *(F.coalesce(F.get("listed", F.lit(n)), zero).alias(f"any{n}") for n in range(LEVELS)),
            *(F.coalesce(F.when((med > 0) & (F.col("high") >= F.col("low")),
                                below(n, F.col("high")) - below(n, F.col("low") - 1)), zero).alias(f"near{n}")
              for n in range(LEVELS)))
        totals = counted.groupBy("user_idx").agg(F.sum("h").alias("h"), *(
            F.sum(f"{kind}{n}").alias(f"{kind}{n}") for kind in ("any", "near") for n in range(LEVELS)))
        enough = (F.lit(k) + F.col("h")) * UNIT

        def highest(kind: str) -> Column:
            return F.greatest(*(F.when(F.col(f"{kind}{n}") >= enough, n) for n in range(LEVELS)))

        return totals.select("user_idx", highest("near").alias("floor"), highest("any").alias("wide_floor"),
                             (F.col("any0") >= enough).alias("full"))

    def opened(self, own: DataFrame, needs: DataFrame) -> DataFrame:
        """Store entries that can be among a user's best k, the one place where shelves are opened."""
        def wanted(entry: Column) -> Column:
            near = F.coalesce(self._near(entry["price"]), F.lit(False))
            return F.when(F.col("floor").isNotNull(), (entry["level"] >= F.col("floor")) & near).otherwise(
                F.col("wide_floor").isNull() | (entry["level"] >= F.col("wide_floor")) | near)

        return (own.join(needs, "user_idx", "left").join(self.stores_shelf, "store_idx")
                .select("user_idx", "med_price", F.inline(F.filter("entries", wanted))))

    def _near(self, price: Column) -> Column:
        return (F.abs(price - F.col("med_price"))
                <= F.col("med_price") * F.lit(self.price_tolerance))

    def recommend(self, histories: DataFrame, k: int, users: DataFrame | None = None) -> DataFrame:
        """Best signal per candidate plus a price bonus; unseen items, best k.

        Ties go to the more popular item, then the smaller id, then the smaller price. Only
        candidates that can be among a user's best k are generated. Writes four tables that it
        reads several times, so jobs run before the result is used.
        """
        if self.catalogue is None:
            raise RuntimeError("fit() has not been called")
        weights = item_weights(histories)
        profile = snapshot(self.profile(weights), "content-profile")
        medians = snapshot(self.median_prices(profile), "content-medians")
        # a user's stores lie together, so their wide rows of counts add up before they are shuffled
        own = snapshot(profile.filter(F.col("store_idx").isNotNull())
                       .groupBy("user_idx", "store_idx").agg(F.sum("items").alias("h"))
                       .repartition("user_idx").join(medians, "user_idx", "left"), "content-user-stores")
        needs = snapshot(self._needs(own, k), "content-needs")

        by_store = self.opened(own, needs).withColumn("signal", F.lit(STORE_SIGNAL))
        served = needs.filter("full").select("user_idx")
        by_category = (profile.filter(F.col("main_category_idx").isNotNull())
                       .groupBy("user_idx", "main_category_idx").agg(F.sum("m").alias("w"))
                       .join(served, "user_idx", "left_anti")
                       .join(medians, "user_idx", "left")
                       .join(self.categories, "main_category_idx")
                       .withColumn("signal", F.col("w") / (F.col("w") + F.lit(CATEGORY_DAMPING))))
        columns = ["user_idx", "item_idx", "price", "med_price", "pop", "signal"]
        key = ["user_idx", "item_idx"] + ([] if self.dedupe_items else ["price"])
        bonus = F.when(self._near(F.col("price")), F.lit(PRICE_BONUS)).otherwise(F.lit(0.0))
        pooled = (by_store.select(*columns).unionByName(by_category.select(*columns))
                  .withColumn("score", F.col("signal") + bonus))
        best = pooled.groupBy(*key).agg(F.max("score").alias("score"), F.max("pop").alias("pop"))
        order = [F.desc("score"), F.desc("pop"), F.asc("item_idx")]
        if not self.dedupe_items:
            order.append(F.asc("price"))
        return (top_k(drop_seen(best, weights), ["user_idx"], order, k)
                .select("user_idx", "rank", "item_idx", "score", "pop"))


def _summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The sums of `_depth`, a store at a time; a store has at most per_store + cold_slots entries."""
    for pdf in batches:
        rows = []
        for store, level, weight, priced_level, priced_weight, grade in pdf.itertuples(index=False):
            listed = np.zeros(level.max() + 1, np.int64)
            np.add.at(listed, level, weight)
            first = width = grid = None
            if len(grade):
                first, width = int(grade.min()), int(grade.max() - grade.min() + 1)
                grid = np.zeros((len(listed), width), np.int64)
                np.add.at(grid, (priced_level, grade - first), priced_weight)
                grid = grid[::-1].cumsum(axis=0)[::-1].cumsum(axis=1).ravel()
            rows.append((store, first, width, listed[::-1].cumsum()[::-1], grid))
        yield pd.DataFrame(rows, columns=["store_idx", "first", "width", "listed", "grid"]).astype(
            {"first": "Int32", "width": "Int32"})


def _octaves(price: Column) -> Column:
    return F.lit(PRICES_AN_OCTAVE) * F.log2(price)


def _grade(price: Column) -> Column:
    return F.floor(_octaves(price)).cast("int")
