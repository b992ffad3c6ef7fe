"""Item co-visitation: items bought by the same people, normalised by popularity."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import dealt, top_k
from gleaner.operators.candidates import drop_seen, item_weights
from gleaner.operators.splits import before
from gleaner.session import snapshot


@dataclass
class CoVisitation:
    window_days: int | None = 730
    max_items_per_user: int = 50
    top_n_neighbours: int = 100
    min_cooccurrence: int = 2
    name = "covisitation"
    graph: DataFrame | None = None
    lists: DataFrame | None = None

    def baskets(self, interactions: DataFrame, cutoff: int) -> DataFrame:
        """(user, items): every user's latest items, at most max_items_per_user of them.

        Equal times are ordered by item, so reruns agree. The limit is applied before the
        shuffle by user, and the arrays are built in the partitions it leaves.
        """
        rows = before(interactions, cutoff, self.window_days).select("user_idx", "item_idx", "ts")
        latest = top_k(rows, ["user_idx"], [F.desc("ts"), F.asc("item_idx")],
                       self.max_items_per_user, rank="_rank")
        return latest.groupBy("user_idx").agg(
            F.sort_array(F.collect_list("item_idx")).alias("items"))

    @staticmethod
    def recent(baskets: DataFrame) -> DataFrame:
        return baskets.select("user_idx", F.explode("items").alias("item_idx"))

    @staticmethod
    def popularity(baskets: DataFrame) -> DataFrame:
        return (baskets.select(F.explode("items").alias("item_idx"))
                .groupBy("item_idx").agg(F.count(F.lit(1)).alias("pop")))

    def pairs(self, baskets: DataFrame) -> DataFrame:
        """(lo, hi, cnt) with lo < hi.

        A basket's pairs are bounded by max_items_per_user, whatever the user did. They are
        counted on the map side, before the shuffle by pair; baskets are dealt out evenly first, as
        a small file of them makes very many pairs.
        """
        firsts = dealt(baskets, "user_idx").select("items", F.posexplode("items").alias("at", "lo"))
        later = F.slice("items", F.col("at") + 2, F.size("items"))
        return (firsts.select("lo", F.explode(later).alias("hi"))
                .filter(F.col("lo") < F.col("hi"))
                .groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("cnt"))
                .filter(F.col("cnt") >= self.min_cooccurrence))

    def neighbours(self, baskets: DataFrame) -> DataFrame:
        """(src, dst, score): the best neighbours of each item, both directions of each pair."""
        pop = snapshot(self.popularity(baskets), "covis-pop")
        scored = (self.pairs(baskets)
                  .join(pop.select(F.col("item_idx").alias("lo"), F.col("pop").alias("pop_lo")), "lo")
                  .join(pop.select(F.col("item_idx").alias("hi"), F.col("pop").alias("pop_hi")), "hi")
                  .withColumn("score", F.col("cnt") / F.sqrt(
                      F.col("pop_lo").cast("double") * F.col("pop_hi"))))
        both = scored.select("score", F.inline(F.array(
            F.struct(F.col("lo").alias("src"), F.col("hi").alias("dst")),
            F.struct(F.col("hi").alias("src"), F.col("lo").alias("dst")))))
        return top_k(both, ["src"], [F.desc("score"), F.asc("dst")], self.top_n_neighbours,
                     rank="_rank").select("src", "dst", "score")

    def fit(self, interactions: DataFrame, cutoff: int) -> CoVisitation:
        baskets = snapshot(self.baskets(interactions, cutoff), "covis-baskets")
        self.graph = snapshot(self.neighbours(baskets), "covis-graph")
        self.lists = snapshot(self.listed(self.graph), "covis-lists")
        return self

    @staticmethod
    def listed(graph: DataFrame) -> DataFrame:
        """One row per source: its neighbours in falling order of score, then by item, as one array
        of at most top_n_neighbours entries."""
        entry = F.struct((-F.col("score")).alias("below"), F.col("dst").alias("item_idx"))
        return graph.groupBy("src").agg(F.transform(
            F.sort_array(F.collect_list(entry)),
            lambda e: F.struct(e["item_idx"].alias("item_idx"), (-e["below"]).alias("score"))).alias("near"))

    def stats(self) -> DataFrame:
        if self.graph is None:
            raise RuntimeError("fit() has not been called")
        return self.graph.agg(F.count(F.lit(1)).alias("edges"),
                              F.countDistinct("src").alias("items_with_neighbours"))

    def recommend(self, histories: DataFrame, k: int, users: DataFrame | None = None) -> DataFrame:
        """Sum of neighbour scores over the history, unseen items only, best k.

        What moves to the join is a row per history item and a row per neighbour list; lists are
        opened behind it and added up before the shuffle by candidate. Sums are rounded before
        ranking, as their last digits depend on the order of addition.
        """
        if self.graph is None or self.lists is None:
            raise RuntimeError("fit() has not been called")
        weights = snapshot(item_weights(histories), "covisitation-weights")
        reached = (weights.join(self.lists, weights["item_idx"] == self.lists["src"])
                   .select("user_idx", "m", F.inline("near"))
                   .groupBy("user_idx", "item_idx")
                   .agg(F.sum(F.col("m") * F.col("score")).alias("score"))
                   .withColumn("score", F.round("score", 10)))
        return top_k(drop_seen(reached, weights), ["user_idx"],
                     [F.desc("score"), F.asc("item_idx")], k)
