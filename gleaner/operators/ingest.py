"""From raw reviews and item metadata to integer-encoded tables."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import day_of, global_positions, half_even, price_to_double, year_of
from gleaner.session import snapshot
from gleaner.sources.readers import read_reviews

# Accepted times in milliseconds, 1996-01-01 to 2024-01-01, both inclusive.
TIMESTAMP_MS_MIN = 820_454_400_000
TIMESTAMP_MS_MAX = 1_704_067_200_000
# Fixed value: cap of helpful votes, the largest 16-bit integer.
VOTE_CAP = 32_767
_EMPTY = "org.apache.spark.sql.execution.adaptive.AQEPropagateEmptyRelation"


def clean_reviews(raw: DataFrame, extra: Sequence[str] = (),
                  time_range: tuple[int, int] = (TIMESTAMP_MS_MIN, TIMESTAMP_MS_MAX),
                  null_vote: int | None = VOTE_CAP) -> DataFrame:
    """Keep complete rows with rating 1..5 and a plausible time; narrow the types.

    A missing helpful_vote becomes the cap, since the smaller of (null, cap) is the cap;
    pass `null_vote=None` to keep it missing or a number to replace it.
    """
    votes = F.least(F.col("helpful_vote"), F.lit(VOTE_CAP))
    if null_vote != VOTE_CAP:
        votes = F.when(F.col("helpful_vote").isNull(), F.lit(null_vote)).otherwise(votes)
    return (raw
            .filter(F.col("user_id").isNotNull() & F.col("parent_asin").isNotNull())
            .filter(F.col("rating").between(1, 5))
            .filter(F.col("timestamp").between(*time_range))
            .select("user_id", "parent_asin",
                    half_even(F.col("rating"), "tinyint").alias("rating"),
                    half_even(F.col("timestamp") / F.lit(1000.0), "bigint").alias("ts"),
                    votes.cast("smallint").alias("helpful_vote"),
                    "verified_purchase", "category", *extra))


def dense_ids(rows: DataFrame, key: str, idx: str, id_type: str = "int") -> DataFrame:
    """Distinct non-null keys numbered 0..n-1 in key order.

    The order makes reruns give the same numbers. More than 2^31 keys fail loudly under the
    default type; ask for `bigint` then.
    """
    keys = rows.select(key).filter(F.col(key).isNotNull()).distinct()
    return (global_positions(keys, [key], "_at", label=f"ids-{idx}")
            .select(key, F.col("_at").cast(id_type).alias(idx)))


def encode_dedupe(reviews: DataFrame, user_map: DataFrame, item_map: DataFrame,
                  category_map: DataFrame, tie_break: Sequence[str] = ()) -> DataFrame:
    """Integer-encode and keep the earliest interaction of each (user, item), with its year.

    Each attribute comes from the earliest row in which it is present. Equal times are
    ordered by `tie_break`, then by the attributes themselves, so the result is fixed.
    The group key is (user, item): rows of a very active user spread over all tasks.
    """
    attributes = ["rating", "helpful_vote", "verified_purchase", "category_idx"]
    encoded = (reviews
               .join(category_map, "category")
               .join(user_map, "user_id")
               .join(item_map, "parent_asin"))
    row = F.struct("ts", *tie_break, *attributes)
    # rating and category are always present, so the earliest row has them
    present = {name: F.min(F.when(F.col(name).isNotNull(), row)).alias(f"_{name}")
               for name in ("helpful_vote", "verified_purchase")}
    # rows of a struct are sorted to be combined; behind the shuffle that happens once, in its partitions
    return (encoded.repartition("user_idx", "item_idx").groupBy("user_idx", "item_idx")
            .agg(F.min(row).alias("_row"), *present.values())
            .select("user_idx", "item_idx", F.col("_row.rating").cast("tinyint").alias("rating"),
                    "_row.ts",
                    F.col("_helpful_vote.helpful_vote").cast("smallint").alias("helpful_vote"),
                    "_verified_purchase.verified_purchase",
                    F.col("_row.category_idx").cast("smallint").alias("category_idx"),
                    year_of(F.col("_row.ts")).alias("year")))


def ingest_stats(reviews: DataFrame, interactions: DataFrame) -> DataFrame:
    """One row: rows before and after de-duplication, cardinalities, first and last day."""
    raw = reviews.agg(F.count(F.lit(1)).alias("raw_rows"))
    kept = interactions.agg(
        F.count(F.lit(1)).alias("kept_rows"),
        F.countDistinct("user_idx").alias("n_users"),
        F.countDistinct("item_idx").alias("n_items"),
        F.countDistinct("category_idx").alias("n_categories"),
        day_of(F.min("ts")).alias("first_date"),
        day_of(F.max("ts")).alias("last_date"),
    )
    removed = F.try_divide(F.lit(100.0) * (F.col("raw_rows") - F.col("kept_rows")),
                           F.col("raw_rows"))
    return kept.select("*", raw.scalar().alias("raw_rows")).withColumn("removed_pct", removed)


def counted_reviews(spark: SparkSession, paths: Sequence[str], **options) -> tuple[DataFrame, DataFrame]:
    """Clean reviews of raw files, written down, and one row of counts from the same scan: lines,
    broken_lines, kept_rows and the percentage of lines that are gone.

    Lines are counted where they are read, kept rows where they leave the cleaning, so nothing is
    read twice. `options` are those of `clean_reviews`.
    """
    read, kept = Observation("lines"), Observation("kept")
    rows = clean_reviews(read_reviews(spark, paths, read), **options).observe(kept, F.count(F.lit(1)).alias("kept_rows"))
    # where no row is left, a plan that is cut down while it runs would lose the counts with it
    rule = "spark.sql.adaptive.optimizer.excludedRules"
    was = spark.conf.get(rule, "")
    spark.conf.set(rule, ",".join(filter(None, [was, _EMPTY])))
    try:
        reviews = snapshot(rows, "reviews")
    finally:
        spark.conf.set(rule, was) if was else spark.conf.unset(rule)
    counts = spark.range(1).select(*(F.lit(n).cast("bigint").alias(name) for name, n in (read.get | kept.get).items()))
    return reviews, counts.withColumn("removed_pct", F.try_divide(
        F.lit(100.0) * (F.col("lines") - F.col("kept_rows")), F.col("lines")))


def clean_metadata(raw: DataFrame) -> DataFrame:
    """Item metadata with a numeric price. Rating averages and counts are left out on
    purpose: they include reviews written after any cutoff."""
    return (raw.filter(F.col("parent_asin").isNotNull())
            .select("parent_asin", "main_category", "store",
                    price_to_double(F.col("price")).alias("price")))


def metadata_maps(metadata: DataFrame) -> dict[str, DataFrame]:
    return {
        "main_category": dense_ids(metadata, "main_category", "main_category_idx"),
        "store": dense_ids(metadata, "store", "store_idx"),
    }


def build_items(metadata: DataFrame, item_map: DataFrame,
                maps: Mapping[str, DataFrame]) -> DataFrame:
    """Attributes of the items that occur in the interaction table's own item map."""
    if item_map is None:
        raise ValueError("the item map written with the interaction table is needed")
    return (metadata.join(item_map, "parent_asin")
            .join(maps["main_category"], "main_category", "left")
            .join(maps["store"], "store", "left")
            .select("item_idx",
                    F.col("main_category_idx").cast("smallint").alias("main_category_idx"),
                    "store_idx", "price"))


def item_stats(metadata: DataFrame, items: DataFrame) -> DataFrame:
    """One row: matched and unmatched metadata, filled attributes, cardinalities."""
    raw = metadata.agg(F.count(F.lit(1)).alias("raw_rows"))
    found = items.agg(
        F.count(F.lit(1)).alias("matched_rows"),
        F.count("price").alias("with_price"),
        F.count("store_idx").alias("with_store"),
        F.countDistinct("main_category_idx").alias("n_categories"),
        F.countDistinct("store_idx").alias("n_stores"),
    )
    return (found.select("*", raw.scalar().alias("raw_rows"))
            .withColumn("unmatched_rows", F.col("raw_rows") - F.col("matched_rows"))
            .withColumn("match_rate", F.col("matched_rows") / F.greatest("raw_rows", F.lit(1))))
