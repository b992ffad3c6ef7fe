"""The engine's relations made from an order warehouse (lineitem, orders, part, events)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import seconds_of, year_of
from gleaner.operators.splits import TimeSplit

# Split of the warehouse's order dates, 1995-01-01 to 2001-08-01.
WAREHOUSE_SPLIT = TimeSplit.of("2000-06-01", "2000-12-01", "2001-08-02")

# Category names in code order.
CATEGORY_NAMES = {
    "p_type": ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"),
    "o_orderpriority": ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"),
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def purchases(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order line with its buyer, day and product category."""
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag")
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    parts = table(spark, folder, "part").select("p_partkey", "p_type")
    return (lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(parts, F.col("l_partkey") == F.col("p_partkey")))


def raw_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines in the shape of raw reviews; line 7 stands for ratings out of range."""
    return purchases(spark, folder).select(
        F.concat(F.lit("U"), F.lpad(F.col("o_custkey").cast("string"), 10, "0")).alias("user_id"),
        F.concat(F.lit("P"), F.lpad(F.col("l_partkey").cast("string"), 10, "0")).alias("parent_asin"),
        F.when(F.col("l_linenumber") == 7, F.lit(9.0))
        .otherwise(1.0 + F.col("l_linenumber") * 0.5).alias("rating"),
        (seconds_of(F.col("o_orderdate")) * 1000 + F.pmod("l_orderkey", F.lit(1000)))
        .alias("timestamp"),
        F.when(F.col("l_linenumber") != 2, F.col("l_quantity") * 1000).cast("bigint")
        .alias("helpful_vote"),
        F.when(F.col("l_returnflag") != "N", F.col("l_returnflag") == "A")
        .alias("verified_purchase"),
        F.col("p_type").alias("category"), "l_orderkey", "l_linenumber")


def raw_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """Parts in the shape of raw item metadata, with prices as text of several kinds."""
    price = F.format_number(F.col("p_retailprice"), 2)
    kind = F.pmod(F.col("p_partkey"), F.lit(5))
    return table(spark, folder, "part").select(
        F.concat(F.lit("P"), F.lpad(F.col("p_partkey").cast("string"), 10, "0")).alias("parent_asin"),
        F.when(kind != 4, F.col("p_type")).alias("main_category"),
        F.when(kind != 3, F.col("p_brand")).alias("store"),
        F.when(kind == 0, F.lit("None")).when(kind == 1, F.lit(""))
        .otherwise(F.concat(F.lit("$"), price)).alias("price"))


def interactions(spark: SparkSession, folder: str, category: str = "p_type") -> DataFrame:
    """(user, item) pairs at their first purchase.

    `category` is the product type, or o_orderpriority, under which an item falls into
    several categories.
    """
    code = F.array_position(F.lit(list(CATEGORY_NAMES[category])), F.col(category)) - 1
    rows = purchases(spark, folder).select(
        F.col("o_custkey").cast("int").alias("user_idx"),
        F.col("l_partkey").cast("int").alias("item_idx"),
        seconds_of(F.col("o_orderdate")).alias("ts"), "l_orderkey", "l_linenumber",
        F.col("l_quantity").cast("smallint").alias("helpful_vote"),
        (F.col("l_returnflag") != "R").alias("verified_purchase"),
        code.cast("smallint").alias("category_idx"))
    kept = ["helpful_vote", "verified_purchase", "category_idx"]
    # read off the line's number, so it is not moved with the rows
    rating = (1 + F.pmod(F.col("_first.l_linenumber") - 1, F.lit(5))).cast("tinyint").alias("rating")
    # rows of a struct are sorted to be combined; behind the shuffle that happens once, in its partitions
    return (rows.repartition("user_idx", "item_idx").groupBy("user_idx", "item_idx")
            .agg(F.min(F.struct("ts", "l_orderkey", "l_linenumber", *kept)).alias("_first"))
            .select("user_idx", "item_idx", F.col("_first.ts").alias("ts"), rating,
                    *[F.col(f"_first.{c}").alias(c) for c in kept])
            .withColumn("year", year_of(F.col("ts"))))


def items(spark: SparkSession, folder: str) -> DataFrame:
    """Item attributes: brand number as store, product type as category."""
    types = F.lit(list(CATEGORY_NAMES["p_type"]))
    return table(spark, folder, "part").select(
        F.col("p_partkey").cast("int").alias("item_idx"),
        (F.array_position(types, F.col("p_type")) - 1).cast("smallint").alias("main_category_idx"),
        F.regexp_replace("p_brand", "Brand#", "").cast("int").alias("store_idx"),
        F.col("p_retailprice").alias("price"))


def event_interactions(spark: SparkSession, folder: str) -> DataFrame:
    """A second source: users and the key `k` of their events."""
    events = table(spark, folder, "events")
    return events.select(
        F.col("user_id").cast("int").alias("user_idx"),
        F.get_json_object("props", "$.k").cast("int").alias("item_idx"),
        seconds_of(F.col("ts")).alias("ts"), F.col("event_type").alias("category"))
