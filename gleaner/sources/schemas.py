"""Read schemas. Only the fields that are used; title, text and images are never parsed out."""
from pyspark.sql import types as T

REVIEW_SCHEMA = T.StructType([
    T.StructField("user_id", T.StringType()),
    T.StructField("parent_asin", T.StringType()),
    T.StructField("rating", T.DoubleType()),
    T.StructField("timestamp", T.LongType()),
    T.StructField("helpful_vote", T.LongType()),
    T.StructField("verified_purchase", T.BooleanType()),
])

METADATA_SCHEMA = T.StructType([
    T.StructField("parent_asin", T.StringType()),
    T.StructField("main_category", T.StringType()),
    T.StructField("store", T.StringType()),
    # "$12.99", 12.99, "None" and "" all occur
    T.StructField("price", T.StringType()),
])
