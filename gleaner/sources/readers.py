"""Scans: raw JSON lines, the interaction table, maps and attribute tables."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.sources.schemas import METADATA_SCHEMA, REVIEW_SCHEMA


def category_paths(spark: SparkSession, folder: str, categories: Sequence[str],
                   prefix: str = "") -> list[str]:
    """One gzip JSON-lines file or folder per category; fails with the names of all missing ones.

    Only names are listed, by a scan that reads no content.
    """
    names = [f"{prefix}{category}.jsonl.gz" for category in categories]
    if not names:
        raise ValueError("at least one category is needed")
    listed = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
              .select("path"))
    wanted = F.explode(F.array(*map(F.lit, names))).alias("name")
    there = (spark.range(1).select(wanted)
             .join(listed, F.regexp_like("path", F.concat(F.lit("/"), F.col("name"), F.lit("(/|$)"))), "left_semi"))
    missing = sorted(set(names) - {r["name"] for r in there.collect()})
    if missing:
        raise FileNotFoundError(f"{len(missing)} source files are missing: {missing}")
    return [f"{folder}/{n}" for n in names]


_BROKEN = "_broken_line"
_ENDING = ".jsonl.gz"


def _lines(spark: SparkSession, paths: Sequence[str], schema: T.StructType,
           counted: Observation | None) -> DataFrame:
    """JSON lines, the unreadable ones as rows of nulls; what cannot be read of a line is null.

    `counted` gets `lines`, those that are not blank, and `broken_lines` from the scan itself.
    """
    rows = (spark.read.schema(T.StructType([*schema, T.StructField(_BROKEN, T.StringType())])).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", _BROKEN).json(list(paths)))
    if counted is not None:
        rows = rows.observe(counted, F.count(F.lit(1)).alias("lines"), F.count(_BROKEN).alias("broken_lines"))
    return rows.drop(_BROKEN)


def read_reviews(spark: SparkSession, paths: Sequence[str], counted: Observation | None = None) -> DataFrame:
    """Raw reviews with the category taken from the file name. Unreadable lines are rows of
    nulls, which cleaning drops; `counted` tells how many there are.

    A gzip file can only be parsed by one task; the parsed rows are dealt out evenly right
    behind it. The name is that of the file, or of the folder that holds a category's files.
    """
    return _spread(_lines(spark, paths, REVIEW_SCHEMA, counted).withColumn(
        "category", _category(F.col("_metadata.file_path"))))


def _category(path: Column) -> Column:
    """Name before `.jsonl.gz` in the folder's name, else in the file's; '' if in neither.

    It is taken from every row, where a pattern and decoding cost three times what the line itself
    does: the ends of the two names are looked at, and only names with escapes are decoded.
    """
    def bare(name: Column) -> Column:
        return F.when(name.endswith(_ENDING) & (F.length(name) > len(_ENDING)),
                      F.substring(name, F.lit(1), F.length(name) - len(_ENDING)))

    file = F.substring_index(path, "/", -1)
    folder = F.substring_index(F.substring_index(path, "/", -2), "/", 1)
    name = F.coalesce(bare(folder), bare(file), F.lit(""))
    return F.when(name.contains("%") | name.contains("+"), F.url_decode(name)).otherwise(name)


def read_metadata(spark: SparkSession, paths: Sequence[str], counted: Observation | None = None) -> DataFrame:
    return _spread(_lines(spark, paths, METADATA_SCHEMA, counted))


def _spread(rows: DataFrame) -> DataFrame:
    return rows.hint("rebalance")


def read_interactions(spark: SparkSession, folder: str) -> DataFrame:
    """The interaction table; `year` comes from the folder names."""
    return spark.read.parquet(folder)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A map or attribute table."""
    return spark.read.parquet(path)


def source_inventory(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Files under the given paths with size and modification time, and a digest of each entry.

    The files are listed, not read.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
             .select(F.col("path").alias("file_path"), F.col("length").alias("file_size"),
                     F.col("modificationTime").alias("modified")).distinct())
    return files.withColumn("entry_sha256", F.sha2(F.concat_ws(
        "|", "file_path", F.col("file_size").cast("string"),
        F.unix_micros("modified").cast("string")), 256))


def inventory_digest(inventory: DataFrame) -> DataFrame:
    """One row: number of files, bytes, and one digest of all entries in the order of paths."""
    entries = F.array_sort(F.collect_list(F.struct("file_path", "entry_sha256")))
    return inventory.agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes"),
        F.sha2(F.array_join(F.transform(entries, lambda e: e["entry_sha256"]), "\n"), 256)
        .alias("inventory_sha256"))
