"""What the operators of this package share: session settings, batches, written tables."""
from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gleaner.session import prepare, snapshot

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Texts differ in length by five orders of magnitude, so batches are bounded by bytes too.
BATCH_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


def ready(spark: SparkSession) -> SparkSession:
    prepare(spark)
    for key, value in BATCH_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{folder}/{name}.parquet")


def by_value(name: str) -> None:
    """Functions of module `name` travel with the plan; executors need not have it installed."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


def share(spark: SparkSession, value) -> Callable:
    """Send `value` once to each executor; the result gives it back there.

    It is pickled here with its classes by value, as a broadcast alone would only name them.
    """
    sent, opened = spark.sparkContext.broadcast(cloudpickle.dumps(value)), []

    def get():
        if not opened:
            opened.append(cloudpickle.loads(sent.value))
        return opened[0]

    return get


def map_columns(df: DataFrame, schema: str,
                make: Callable[[dict[str, list]], dict[str, list] | None]) -> DataFrame:
    """Apply `make` to each Arrow batch as lists by column name.

    One batch is in memory at a time. A result may have any number of rows; None is no row.
    """
    target = T.StructType.fromDDL(schema)
    names = target.names
    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            out = make({n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)})
            if out is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[n], type=arrow.field(n).type) for n in names], schema=arrow)

    return df.mapInArrow(run, schema)


def map_groups(df: DataFrame, keys: list[str], schema: str,
               make: Callable[[dict[str, list]], dict[str, list] | None]) -> DataFrame:
    """Apply `make` to all rows of each group of `keys`, as lists by column name.

    For groups of bounded size only. Many small groups cost little, as rows are cut into
    groups while they stream through in sorted order.
    """
    target = T.StructType.fromDDL(schema)
    arrow, columns = to_arrow_schema(target), df.columns
    at = [columns.index(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows, out = None, [], {n: [] for n in target.names}

        def close():
            made = make({c: [r[i] for r in rows] for i, c in enumerate(columns)}) if rows else None
            for n in target.names if made else ():
                out[n].extend(made[n])

        def flush():
            batch = pa.RecordBatch.from_arrays(
                [pa.array(out[n], type=arrow.field(n).type) for n in target.names], schema=arrow)
            for n in target.names:
                out[n].clear()
            return batch

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                key = tuple(row[i] for i in at)
                if key != group:
                    close()
                    group, rows = key, []
                rows.append(row)
            if out[target.names[0]]:
                yield flush()
        close()
        yield flush()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def components(links: DataFrame, label: str, rounds: int = 60) -> DataFrame:
    """Connected components of links (a, b): node and root, the smallest node reachable.

    In each round every node points at the smallest of itself and its neighbours, pointers are
    followed to their ends, and the links move to those ends; links inside one component
    vanish. A node that is not smaller than all its neighbours is gone after the round, so
    few rounds are needed, also for long chains. Tables are written between rounds; only
    whether links are left reaches the driver. Nodes without links are not in the result.
    """
    links = snapshot(links.select("a", "b").filter("a <> b").distinct(), f"{label}-links")
    points = None
    for _ in range(rounds):
        if links.isEmpty():
            break
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = snapshot(both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("node"), F.least("a", "m").alias("root")), f"{label}-low")
        while True:
            ahead = low.select(F.col("node").alias("root"), F.col("root").alias("next"))
            low = snapshot(low.join(ahead, "root").select(
                "node", F.col("next").alias("root"), (F.col("next") < F.col("root")).alias("moved")),
                f"{label}-low")
            still = not low.filter("moved").isEmpty()
            low = low.drop("moved")
            if not still:
                break
        if points is None:
            points = low
        else:
            points = snapshot(points.join(low.select(F.col("node").alias("root"), F.col("root").alias("next")),
                                          "root", "left")
                              .select("node", F.coalesce("next", "root").alias("root")), f"{label}-points")
        links = snapshot(
            links.join(low.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
            .join(low.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
            .filter("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(),
            f"{label}-links")
    else:
        raise RuntimeError(f"components not finished after {rounds} rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")) if points is None else points
