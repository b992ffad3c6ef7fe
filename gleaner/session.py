"""Session settings and the shared folder for intermediate tables."""
from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# SQL settings the operators rely on. All of them can be changed at run time,
# so a session made elsewhere gets them too.
SQL_CONF = {
    # years and dates are taken from unix seconds
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # short user lists fan out into many candidates, so small partitions are worth keeping
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    # lists, histories and pairs of ids pack to a few bytes a row, so partitions of the usual 64 and
    # 128 MB hold many millions of rows, whose sorts and sums spill; at these a task's memory stays level
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    "spark.sql.files.maxPartitionBytes": "16m",
    # a key that holds a large share of a join's rows is split over tasks, even
    # where that costs one more shuffle afterwards
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # per-group top-k is cut before the shuffle; the default stops at k = 1000
    "spark.sql.optimizer.windowGroupLimitThreshold": "20000",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings above to a running session."""
    for key, value in SQL_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build_session(app: str = "gleaner", master: str | None = None,
                  conf: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SQL_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, named by `spark.checkpoint.dir` or the checkpoint folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return folder


def snapshot(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Cuts the lineage in a way that survives lost executors. Reading the table back also
    gives the optimizer its true size, so a join against it is broadcast only when it is
    small, and its shuffle can be split when one key dominates the other side.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Remove what `snapshot` has written, where nothing will read it any more."""
    spark = table.sparkSession
    for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


# while `passing`: shuffles go with their job, and a message waits in no batch much larger than itself
_PASSING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
            "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """For tables written in here: their shuffles are removed with the job, and large rows go to Python in
    small batches."""
    before = {key: spark.conf.get(key) for key in _PASSING}
    for key, value in _PASSING.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
