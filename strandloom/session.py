"""Session helpers: the shared folder, and cutting long lineages through it."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_paths: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only a local
    session that names none (tests, a notebook) gets a temporary folder.
    """
    sc = spark.sparkContext
    named = sc.getConf().get(SETTING, None) or spark.conf.get(SETTING, None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir() is None:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError(f"name a folder that all executors share in {SETTING}")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder partition by partition.

    Row order and partition numbers stay as they are, so a later job may rely
    on a range sort that was sampled once.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder; cuts the lineage.

    Smaller than a checkpoint, and later reads prune its columns; order and
    partition numbers do not survive. The table goes away when Python ends, or with :func:`release`.
    """
    spark = df.sparkSession
    path = scratch(spark)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(_read_schema(df, partition_by)).parquet(path)


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, which goes away as :func:`written` tables do."""
    path = f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    if not _paths:
        atexit.register(release, spark)
    _paths.append(path)
    return path


def _read_schema(df: DataFrame, partition_by: tuple[str, ...]):
    from pyspark.sql.types import StructType

    fields = [f for f in df.schema.fields if f.name not in partition_by]
    return StructType(fields + [df.schema[c] for c in partition_by])


def release(spark: SparkSession) -> None:
    """Drops all tables written so far: call it once results that rest on them are stored."""
    while _paths:
        path = _paths.pop()
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session is gone; the cluster's own cleaning takes over
            pass


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many tasks as there are cores, for work that costs far more than a shuffle.

    A large input already has more splits than cores and is left where it lies;
    a few big files that cannot be split would leave the other cores idle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
