"""Sessions, input tables and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings spider_query spider_database "
    "track race sample_sqls eval_item split_target subset_request"
).split()


def get_session(master: str | None = None, shuffle_partitions: int | None = None, app: str = "loomsql") -> SparkSession:
    """A session with the settings the dialect relies on. On a cluster leave ``master`` unset."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.timestampType", "TIMESTAMP_NTZ")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register_tables(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> None:
    """Register the input tables as temporary views under their own names."""
    for name in names or TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only a local session that names none (tests) gets one of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("a cluster must name a folder that all executors share in spark.checkpoint.dir")
        path = "file://" + tempfile.mkdtemp(prefix="loomsql-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


class Scratch:
    """Intermediate tables of one operator call, written as Parquet to the shared folder.

    A written table cuts the lineage and survives the loss of executors. ``drop`` removes a table that
    nothing will read again; what the returned DataFrame still reads is left to the owner of the folder.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = os.path.join(shared_dir(spark), f"loomsql-{label}-{uuid.uuid4().hex[:12]}")

    def path(self, name: str) -> str:
        return os.path.join(self.root, name)

    def write(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        writer = df.write.mode("overwrite").option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def let_workers_import(spark: SparkSession) -> None:
    """Puts the folder of this package on the path of Python workers, for sessions started without it there."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)
