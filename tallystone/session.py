"""Session settings and the shared folder used for tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
# Tables this session has stored, for release().
STORED: list[str] = []


def configure(spark: SparkSession) -> SparkSession:
    """Runtime settings every job relies on. Only sets what a session may change late."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tallystone")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        # Call-site capture costs a round trip per Column; plans here have thousands.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. A local session without one gets a temporary folder.

    On a cluster a folder of one machine would hold a part of each table, so there it must be set.
    """
    folder = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(
        CHECKPOINT_CONF
    )
    if not folder and not spark.sparkContext.master.startswith("local["):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that the driver and all executors share")
    if not folder:
        folder = tempfile.mkdtemp(prefix="spark-tallystone-", dir="/tmp")
        spark.conf.set(CHECKPOINT_CONF, folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write a result that several steps read to the shared folder and read it back.

    The lineage ends at the files, so a lost executor rereads them instead of recomputing,
    and later steps see their real size and prune their columns, or folders of ``partition_by``.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.partitionBy(*partition_by).parquet(path)
    STORED.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the tables stored so far, once their results have been read or written."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    while STORED:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(STORED.pop())
        path.getFileSystem(hadoop).delete(path, True)


def spread(scan: DataFrame) -> DataFrame:
    """Use every core when a scan has fewer splits than cores; larger scans stay as they are.

    For file scans only: counting the partitions of a plan with shuffles would run it.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
