"""Session helpers: a tuned local session for tests and the checkpoint folder."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(cores: int | str = "*", shuffle_partitions: int | None = None,
              app: str = "liftlab") -> SparkSession:
    """Local session used by tests, bench and the smoke entry point.

    On a cluster, build the session with the cluster's own settings and pass
    it to the operators instead; nothing in the library requires this helper.
    """
    parts = shuffle_partitions or (os.cpu_count() if cores == "*" else int(cores))
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, taken from the session.

    ``spark.checkpoint.dir`` names the shared folder on a cluster. Only when
    it is unset and the master is local (tests) is a scratch folder created.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if re.fullmatch(r"local(\[[^\]]*\])?", sc.master) is None:  # local-cluster is a cluster
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder "
            "(HDFS/S3/ABFS) before running ranking operators on a cluster")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="liftlab-ckpt-"))
    return sc.getCheckpointDir()


def drop_checkpoint(df: DataFrame) -> None:
    """Delete the files of a checkpointed table that nothing reads any more.

    Clusters rarely set the cleaner that would delete them with the session.
    """
    found = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if found.isDefined():
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(found.get())
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def small_table(df: DataFrame) -> DataFrame:
    """Compute a result table once and keep it as a local relation.

    Only for tables whose row count the specification fixes (per outcome,
    feature, band, decile, check): later reads do not recompute the plan, and
    the table no longer depends on the files behind it (checkpoints, staging
    folders). Tables that grow with the data, such as those per level, stay distributed.
    """
    return df.sparkSession.createDataFrame(df.collect(), df.schema)
