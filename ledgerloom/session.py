"""Session builder and the cluster-aware checkpoint helper."""

from __future__ import annotations

import atexit
import contextlib
import logging
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "ledgerloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, AQE and Arrow. `conf` overrides any setting.

    Shuffle partitions stay at AQE's mercy: the initial number is the only fixed value and AQE
    coalesces it to `advisoryPartitionSizeInBytes` at run time.
    """
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (base | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def logger(name: str) -> logging.Logger:
    """A logger to standard error with time and level; asked for again, it is the same one. LEDGERLOOM_LOG sets the level."""
    log = logging.getLogger(name)
    if not log.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        log.addHandler(handler)
        log.setLevel(os.environ.get("LEDGERLOOM_LOG", "INFO").upper())
    return log


def settings_from(path: str) -> dict[str, str]:
    """Spark settings of a file of KEY=VALUE lines; comments, blank lines and outer quotes don't count, and the environment has the last word."""
    found = {}
    with open(path, encoding="utf-8") as lines:
        for line in lines:
            key, sign, value = line.strip().partition("=")
            if sign and not key.startswith("#"):
                found[key.strip()] = os.environ.get(key.strip(), value.strip().strip("\"'"))
    return found


def shared_folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`, which every executor reaches.

    Only where that is unset on a local master (tests, notebooks) one of our own is used. On a cluster
    without it this is an error, since a machine-local folder would not survive the loss of an executor.
    """
    context = spark.sparkContext
    if (found := context.getCheckpointDir()) is not None:
        return found
    named = context.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not (context.master.startswith("local[") or context.master == "local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share: this job cuts lineage there")
        named = os.path.join(tempfile.gettempdir(), "ledgerloom-checkpoints")
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Cuts lineage with a Parquet table in the shared folder: compressed, and read by column.

    The table is kept until the application ends or `release` is called.
    """
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _own_folder(spark: SparkSession) -> str:
    if spark.sparkContext.applicationId not in _STORED:
        _STORED.add(spark.sparkContext.applicationId)
        atexit.register(release, spark)
    return f"{shared_folder(spark).rstrip('/')}/stored-{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Deletes the application's stored tables; results that read them must have been written before."""
    context = spark.sparkContext
    with contextlib.suppress(Exception):  # at exit the JVM may be gone already
        if context._jsc is None or context._jsc.sc().isStopped():
            return
        _delete(context)


def _delete(context) -> None:
    path = context._jvm.org.apache.hadoop.fs.Path(f"{context.getCheckpointDir().rstrip('/')}/stored-{context.applicationId}")
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


_STORED: set[str] = set()
