"""Session helpers: a tuned local session, and the shared folder for cut lineage."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "rollmill", cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the library is tested with."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder; one of our own only where none is set.

    On a cluster ``spark.checkpoint.dir`` names a folder all executors share.  Off local masters
    there is no fallback: a folder of one machine would be lost with it, so ``ValueError`` is raised.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        if not context.getCheckpointDir():
            context.setCheckpointDir(named)
        return named
    if not context.getCheckpointDir():
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="rollmill-checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read back from there.

    Used where a result is read several times or a loop would grow the lineage; the
    files survive the loss of executors.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over enough partitions for heavy work per row.

    Input of few splits (small tables, files of one row group) is repartitioned; input that
    already has more splits than the cluster has cores, as any large one, is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(4 * cores) if df.rdd.getNumPartitions() < 4 * cores else df


_shipped: set[str] = set()


def ensure_on_workers(spark: SparkSession) -> None:
    """Make this package importable by the Python workers.

    Nothing is done where it lies on ``PYTHONPATH``, or in the working folder of a local session.
    Otherwise its sources are added to the session once, as a file Spark gives to every executor.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(package)
    near = {os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if root not in near and not (context.master.startswith("local[") and os.getcwd() == root):
        archive = os.path.join(tempfile.mkdtemp(prefix="rollmill-code-"), "rollmill.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for folder, _, names in os.walk(package):
                for name in names:
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        out.write(path, os.path.relpath(path, root))
        context.addPyFile(archive)
    _shipped.add(context.applicationId)
