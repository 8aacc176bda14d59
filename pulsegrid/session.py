"""Session settings the library relies on, and the shared folder for cut lineages."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: str = "8", shuffle_partitions: int = 8, memory: str = "20g") -> SparkSession:
    """A single-machine session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pulsegrid")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to the folder named by spark.checkpoint.dir, which all executors share.

    Only where that setting is absent and the master is local (tests on one machine) a temporary folder takes its place; on a
    cluster without the setting this raises, since a folder of one machine is out of the others' reach. Set
    spark.cleaner.referenceTracking.cleanCheckpoints so that files vanish with the frames that hold them.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get(CHECKPOINT_KEY) or df.sparkSession.conf.get(CHECKPOINT_KEY, None)
        if not folder and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="pulsegrid-checkpoint-"))
    return df.checkpoint(eager=True)
