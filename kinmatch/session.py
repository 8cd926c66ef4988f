"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, app: str = "kinmatch") -> SparkSession:
    """A single-machine session for tests and benchmarks. On a cluster the session comes from spark-submit."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


#: The temporary folder of this process, for local sessions without spark.checkpoint.dir.
_LOCAL: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only a local session without one gets a temporary folder, which is kept
    here: the setting cannot be changed in a running session."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = _LOCAL.get("root") or _LOCAL.setdefault("root", tempfile.mkdtemp(prefix="kinmatch-"))
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new, unused path below the checkpoint folder, visible to every executor."""
    return f"{checkpoint_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
