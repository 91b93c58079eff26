"""Session construction and the shared scratch folder.

Scratch data (derived files, stream checkpoints, lineage cuts) always goes
under ``spark.checkpoint.dir`` — on a cluster that is the shared folder the
operator configured. Only when the session has none (local runs, tests) do
we create a private temporary one.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(master: str | None = None, shuffle_partitions: int = 16, app_name: str = "aeris",
                  advisory_partition_bytes: str = "128m", driver_memory: str | None = None) -> SparkSession:
    """A session with the settings every job here assumes.

    * session time zone UTC: wall-clock NTZ times and the oracle agree;
    * AQE on, with partition coalescing and skew-join splitting, so hot keys
      (one station or country holding a third of the rows) are split at run
      time and small join sides are broadcast only after their size is known;
    * Spark UI off (no server).

    ``master`` and ``driver_memory`` are left to the cluster's own settings unless given.

    On a cluster pass a generous ``shuffle_partitions`` (e.g. a few per core of
    the whole cluster): AQE coalesces small partitions at run time towards
    ``advisory_partition_bytes``, so large stages get enough tasks to stay in
    memory and small ones do not pay for empty tasks.
    """
    builder = SparkSession.builder
    if master is not None:
        builder = builder.master(master)
    if driver_memory is not None:
        builder = builder.config("spark.driver.memory", driver_memory)
    return (
        builder.appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", advisory_partition_bytes)
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder, created privately only when none is configured.

    Reads ``spark.checkpoint.dir`` from the session (or the context's checkpoint
    directory). Works with classic and Spark Connect sessions; the latter have
    no SparkContext, so only the configuration is consulted there.
    """
    root = spark.conf.get(_CHECKPOINT_KEY, None)
    sc = None
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: no driver-side context
        sc = None
    if not root and sc is not None:
        jdir = sc._jsc.sc().getCheckpointDir()
        root = jdir.get() if jdir.isDefined() else None
    if not root and sc is not None and sc.master.split("[")[0] != "local":
        raise RuntimeError(f"set {_CHECKPOINT_KEY} to a folder that all executors share")
    if not root:
        # local runs and tests only: no shared folder was configured
        root = tempfile.mkdtemp(prefix="aeris-ckpt-")
        if sc is None:
            return root
        sc.setCheckpointDir(root)
        return sc._jsc.sc().getCheckpointDir().get()
    if sc is not None and not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder below the checkpoint root for one job's files."""
    return os.path.join(checkpoint_root(spark), f"{name}-{uuid.uuid4().hex[:12]}")




def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet under the shared checkpoint folder and read it back.

    Cuts the lineage like ``checkpoint()`` (survives executor loss: the data is
    in shared storage, not on executors), but computes the plan once and stores
    it columnar, so later reads prune columns and push filters.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)

