"""Session construction and shared-storage helpers.

The master is never hard coded here: ``spark-submit`` (or the caller)
supplies it.  Only tests and ``bench.py`` pass ``master`` explicitly.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

# SQL settings every vigilo job relies on.  They are runtime (session)
# settings, so they are also re-applied to a session we did not build.
RUNTIME_CONF = {
    # Re-plan at runtime: coalesce small shuffle partitions, split skewed
    # join partitions, switch to broadcast when a side turns out small.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Rows go to Python workers in batches bounded in bytes as well as in number.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
    # Lenient JSON: a repeated key keeps its last value (message parsing).
    "spark.sql.variant.allowDuplicateKeys": "true",
}


MB = 1 << 20


def cluster_profile(input_bytes: int, executors: int = 1000, cores_per_executor: int = 8
                    ) -> dict[str, str]:
    """Settings for a large cluster, sized from the bytes a job reads.

    * shuffle partitions: about 256 MB of input per partition before AQE
      coalesces (the default 200 would make 500 GB partitions at 100 TB),
      at least two waves of tasks;
    * scan splits of 256 MB (about 400k scan tasks for 100 TB);
    * AQE coalesces to 256 MB and splits skewed join partitions;
    * failure tolerance: task retries, decommissioning with shuffle and
      cache block migration, so a lost executor costs a retry, not the job.
    """
    slots = executors * cores_per_executor
    partitions = max(2 * slots, min(1_000_000, input_bytes // (256 * MB)))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * MB),
        "spark.sql.files.maxPartitionBytes": str(256 * MB),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 * MB),
        "spark.sql.autoBroadcastJoinThreshold": str(64 * MB),
        "spark.task.maxFailures": "8",
        "spark.stage.maxConsecutiveAttempts": "8",
        "spark.decommission.enabled": "true",
        "spark.storage.decommission.enabled": "true",
        "spark.storage.decommission.shuffleBlocks.enabled": "true",
        "spark.storage.decommission.rddBlocks.enabled": "true",
        "spark.sql.streaming.minBatchesToRetain": "100",
    }


def apply_runtime_conf(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def build_session(master: str | None = None, app: str = "vigilo",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None,
                  driver_memory: str | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **RUNTIME_CONF,
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master and master.startswith("local"):
        # local mode: driver and executors share this one heap.
        conf["spark.driver.memory"] = driver_memory or os.environ.get("VIGILO_DRIVER_MEMORY", "12g")
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return apply_runtime_conf(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared (HDFS/object
    store) folder and is used as is; without it a cluster run fails here,
    since executors cannot see a folder of the driver's machine.  Only on a
    local master (runs on one machine, tests) is a private one created; it
    is deleted when the process ends.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="vigilo-ckpt-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


_SCRATCH: set[str] = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared checkpoint folder.

    Used for sinks, stream checkpoints and round-trip checks, so that every
    executor (and a restarted driver) can see what was written.  The
    application's own scratch folder is deleted when its driver ends.
    """
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/vigilo/{spark.sparkContext.applicationId}"
    if base not in _SCRATCH:
        where = spark._jvm.org.apache.hadoop.fs.Path(base)
        fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(where)
        fs.deleteOnExit(where)
        _SCRATCH.add(base)
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")
