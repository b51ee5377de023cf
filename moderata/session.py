"""Session settings and the shared staging folder.

Staged tables and checkpoints go under ``spark.checkpoint.dir``. Only a local
session without that setting (tests, the bench) gets a scratch folder; on a
cluster a missing setting is an error.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job of the package expects (UTC for NTZ/date arithmetic,
# ANSI left on, AQE for runtime coalescing, broadcast and skew splitting).
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.python.filterPushdown.enabled": "true",
}


# Recommended on a large cluster (set in the cluster's own configuration; not
# forced by this package). Most shuffles here carry partially aggregated rows,
# but exact distinct counts, duplicate detection and uuid multiplicity shuffle
# about one row per input row: size the shuffle for those (~256 MB per task)
# and let AQE coalesce the small post-aggregation shuffles.
CLUSTER_CONF = {
    "spark.sql.shuffle.partitions": "8000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.session.timeZone": "UTC",
}


_SHIPPED: set[str] = set()


def _package_zip() -> bytes:
    import io
    import zipfile

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
        for dirpath, dirnames, filenames in os.walk(pkg_dir):
            dirnames[:] = sorted(d for d in dirnames if d != "__pycache__")
            for name in sorted(filenames):
                if name.endswith(".py"):
                    full = os.path.join(dirpath, name)
                    info = zipfile.ZipInfo(os.path.relpath(full, root), date_time=(2020, 1, 1, 0, 0, 0))
                    with open(full, "rb") as fh:
                        zf.writestr(info, fh.read())
    return buf.getvalue()


def ship_package(spark: SparkSession) -> None:
    """Make ``moderata`` importable in the executors' Python workers.

    ``mapInPandas`` functions are pickled by reference to this package, so a
    worker must be able to import it. The package is zipped in memory,
    written once (content-addressed) under the shared ``spark.checkpoint.dir``
    folder and distributed with ``addPyFile``; on a cluster with the package
    installed this is harmless.
    """
    import hashlib

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    data = _package_zip()
    digest = hashlib.sha1(data).hexdigest()[:16]
    path = f"{checkpoint_dir(spark)}/moderata-pkg/{digest}/moderata.zip"
    # Driver-side write through Spark's own Hadoop FileSystem (any scheme the
    # cluster is configured for): temp name, then rename.
    jvm = sc._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(target):
        tmp = jvm.org.apache.hadoop.fs.Path(f"{path}.inprogress-{os.getpid()}")
        out = fs.create(tmp, True)
        out.write(bytearray(data))
        out.close()
        if not fs.rename(tmp, target) and not fs.exists(target):
            raise OSError(f"could not publish {path}")
    sc.addPyFile(str(fs.makeQualified(target).toString()))
    _SHIPPED.add(app)


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "moderata", extra: dict | None = None) -> SparkSession:
    """Local session for tests and the bench; on a cluster use the cluster's own."""
    b = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("MODERATA_DRIVER_MEMORY", "8g"))
        # Local only: list many directories with a few tasks per core instead of
        # one tiny task per directory (a cluster keeps its own setting).
        .config("spark.sql.sources.parallelPartitionDiscovery.parallelism", str(max(8, 4 * shuffle_partitions)))
        # Remove reliable-checkpoint files once their DataFrame is gone.
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for k, v in {**SESSION_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a local session without one gets a scratch folder.

    Returns the configured base folder (Spark itself checkpoints into a
    per-context sub-folder of it). Off a local master a missing setting is an
    error: a machine-local folder would lose data that other executors wrote.
    """
    sc = spark.sparkContext
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(conf)
        return conf.rstrip("/")
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    base = tempfile.mkdtemp(prefix="moderata-ckpt-")
    sc.setCheckpointDir(base)
    return (sc.getCheckpointDir() or base).rstrip("/")


def stage_root(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written intermediate tables."""
    return f"{checkpoint_dir(spark)}/moderata-stage/{name}"
