"""Session helpers: building a session, the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int = 8, app: str = "fundscope") -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE, Arrow, no UI)."""
    builder = SparkSession.builder.master(master) if master else SparkSession.builder  # else spark-submit's
    spark = (
        builder.appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


_LOCAL_SCRATCH: dict[int, str] = {}


def checkpoint_base(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder (``spark.checkpoint.dir``, read from the session).

    A session on one machine (``local[...]``, as in tests) that names none gets a scratch folder, once per
    context; on a cluster that is an error.
    ``spark.checkpoint.dir`` is a static setting, so it is never written here.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None)
    if conf:
        return conf
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir is not set: name a folder that all machines share")
    key = id(spark.sparkContext)
    if key not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[key] = tempfile.mkdtemp(prefix="fundscope-ckpt-")
    return _LOCAL_SCRATCH[key]


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Make ``DataFrame.checkpoint()`` write to the shared checkpoint folder; returns that folder."""
    base = checkpoint_base(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder, for written intermediate tables and stream state."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"
