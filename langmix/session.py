"""Session helpers: a tuned local session for tests/bench, and the shared
folder used to cut lineage (``spark.checkpoint.dir``)."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "langmix") -> SparkSession:
    """Session for local runs. On a cluster, build the session from the
    cluster's own settings and only call :func:`ensure_checkpoint_dir`."""
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or max(8, cpus * 2)
    spark = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("LANGMIX_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder.

    The cluster names it in ``spark.checkpoint.dir``; we only invent one
    when it is unset *and* the master is local (tests, bench)."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="langmix-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location (never a
    machine-local temp folder on a cluster)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/scratch/{name}-{uuid.uuid4().hex[:12]}"


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``langmix`` importable in the Python workers of this session.

    Operators that run Python on executors (model plug-ins, the JSON
    source) pickle references to this package; ``addPyFile`` of a zip of
    its sources distributes it, whatever the driver's working directory or
    the executors' environment. Done once per SparkContext."""
    import zipfile

    import langmix

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(langmix.__file__))
    zpath = os.path.join(tempfile.mkdtemp(prefix="langmix-code-"), "langmix.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(zpath)
    _SHIPPED.add(sc.applicationId)


SMALL_INPUT_BYTES = 1 << 30


def input_bytes(df: DataFrame) -> int:
    """Size estimate of a plan from Catalyst statistics: for a file scan it
    is the listed file size, already known to the driver (no extra I/O)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame, key: str | None = None, limit: int = SMALL_INPUT_BYTES) -> DataFrame:
    """Spread a *small* scan over all cores. A file written as one row group
    is read by one task however it is split; below ``limit`` bytes a hash
    repartition on ``key`` costs little and buys full parallelism. Large
    inputs already arrive in many splits and are left alone (no shuffle)."""
    spark = df.sparkSession
    n = spark.sparkContext.defaultParallelism
    if input_bytes(df) >= limit:
        return df
    return df.repartition(n, key) if key else df.repartition(n)


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: writes to the shared folder and cuts lineage,
    so a lost executor never forces recomputation of the upstream plan."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str = "stored") -> DataFrame:
    """Rows written once to the shared folder as columns, and read back: cuts
    lineage as :func:`materialize` does, and later uses read only the columns
    they need. Order and partitions aren't kept."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
