"""Session helpers: building a session for tests/bench and finding shared storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "tillscope",
                  extra: dict | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.autoBroadcastJoinThreshold", str(10 * 1024 * 1024))
        .config("spark.driver.memory", "16g")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster-shared folder named by ``spark.checkpoint.dir``.

    On a cluster this setting must name shared storage, and an unset one is an
    error: executors could not see each other's files in a local folder. Only a
    local master (tests, a laptop) gets a private folder, which is registered so
    that ``DataFrame.checkpoint`` and our layer tables land in the same place.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext._jsc.sc().getCheckpointDir()
        d = d.get() if d.isDefined() else None
    if not d:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder shared by all executors (master {master})")
        d = tempfile.mkdtemp(prefix="tillscope-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    jsc = spark.sparkContext._jsc.sc()
    if not jsc.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(d)
    return d


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/tillscope/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unique location below the shared folder (and this application's part of it) for one written table."""
    return f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def drop_intermediates(spark: SparkSession) -> bool:
    """Delete every table this application wrote below the shared folder (``fresh_path``).

    For the end of a job: results that still read these tables must be written elsewhere first.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def local_path(path: str) -> str:
    return path[len("file:"):] if path.startswith("file:") else path


__all__ = ["build_session", "shared_dir", "fresh_path", "drop_intermediates", "local_path"]


def materialize(df, name: str = "stage"):
    """Write ``df`` as a Parquet table below the shared folder and read it back.

    One job, and the result no longer depends on the lineage above it: a lost
    executor re-reads the table instead of recomputing the sources, and
    several downstream plans can share the result without re-running it.
    (``DataFrame.checkpoint`` would run the lineage twice unless cached.)
    """
    path = fresh_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def size_for_input(spark: SparkSession, input_bytes: int, target_partition_bytes: int = 256 * 1024 * 1024,
                   min_partitions: int = 200, max_partitions: int = 100_000) -> dict:
    """Size shuffle and scan partitions from the input volume and apply them.

    The initial shuffle partition count is input / target (bounded), so no
    reducer starts with more than ~target bytes; AQE then coalesces small
    partitions (advisory size = target) and splits skewed ones. Scan splits
    use the same target. Returns the settings applied.

    Example: 100 TB of Parquet at 256 MiB per partition gives the 100,000
    cap (about 1 GiB per reducer before AQE splits skew), i.e. ~100
    partitions per executor on a 1000-executor cluster.
    """
    n = max(min_partitions, min(max_partitions, -(-int(input_bytes) // int(target_partition_bytes))))
    conf = {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
    }
    for k, v in conf.items():
        spark.conf.set(k, v)
    return conf


def apply_settings(spark: SparkSession, settings=None) -> dict:
    """Apply the engine-level values of ``Settings`` (shuffle partitions, the
    broadcast size limit AQE checks at run time, adaptive execution) to the session."""
    from tillscope.settings import DEFAULT
    s = settings or DEFAULT
    conf = {
        "spark.sql.shuffle.partitions": str(s.shuffle_partitions),
        "spark.sql.autoBroadcastJoinThreshold": str(s.broadcast_threshold_bytes),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    for k, v in conf.items():
        spark.conf.set(k, v)
    return conf
