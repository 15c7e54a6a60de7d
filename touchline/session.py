"""Session defaults and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "touchline", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the local bench, with a folder of its own; a cluster brings its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="touchline-"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# Folders of the tables written by this driver, for ``drop_stored``.
_WRITTEN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's ``spark.checkpoint.dir``, else a folder in the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_stored"


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder that nothing has used yet; ``drop_stored`` deletes what is written there."""
    _WRITTEN.append(f"{shared_folder(spark)}/table-{uuid.uuid4().hex}")
    return _WRITTEN[-1]


def shared_table(df: DataFrame, kind: str = "parquet", **options: str) -> str:
    """Write ``df`` to a new folder in the shared folder and return its path."""
    path = new_path(df.sparkSession)
    df.write.format(kind).options(**options).save(path)
    return path


def drop_stored(spark: SparkSession) -> int:
    """Delete all tables this driver has stored; call it when results that read them are written. Returns their number."""
    jvm, conf, n = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration(), len(_WRITTEN)
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(conf).delete(path, True)
    return n


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Its lineage ends there: a lost executor costs a re-read, several readers cost one computation, and readers prune
    columns. Its size is known too, so the planner broadcasts it in a join exactly when it is under
    ``spark.sql.autoBroadcastJoinThreshold`` and the rows it meets stay where they are; a larger one is joined by
    shuffling both sides.
    """
    path = shared_table(df)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` gave back, when nothing will read them again."""
    for df in tables:
        path, spark = df._stored_at, df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        _WRITTEN.remove(path)


def compute_partitions(spark: SparkSession) -> int:
    """Partitions for work whose cost is computation rather than bytes, which size-based merging would bunch up."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
