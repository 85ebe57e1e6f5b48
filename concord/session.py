"""Session and shared-storage helpers used by every part of the library."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", name: str = "concord") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Settings for work on long texts, where the session has none of its own: Arrow batches bounded by bytes (a batch of
#: long rows is otherwise as large as its rows), and shuffle files that go when their query ends.
LONG_TEXTS = {"spark.sql.execution.arrow.maxBytesPerBatch": "4194304", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def for_long_texts(spark: SparkSession) -> SparkSession:
    for key, value in LONG_TEXTS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


#: The folder of each application's tables.
_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of this application's tables, inside the one that all executors share.

    That is ``spark.checkpoint.dir``; a local session may leave it unset and gets a temporary folder. The folder is
    deleted when the driver ends, or by ``clear``.
    """
    app = spark.sparkContext.applicationId
    if app not in _folders:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not spark.sparkContext.master.split("[")[0] == "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="concord-")
        _folders[app] = f"{folder.rstrip('/')}/concord-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(clear, spark)
    return _folders[app]


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application has stored."""
    try:
        folder = _folders.pop(spark.sparkContext.applicationId, None)
        if folder:
            _delete(spark, folder)
    except Exception:  # noqa: BLE001  at the driver's end the session may be gone already
        return


def stored(df: DataFrame, label: str = "t") -> DataFrame:
    """Cut lineage: write ``df`` once as Parquet in the shared folder and read it back.

    The files survive lost executors, and later plans see true row counts.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the files behind ``stored`` frames that nothing reads any more."""
    for df in frames:
        _delete(df.sparkSession, df._stored_at)
