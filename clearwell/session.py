"""Session settings the package relies on, and where intermediate tables go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(app_name: str = "clearwell", master: str | None = None, **extra) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session made elsewhere."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and staged tables.

    ``spark.checkpoint.dir`` names it. A session without that setting is refused: executors would not share a
    folder that was made up here, and nobody would know what to clean up.
    """
    jsc = spark.sparkContext._jsc
    current = jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(path)
    return jsc.sc().getCheckpointDir().get()


def name_local_folder(spark: SparkSession) -> None:
    """For trial runs and tests: a local session that names no shared folder gets one of this process. A cluster must
    name its own."""
    sc = spark.sparkContext
    unset = not spark.conf.get("spark.checkpoint.dir", None) and not sc._jsc.sc().getCheckpointDir().isDefined()
    if unset and sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="clearwell-"))


def staging_path(spark: SparkSession, label: str) -> str:
    """A new folder name under the shared folder."""
    return f"{shared_dir(spark)}/staged/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    Used before several statistics passes over an expensive frame. The rows lie in reliable storage, so a lost
    executor costs a re-read and not a recomputation, and each pass reads only the columns it needs.
    """
    path = staging_path(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a staged folder that this package wrote."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)
