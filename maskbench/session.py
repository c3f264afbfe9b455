"""Session helpers shared by the entry points, the benchmark and the tests."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_FALLBACK: dict[str, str] = {}


def local_session(cores: int | str = 8, app: str = "maskbench", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the benchmark use."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``; a temporary folder is only the
    fallback of single-machine runs, where that setting is absent.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if not str(sc.master).startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if sc.applicationId not in _FALLBACK:
        _FALLBACK[sc.applicationId] = tempfile.mkdtemp(prefix="maskbench-")
    return _FALLBACK[sc.applicationId]


def materialise(df: DataFrame) -> DataFrame:
    """Write an intermediate result to the shared folder and read it back.

    For a small result that several branches of a plan use, such as paired scores: the large
    input behind it is scanned once, and a lost executor costs only the step at hand. The
    tables stay until the shared folder is cleared.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
