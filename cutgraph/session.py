"""Session settings that the engine is written for."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "cutgraph", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, adaptive plans and skew handling; ``conf`` adds or overrides settings (dots as __)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for key, value in (settings | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _shared(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, made the context's checkpoint folder; only a local session without it gets one of its own."""
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        if not (context.master.startswith("local") and "local-cluster" not in context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="cutgraph-")
        spark.conf.set("spark.checkpoint.dir", at)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(at)
    return at.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{_shared(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed and kept in the shared folder, so that later plans are short and survive lost executors."""
    _shared(df.sparkSession)
    return df.checkpoint()
