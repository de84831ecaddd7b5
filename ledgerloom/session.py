"""The Spark session that the engine is meant to run with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .operators.rules import TOLERANCE
from .sources import master


def session(app: str = "ledgerloom", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` entries override, with _ for dots."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


#: Bytes for each core up to which an input is dealt out anew.
SMALL = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt to all cores where it is small, as a file of one row group keeps one core busy however it is split; what is costly by row needs that. Larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size <= cores * SMALL else df


def tolerance(spark: SparkSession, default: float = TOLERANCE) -> float:
    """By how much amounts may differ: the session's setting ``spark.ledgerloom.tolerance``, else the default."""
    return float(spark.conf.get("spark.ledgerloom.tolerance", str(default)))


def master_data(spark: SparkSession) -> master.Master:
    """Master data of the folder that the session's setting ``spark.ledgerloom.master`` names, else the built-in lists."""
    return master.load(spark, spark.conf.get("spark.ledgerloom.master", None))
