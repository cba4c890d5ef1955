"""A session with the settings that the operators count on."""

from pyspark.sql import SparkSession


def session(name: str = "driftloom", **conf: str) -> SparkSession:
    """AQE splits skewed joins and merges small partitions; times are UTC."""
    build = SparkSession.builder.appName(name)
    settings = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for key, value in (settings | conf).items():
        build = build.config(key, value)
    return build.getOrCreate()
