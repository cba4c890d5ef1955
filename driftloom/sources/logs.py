"""Readers of change logs, event logs and reports, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "id string, ts timestamp, topic string, source string, correlation_id string, causation_id string, payload string"
SEVERITY = {"error": "HIGH", "warning": "MEDIUM", "note": "LOW", "none": "LOW"}


def name_status(lines: DataFrame) -> DataFrame:
    """``status, old_path, path`` from lines in ``value``; R and C take two paths."""
    p = F.split("value", "\t")
    moved = F.col("value").rlike("^[RC]")
    return lines.filter(F.trim("value") != "").select(F.left(p[0], F.lit(1)).alias("status"), p[1].alias("old_path"), F.when(moved, F.get(p, F.lit(2))).otherwise(p[1]).alias("path"))


def name_status_z(rows: DataFrame) -> DataFrame:
    """NUL-separated form: status, path (two for R and C), ...; the destination is
    kept, and of equal ones the first. ``id, value`` in; ``id, pos, status, path`` out."""
    step = F.aggregate(
        F.filter(F.split("value", "\x00"), lambda v: v != ""),
        F.struct(F.lit("").alias("s"), F.lit(0).alias("left"), F.array().cast("array<struct<status:string,path:string>>").alias("out")),
        lambda a, v: F.when(a["left"] == 0, F.struct(v.alias("s"), F.when(v.rlike("^[RC]"), 2).otherwise(1).alias("left"), a["out"].alias("out"))).otherwise(
            F.struct(a["s"].alias("s"), (a["left"] - 1).alias("left"), F.when(a["left"] == 1, F.concat(a["out"], F.array(F.struct(F.left(a["s"], F.lit(1)).alias("status"), v.alias("path"))))).otherwise(a["out"]).alias("out"))
        ),
        lambda a: a["out"],
    )
    x = rows.select("id", F.posexplode(step).alias("pos", "e")).select("id", "pos", "e.*")
    return x.groupBy("id", "path").agg(F.min(F.struct("pos", "status")).alias("m")).select("id", "m.pos", "m.status", "path")


def numstat(lines: DataFrame) -> DataFrame:
    """S3: ``adds, dels, path, binary``; a dash means binary, short lines are dropped."""
    p = F.split("value", "\t")
    return lines.filter(F.size(p) >= 3).select(F.expr("try_cast(split(value, '\t')[0] as int)").alias("adds"), F.expr("try_cast(split(value, '\t')[1] as int)").alias("dels"), p[2].alias("path"), ((p[0] == "-") | (p[1] == "-")).alias("binary"))


def shortstat(lines: DataFrame) -> DataFrame:
    """Files, insertions and deletions of the summary sentence, 0 where not named."""
    n = lambda pattern: F.coalesce(F.expr(f"try_cast(regexp_extract(value, '{pattern}', 1) as int)"), F.lit(0))
    return lines.select(n("([0-9]+) files? changed").alias("files"), n("([0-9]+) insertions?").alias("insertions"), n("([0-9]+) deletions?").alias("deletions"))


def event_log(spark: SparkSession, path: str, schema: str = EVENT) -> DataFrame:
    """JSON lines; a missing time is now."""
    return spark.read.schema(schema).json(path).withColumn("ts", F.coalesce("ts", F.current_timestamp()))


def append_events(events: DataFrame, path: str) -> None:
    """Appends to a history partitioned by day, so that a date filter prunes."""
    events.withColumn("date", F.to_date("ts")).repartition("date").write.mode("append").partitionBy("date").parquet(path)


def measures(rows: DataFrame, column: str = "value") -> DataFrame:
    """Path and number from ``{"files": {path: number}}`` or the bare map."""
    nested = F.from_json(F.coalesce(F.get_json_object(column, "$.files"), F.col(column)), "map<string,string>")
    x = rows.select(F.explode(nested).alias("path", "v"))
    return x.select("path", F.expr("try_cast(v as double)").alias("value")).filter("value IS NOT NULL")


def report_churn(rows: DataFrame, column: str = "value") -> DataFrame:
    """Churn by path from ``files[].{path, loc{add, del}}``."""
    schema = "files array<struct<path:string,loc:struct<add:int,del:int>>>"
    f = rows.select(F.explode(F.from_json(column, schema)["files"]).alias("f"))
    return f.select("f.path", (F.coalesce("f.loc.add", F.lit(0)) + F.coalesce("f.loc.del", F.lit(0))).alias("churn"))


def findings(rows: DataFrame, column: str = "value") -> DataFrame:
    """Findings of a scanner's ``runs[].results[]``."""
    result = "struct<ruleId:string,level:string,message:struct<text:string>,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int>>>>>"
    schema = f"runs array<struct<tool:struct<driver:struct<name:string>>,results:array<{result}>>>"
    run = rows.select(F.explode(F.from_json(column, schema)["runs"]).alias("r"))
    x = run.select(F.col("r.tool.driver.name").alias("tool"), F.explode("r.results").alias("x"))
    severity: Column = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in SEVERITY.items() for v in kv]), F.col("x.level")), F.lit("MEDIUM"))
    at = F.get("x.locations", F.lit(0))["physicalLocation"]
    return x.select("tool", F.col("x.ruleId").alias("rule_id"), severity.alias("severity"), at["artifactLocation"]["uri"].alias("file"), at["region"]["startLine"].alias("line"), F.col("x.message.text").alias("message"))


def tasks(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Task or result files of one JSON document each."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.input_file_name())


def query(spark: SparkSession, text: str, **params) -> DataFrame:
    """SQL with named parameters over registered views."""
    return spark.sql(text, args=params)


def report(df: DataFrame, path: str, version: str, fmt: str = "parquet") -> None:
    """An artifact with version, time and a digest of each row."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    df.withColumns({"version": F.lit(version), "written": F.current_timestamp(), "digest": row}).write.mode("overwrite").format(fmt).save(path)
