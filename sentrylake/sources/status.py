"""How reading went, for each case: a file, a host or a capture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def listing(spark: SparkSession, paths) -> DataFrame:
    """(case_key, length) of the files under paths; their contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).select(F.col("path").alias("case_key"), "length")


def case_status(cases: DataFrame, events: DataFrame, rejects: DataFrame) -> DataFrame:
    """case_key, events, rejects, status and error for every case that was asked for, also those that gave nothing.

    cases, events and rejects have a column case_key, a row per case, event and rejected line. A case is good, damaged (some
    lines could not be read), unreadable (none could) or empty; the last two are errors. Rows are counted before
    they are shuffled. A null key is a case of its own if it is listed."""
    def counted(rows, name):
        return rows.groupBy(F.col("case_key").alias("_key")).agg(F.count(F.lit(1)).alias(name))
    out = cases.select("case_key").distinct()
    for rows, name in ((events, "events"), (rejects, "rejects")):
        n = counted(rows, name)
        out = out.join(n, out["case_key"].eqNullSafe(n["_key"]), "left").drop("_key")
    out = out.fillna(0, ["events", "rejects"])
    some, bad = F.col("events") > 0, F.col("rejects") > 0
    status = F.when(some & ~bad, "good").when(some, "damaged").when(bad, "unreadable").otherwise("empty")
    return out.withColumn("status", status).withColumn("error", ~some)
