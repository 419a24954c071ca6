"""How a registered query is declared: a Spark build function, the columns it returns and,
where SQL can say the same, an independent statement for the check engine."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


class Dialect:
    """The few spots where the two SQL engines spell a scalar differently."""

    def __init__(self, spark: bool):
        self.spark = spark

    def us(self, col: str) -> str:
        if self.spark:
            return f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST({col} AS TIMESTAMP_NTZ))"
        return f"epoch_us({col})"

    def k(self) -> str:
        return ("CAST(get_json_object(props, '$.k') AS INT)" if self.spark
                else "CAST(json_extract_string(props, '$.k') AS INT)")

    def div(self, a: str, b: str) -> str:
        return f"(({a}) DIV ({b}))" if self.spark else f"(({a}) // ({b}))"


SPARK, DUCK = Dialect(True), Dialect(False)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. A handful of small files would leave most cores idle behind a one-task scan, so
    those are spread out; a table of many files, or of large ones that Spark reads in parts, is read as it is,
    without a shuffle."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    few = len(df.inputFiles()) < min(cores, 64) and df.rdd.getNumPartitions() < min(cores, 64)
    return df.repartition(cores) if few else df


def from_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run a stand-in view over the given tables."""
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    df = spark.sql(text, **used)
    # A stored event table has plain columns; without this the derivation would be copied into
    # every expression that reads it.
    return df.select(F.explode(F.array(F.struct(*df.columns))).alias("r")).select("r.*")


def duck_sql(text: str) -> str:
    for t in TABLES:
        text = text.replace("{" + t + "}", t)
    return text


@dataclass
class Case:
    """columns: 'name:t' with t in s(tring) i(nteger) d(ouble) b(oolean) l(ist)."""
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    columns: str
    sql: str | None = None

    def spec(self):
        return [c.rsplit(":", 1) for c in self.columns.split()]

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(spark, sf_dir)
        out = []
        for name, t in self.spec():
            c = F.col(f"`{name}`")
            c = {"s": lambda: c.cast("string"), "i": lambda: c.cast("bigint"), "d": lambda: F.round(c.cast("double"), 6),
                 "b": lambda: c.cast("boolean"),
                 "l": lambda: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")}[t]()
            out.append(c.alias(name))
        return df.select(*out)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        out = []
        for name, t in self.spec():
            q = f'"{name}"'
            out.append({"s": f"CAST({q} AS VARCHAR)", "i": f"CAST({q} AS BIGINT)", "d": f"round(CAST({q} AS DOUBLE), 6)",
                        "b": f"CAST({q} AS BOOLEAN)", "l": f"array_to_string({q}, ',')"}[t] + f" AS {q}")
        return f"SELECT {', '.join(out)} FROM ({duck_sql(self.sql)}) AS result"
