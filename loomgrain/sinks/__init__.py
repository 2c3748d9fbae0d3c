"""Sinks: Spark's commit protocol takes the place of locks, temporary files and renames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrain import schemas
from loomgrain.operators.ordering import numbered


def validated(rows: DataFrame, record: str, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """K1: (rows cast to the record's type, rows that lack a required value). Fields that are missing are null, others are dropped."""
    fields = schemas.record(record).fields
    cast = rows.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in fields])
    bad = F.lit(False)
    for r in required:
        bad = bad | F.col(r).isNull()
    return cast.where(~bad), cast.where(bad)


def split(rows: DataFrame, order: str, ratio: float = 0.9) -> DataFrame:
    """K2: ``part`` by position: the first floor(n * ratio) rows are ``train``."""
    n = rows.agg(F.count(F.lit(1)).alias("__n"))
    x = numbered(rows, [F.col(order).asc()], "__at", name="split").crossJoin(F.broadcast(n))
    return x.withColumn("part", F.when(F.col("__at") <= F.floor(F.col("__n") * ratio), "train").otherwise("dev")).drop("__at", "__n")


def write_split(rows: DataFrame, path: str, order: str, ratio: float = 0.9) -> None:
    """K2: JSON lines below ``path``/part=train and part=dev, null fields left out."""
    split(rows, order, ratio).write.mode("append").partitionBy("part").json(path)


def named(rows: DataFrame, order: str, start: int = 1, mode: str = "seq", content: str | None = None, prefix: str = "img") -> DataFrame:
    """``file`` names: numbered, random, or by the SHA-1 of the content (equal content: a suffix from the order)."""
    if mode == "seq":
        return numbered(rows, [F.col(order).asc()], "__at", name="names").withColumn("file", F.format_string(f"{prefix}_%07d", F.col("__at") + (start - 1))).drop("__at")
    if mode == "uuid":
        return rows.withColumn("file", F.replace(F.uuid(), F.lit("-"), F.lit("")))
    h = F.sha1(content)
    first = rows.groupBy(h.alias("__h")).agg(F.min(order).alias("__first"))
    x = rows.withColumn("__h", h).join(first, "__h")
    return x.withColumn("file", F.when(F.col(order) == F.col("__first"), F.col("__h")).otherwise(F.concat("__h", F.lit("_"), F.left(F.md5(F.col(order).cast("string")), F.lit(6))))).drop("__h", "__first")


def append_accepted(rows: DataFrame, path: str, is_generated: bool = False) -> None:
    """K4, K5, K3: accepted rows by topic; usable from ``foreachBatch``."""
    rows.withColumn("is_generated", F.lit(is_generated)).write.mode("append").partitionBy("topic").parquet(path)


def append_table(rows: DataFrame, path: str, form: str = "parquet") -> None:
    """Rounds, advantages, strategies and logs."""
    rows.write.mode("append").format(form).save(path)


def replace_table(rows: DataFrame, path: str) -> None:
    """A small table replaced as a whole; its rows must not come from the same path."""
    rows.write.mode("overwrite").parquet(path)


class Totals:
    """Totals of a stage as Spark observes them, without a pass of their own."""

    def __init__(self, rows: DataFrame, name: str = "totals"):
        from pyspark.sql import Observation

        self.observation = Observation(name)
        ok = F.count_if(F.size("reasons") == 0)
        self.rows = rows.observe(self.observation, F.count(F.lit(1)).alias("checked"), ok.alias("accepted"))

    def get(self) -> dict:
        """After an action over ``rows``."""
        x = self.observation.get
        return x | {"rejected": x["checked"] - x["accepted"], "accept_rate": round(x["accepted"] / x["checked"], 4) if x["checked"] else 0.0}


def read_back(spark: SparkSession, path: str, record: str) -> DataFrame:
    return spark.read.schema(schemas.record(record)).parquet(path)
