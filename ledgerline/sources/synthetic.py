"""Made-up records by a seed: the same seed gives the same rows on any cluster, since each depends on its key alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def number(seed: str, *key: Column, below: int) -> Column:
    """A whole number from 0 up to ``below`` that a key always gets."""
    return F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(below)).cast("int")


def pick(seed: str, key: list[Column], choices: list[str | None]) -> Column:
    return F.get(F.array(*[F.lit(c) for c in choices]), number(seed, *key, below=len(choices)))


def haul(spark: SparkSession, days: int, vehicles: int, seed: str = "0", first: str = "2025-01-01", wrong: int = 20) -> DataFrame:
    """Log and matrix rows of the same hauls; one in ``wrong`` differs between the two, one in ten is unknown."""
    d, v = F.col("day"), F.col("vehicle")
    base = spark.range(days).select(F.date_format(F.date_add(F.to_date(F.lit(first)), F.col("id").cast("int")), "yyyy-MM-dd").alias("day")).select("day", F.explode(F.sequence(F.lit(1), F.lit(vehicles))).alias("vehicle"), F.lit("log").alias("role"))
    base = base.unionByName(base.withColumn("role", F.lit("matrix")))
    cells = base.withColumn("level", F.explode(F.array(F.lit("L0"), F.lit("L1"))))
    key = [d, v, F.col("level")]
    trips = number(f"{seed}t", *key, below=9)
    off = (number(f"{seed}w", *key, below=wrong) == 0) & (F.col("role") == "log")
    value = F.when(number(f"{seed}u", *key, F.col("role"), below=10) > 0, trips + off.cast("int"))
    matrix = F.col("role") == "matrix"
    name = F.concat(F.lit("driver "), v.cast("string"))
    return cells.select(
        F.concat_ws(":", "role", "day", "vehicle", "level").alias("haul_id"), d.alias("work_date"), F.lit("made").alias("source_form"), F.col("role").alias("source_role"), F.concat_ws("-", "role", "day", F.when(~matrix, v.cast("string"))).alias("page_id"),
        F.when(matrix, v.cast("string")).alias("slot"), v.cast("string").alias("vehicle_no"), name.alias("operator"), F.lit("ore").alias("material"), "level", F.lit("day").alias("shift"),
        F.lit(1).alias("has_value_raw"), F.lit(1).alias("has_value"), value.alias("trips"), value.alias("trips_raw"), F.lit(0.9).alias("confidence"), F.concat_ws(":", "role", "day", "vehicle", "level").alias("source_field_id"), F.when(value.isNull(), "pending").otherwise("auto").alias("review_status"),
    )


def meters(spark: SparkSession, days: int, machines: int, seed: str = "0", first: str = "2025-01-01", gap: int = 15) -> DataFrame:
    """Meter records that run on from day to day; one in ``gap`` starts later than the one before ended."""
    m, n = F.col("machine"), F.col("n")
    rows = spark.range(machines).select(F.col("id").alias("machine")).select("machine", F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("n"))
    start = (n * 8 + m * 100).cast("double")
    jump = F.when((number(f"{seed}g", m, n, below=gap) == 0) & (n > 0), 0.5).otherwise(0.0)
    pending = number(f"{seed}p", m, n, below=25) == 0
    return rows.select(F.concat_ws("-", "machine", "n").alias("page_id"), F.concat(F.lit("id:"), m.cast("string")).alias("ref"), F.date_format(F.date_add(F.to_date(F.lit(first)), n.cast("int")), "yyyy-MM-dd").alias("work_date"), F.lit("made").alias("source_name"), F.lit(1).alias("page_no"), F.when(pending, "pending").otherwise("meter").alias("reading_kind"), F.when(~pending, start + jump).alias("meter_start"), F.when(~pending, start + 8).alias("meter_end"))
