"""Samples and review queues that come out the same whatever the rows' order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import rank_key


def stratified(df: DataFrame, strata: list[str], key: str, seed: str, n: int | None) -> DataFrame:
    """Round robin over the strata, each in the order of a hash of seed and key, up to ``n`` rows; ``place`` is the
    order. Within a stratum no more than n rows can be chosen, so the window keeps only those."""
    h = df.withColumn("_h", rank_key(seed, F.col(key)))
    turn = F.row_number().over(Window.partitionBy(*strata).orderBy("_h", key))
    t = h.withColumn("turn", turn)
    t = t.where(F.col("turn") <= n).orderBy("turn", *strata, "_h").limit(n) if n is not None else t
    return t.drop("_h")


def queue(fields: DataFrame, reviews: DataFrame | None = None, only: Column | None = None, fresh: bool = True) -> DataFrame:
    """Fields that wait for a reviewer (or meet ``only``), without those that have a review if ``fresh``."""
    q = fields.where(only if only is not None else F.col("review_status") == "pending")
    return q.join(reviews.select("field_id").distinct(), "field_id", "left_anti") if fresh and reviews is not None else q


def blind_sample(fields: DataFrame, reviews: DataFrame, strata: list[str], seed: str, n: int, empty_share: float) -> DataFrame:
    """A sample in which a share of cells is empty, without what has been reviewed."""
    todo = queue(fields, reviews, F.lit(True))
    k = round(n * empty_share)
    return stratified(todo.where("has_value <> 0"), strata, "field_id", seed, n - k).unionByName(stratified(todo.where("has_value = 0"), strata, "field_id", seed, k))


def mismatch_groups(checks: DataFrame, haul: DataFrame) -> DataFrame:
    """Each mismatching key with the cells it compares."""
    key = ["work_date", "slot", "material", "level"]
    cell = F.struct("source_role", "haul_id", "trips")
    return checks.where("status = 'mismatch'").select(*key).join(haul, key).groupBy(*key).agg(F.array_sort(F.collect_set(cell)).alias("cells"))


def confirmed(checks: DataFrame, reviews: DataFrame, note: str) -> DataFrame:
    """Checks (check_id, field_id for each cell) without those all of whose cells were confirmed under a note."""
    done = reviews.where(F.col("note").startswith(note)).select("field_id").distinct().withColumn("ok", F.lit(True))
    g = checks.join(done, "field_id", "left").groupBy("check_id").agg(F.min(F.coalesce("ok", F.lit(False)).cast("int")).alias("ok"))
    return g.where("ok = 0").select("check_id")


def candidate_values(*values: DataFrame) -> DataFrame:
    """Values by how often they occur, then by themselves. Each frame has a column value."""
    all_values = values[0].select("value")
    for v in values[1:]:
        all_values = all_values.unionByName(v.select("value"))
    return all_values.where("value IS NOT NULL").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
