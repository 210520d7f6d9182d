"""Two sources that report the same quantity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .latest import rank_in


def poisoned_sum(value: Column, has: Column) -> Column:
    """The sum, or null if a value that is known to exist is unknown; null too if there is none at all."""
    return F.when(F.count_if((F.coalesce(has, F.lit(0)) != 0) & value.isNull()) == 0, F.sum(value))


def collect(rows: DataFrame, by: list[str], has: str = "has_value", value: str = "trips", has_raw: str = "has_value_raw", value_raw: str = "trips_raw") -> DataFrame:
    """For each key whether there is a value, the final sum and the machine's sum, each null if a part is unknown."""
    return rows.groupBy(*by).agg(
        F.greatest(F.lit(0), F.max(has)).alias("has"),
        poisoned_sum(F.col(value), F.col(has)).alias("total"),
        poisoned_sum(F.col(value_raw), F.col(has_raw)).alias("total_raw"),
    )


def compare(log: DataFrame, matrix: DataFrame, slot: list[str], rest: list[str]) -> DataFrame:
    """Both sides by their common key with a status. A slot without any log is missing there; a key that only the log
    has is missing in the matrix; else presence and, where both are known, sums must agree."""
    by = [*slot, *rest]
    side = lambda d, p: d.select(*by, *[F.col(c).alias(f"{p}_{c}") for c in ("has", "total", "total_raw")])
    # what the log has in a slot: one row a slot, so no key of it is hot on both sides
    slots = log.select(*slot).distinct().withColumn("slot_has_log", F.lit(True))
    both = side(log, "log").join(side(matrix, "matrix"), by, "full_outer").join(slots, slot, "left")
    log_has = F.when(F.col("log_has").isNull() & F.col("slot_has_log"), 0).otherwise(F.col("log_has"))
    differ = F.coalesce(F.col("log_total") != F.col("matrix_total"), F.lit(False))
    status = F.when(F.col("log_has").isNull() & F.col("slot_has_log").isNull(), "missing_log").when(F.col("matrix_has").isNull(), "missing_matrix")
    status = status.when((log_has == F.col("matrix_has")) & ~differ, "match").otherwise("mismatch")
    shown = F.when(F.col("matrix_has").isNull(), F.col("log_has")).otherwise(log_has)
    return both.select(*by, shown.alias("log_has"), "matrix_has", F.col("log_total").alias("log_trips"), F.col("matrix_total").alias("matrix_trips"), F.col("log_total_raw").alias("log_trips_raw"), F.col("matrix_total_raw").alias("matrix_trips_raw"), status.alias("status"))


def match_pass(left: DataFrame, right: DataFrame, by: list[str], key: str, left_order: list[Column], right_order: list[Column]) -> DataFrame:
    """One-to-one in order: the nth left row of a key gets its nth right row. Empty keys match nothing."""
    given = F.coalesce(F.col(key).cast("string"), F.lit("")) != ""
    a = left.where(given).withColumn("_n", rank_in([*by, key], left_order)).select(*by, key, "_n", "page_id")
    b = right.where(given).withColumn("_n", rank_in([*by, key], right_order)).select(*by, key, "_n", "slot")
    return a.join(b, [*by, key, "_n"]).select(*by, "page_id", "slot")


def assign_slots(pages: DataFrame, slots: DataFrame, by: list[str], page_order: list[str], slot_order: list[str]) -> DataFrame:
    """Each page's slot: first by equal operators, then, of what is left on both sides, by equal vehicles. ``pages`` and
    ``slots`` have vehicle_no and operator. A slot goes to one page. Equals going through pages in order and taking the
    first free slot, since within a key both sides are used up in order."""
    po, so = [F.col(c) for c in page_order], [F.col(c) for c in slot_order]
    first = match_pass(pages, slots, by, "operator", po, so).withColumn("matched_by", F.lit("operator"))
    rest_pages, rest_slots = pages.join(first, [*by, "page_id"], "left_anti"), slots.join(first, [*by, "slot"], "left_anti")
    second = match_pass(rest_pages, rest_slots, by, "vehicle_no", po, so).withColumn("matched_by", F.lit("vehicle"))
    return first.unionByName(second)


def crosscheck(haul: DataFrame, order: str = "haul_id", exclude: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Haul rows to (cross-check, assignments) for all days. ``order`` is a column in the pages' and rows' order."""
    rows = haul.where(F.col("work_date").isNotNull() & ~F.coalesce(F.col("material").isin(*exclude), F.lit(False))) if exclude else haul.where("work_date IS NOT NULL")
    matrix, log = rows.where("source_role = 'matrix'"), rows.where("source_role = 'log'")
    head = F.min_by(F.struct("operator", "vehicle_no"), order).alias("head")
    slots = matrix.groupBy("work_date", "slot").agg(head, F.min(order).alias("_o")).select("work_date", "slot", "head.*", "_o")
    pages = log.groupBy("work_date", "page_id").agg(head, F.min(order).alias("_o")).select("work_date", "page_id", "head.*", "_o")
    found = assign_slots(pages, slots, ["work_date"], ["_o"], ["_o"])
    who = found.join(pages.drop("_o"), ["work_date", "page_id"])
    headed = slots.select("work_date", "slot", F.col("operator").alias("header_operator"), F.col("vehicle_no").alias("header_vehicle_no"))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    wrong = (text("header_operator") != text("operator")) | (text("header_vehicle_no") != text("vehicle_no"))
    obs = who.join(headed, ["work_date", "slot"]).select("work_date", "slot", "vehicle_no", "operator", "header_vehicle_no", "header_operator", "matched_by", wrong.cast("int").alias("header_mismatch"))
    placed = log.drop("slot").join(found.select("work_date", "page_id", "slot"), ["work_date", "page_id"], "left")
    named = placed.join(pages.select("work_date", "page_id", F.col("vehicle_no").alias("_v")), ["work_date", "page_id"])
    nowhere = F.concat(F.lit("unresolved:"), F.when(F.coalesce(F.col("_v"), F.lit("")) != "", F.col("_v")).otherwise(F.col("page_id")))
    named = named.withColumn("slot", F.coalesce("slot", nowhere))
    by = ["work_date", "slot", "material", "level"]
    checked = compare(collect(named, by), collect(matrix, by), ["work_date", "slot"], ["material", "level"])
    return checked.join(who.select("work_date", "slot", "vehicle_no", "operator"), ["work_date", "slot"], "left"), obs
