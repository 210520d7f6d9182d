"""Writing: tables by key, logs, scopes, splits, workbooks and reports."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..operators import diff
from .scratch import file_system, folders, materialise


def write_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Overwrite only the partitions that the rows are of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def append_jsonl(df: DataFrame, path: str, order: list[str] | None = None) -> str:
    """A line for each row, as a new numbered batch in the log's folder, in the rows' order or that of ``order``; returns
    the batch's folder. A torn line of another batch stays by itself. A log has one writer at a time (sources/guard.py)."""
    spark = df.sparkSession
    known = [int(n.removeprefix("batch-")) for n in folders(spark, path) if n.startswith("batch-")]
    batch = f"{path}/batch-{max(known, default=0) + 1:010d}"
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    rows.select(F.to_json(F.struct(*df.columns)).alias("value")).write.text(batch)
    return batch


def write_by_split(df: DataFrame, path: str, split: Column) -> None:
    df.withColumn("split", split).write.mode("overwrite").partitionBy("split").json(path)


def version_number(name: str) -> int:
    digits = re.search(r"([0-9]+)$", name)
    return int(digits[1]) if digits else -1


def newest_version(spark: SparkSession, path: str) -> str | None:
    """The folder of a table's newest version: the highest number at a name's end, of the folders that were written whole."""
    whole = [n for n in folders(spark, path, finished=True) if version_number(n) >= 0]
    return f"{path}/{max(whole, key=version_number)}" if whole else None


def merge_table(spark: SparkSession, path: str, rows: DataFrame, keys: list[str], insert_only: list[str], version: str | None = None) -> str:
    """Upsert into a table that is kept as versions: the new version is written beside the old, so readers of the old go
    on, and a failed write leaves it as it was and counts for nothing. Returns the new version's path; its number, the
    next one by default, must be above all others."""
    last = newest_version(spark, path)
    highest = max((version_number(n) for n in folders(spark, path)), default=0)
    version = version or f"v{highest + 1}"
    if last is not None and version_number(version) <= version_number(last):
        raise ValueError(f"version {version} isn't newer than {last}")
    old = spark.read.parquet(last) if last else spark.createDataFrame([], rows.schema)
    diff.upsert(old, rows, keys, insert_only).write.parquet(f"{path}/{version}")
    return f"{path}/{version}"


def publish(now: DataFrame, target: DataFrame | None, rows: DataFrame, scope: list[str], columns: list[str], write: Callable[[DataFrame], None], check: bool = False, rebuild: bool = False, site: str = "", target_site: str | None = None) -> DataFrame:
    """Bring a target up to date scope by scope: ``write`` gets the whole new target (an atomic overwrite, or a version of
    its own). Returns the plan: scopes to replace, to remove, and those to skip because a value of theirs is refused by
    targets; what the target has of these stays. ``now`` are the source's rows, ``target`` the published ones.

    ``check`` only plans; ``rebuild`` writes every scope anew. An empty source doesn't clear a target, and another site's
    target isn't written. The plan is fixed before the write, so it doesn't change when the target does.
    """
    diff.guard_publish(len(now.limit(1).take(1)), 0 if target is None else len(target.limit(1).take(1)), site, target_site)
    have = diff.scope_fingerprints(now, scope, columns)
    old = diff.scope_fingerprints(target, scope, columns) if target is not None else have.limit(0)
    plan = diff.plan_publish(have, old if not rebuild else old.withColumn("fingerprint", F.lit("")), scope)
    bad = now.where(diff.unsuitable(now)).select(*scope).distinct().withColumn("_bad", F.lit(True))
    skip = F.col("_bad") & (F.col("action") == "replace")
    plan, _ = materialise(plan.join(bad, scope, "left").select(*scope, F.when(skip, "skip").otherwise(F.col("action")).alias("action")), "publish-plan")
    if not check:
        write(diff.replace_scopes(target if target is not None else rows.limit(0), rows, plan.where("action <> 'skip'"), scope))
    return plan


def create_statements(target_schema: str = "public") -> list[str]:
    return [model.ddl(t, target_schema) for t in [*model.DOCUMENT_TABLES, *model.DATE_TABLES, *model.WHOLE_TABLES]]


def jdbc(df: DataFrame, url: str, table: str, **options: str) -> None:
    df.write.format("jdbc").options(url=url, dbtable=table, truncate="true", **options).mode("overwrite").save()


def mask_boxes(fields: DataFrame, pad: int = 4) -> DataFrame:
    """Boxes to cover on a page's image: signatures, personal meta fields, free text, and what a form says to redact."""
    hide = (F.col("kind") == "signature") | F.col("is_meta") | F.col("redact") | (F.col("kind") == "handwritten_text")
    grow = lambda c, d: F.greatest(F.lit(0), F.col(c) + d)
    return fields.where(F.coalesce(hide, F.lit(False))).select("page_id", "field_id", grow("x0", -pad).alias("x0"), grow("y0", -pad).alias("y0"), grow("x1", pad).alias("x1"), grow("y1", pad).alias("y1"))


def manifest_changes(files: DataFrame, recorded: DataFrame, store_is_empty: bool) -> DataFrame:
    """Exported files (path, hash) against the record: write new and changed ones, delete recorded ones that are gone;
    when the store is empty nothing is deleted."""
    plan = diff.plan_publish(files.withColumnRenamed("hash", "fingerprint"), recorded.withColumnRenamed("hash", "fingerprint"), ["path"])
    return plan.where("action = 'replace'") if store_is_empty else plan


def report_json(rows: DataFrame) -> str:
    """A report's rows (section, key, n) as JSON; a report is a few hundred rows."""
    out: dict[str, dict[str, int]] = {}
    for r in rows.orderBy("section", "key").collect():
        out.setdefault(r["section"], {})[r["key"]] = r["n"]
    return json.dumps(out, ensure_ascii=False, indent=1)
