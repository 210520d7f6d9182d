"""What changed: fingerprints of scopes, differences of tables, upserts, and what of a target must be written anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions.ids import fingerprint


def scope_fingerprints(rows: DataFrame, scope: list[str], columns: list[str]) -> DataFrame:
    """A hash for each scope that doesn't depend on the rows' order: of the number of rows and the sums of the four
    quarters of their hashes. Sums are partial before the shuffle, so a scope may have any number of rows."""
    h = rows.select(*scope, fingerprint(*[F.col(c) for c in columns]).alias("h"))
    quarter = lambda i: F.sum(F.conv(F.substring("h", 1 + 16 * i, 16), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)").cast("string")
    g = h.groupBy(*scope).agg(F.count(F.lit(1)).alias("rows"), *[quarter(i).alias(f"q{i}") for i in range(4)])
    return g.select(*scope, "rows", F.sha2(F.concat_ws("|", F.col("rows").cast("string"), "q0", "q1", "q2", "q3"), 256).alias("fingerprint"))


def row_changes(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of rows that are new, gone or different, nulls being equal."""
    cols = [c for c in after.columns if c not in keys]
    a = before.select(*keys, F.struct(*cols).alias("a")) if cols else before.select(*keys, F.lit(1).alias("a"))
    b = after.select(*keys, F.struct(*cols).alias("b")) if cols else after.select(*keys, F.lit(1).alias("b"))
    j = a.join(b, keys, "full_outer")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed")
    return j.where(~F.col("a").eqNullSafe(F.col("b"))).select(*keys, change.alias("change"))


def plan_publish(now: DataFrame, published: DataFrame, scope: list[str]) -> DataFrame:
    """Scopes to replace (new or another fingerprint) and to remove (gone); unchanged ones aren't there."""
    j = now.select(*scope, F.col("fingerprint").alias("new")).join(published.select(*scope, F.col("fingerprint").alias("old")), scope, "full_outer")
    return j.where(~F.col("new").eqNullSafe(F.col("old"))).select(*scope, F.when(F.col("new").isNull(), "remove").otherwise("replace").alias("action"))


def replace_scopes(target: DataFrame, source: DataFrame, plan: DataFrame, scope: list[str]) -> DataFrame:
    """The target after the plan: what was planned goes, what is replaced comes from the source. First all that goes, then
    what comes, so rows may move between scopes."""
    stay = target.join(plan.select(*scope), scope, "left_anti").select(*target.columns)
    return stay.unionByName(source.join(plan.where("action = 'replace'").select(*scope), scope, "left_semi").select(*target.columns))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], insert_only: list[str] = ()) -> DataFrame:
    """The table with the rows in place of those with the same key; ``insert_only`` columns keep their first value."""
    old = table.select(*keys, F.lit(True).alias("_old"), *[F.col(c).alias(f"_{c}") for c in insert_only])
    new = rows.join(old, keys, "left") if insert_only else rows
    new = new.select(*[F.when(F.col("_old"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in insert_only else F.col(c) for c in table.columns])
    return table.join(rows.select(*keys), keys, "left_anti").select(*table.columns).unionByName(new)


def delete_pages(tables: dict[str, DataFrame], pages: DataFrame) -> dict[str, DataFrame]:
    """The tables without all rows of the pages."""
    gone = pages.select("page_id").distinct()
    return {n: t.join(gone, "page_id", "left_anti").select(*t.columns) if "page_id" in t.columns else t for n, t in tables.items()}


def orphans(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows that no scope would publish, counted by table: of pages that don't exist, pages without a document, rows
    without a date. Tables without such rows aren't there."""
    found = []
    say = lambda t, df: df.agg(F.lit(t).alias("table"), F.count(F.lit(1)).alias("n"))
    for t in model.DOCUMENT_TABLES[2:]:
        if t in tables:
            found.append(say(t, tables[t].join(tables["doc_page"].select("page_id"), "page_id", "left_anti")))
    if "doc_document" in tables:
        found.append(say("doc_page", tables["doc_page"].join(tables["doc_document"].select("document_id"), "document_id", "left_anti")))
    for t, c in model.DATE_TABLES.items():
        if t in tables:
            found.append(say(t, tables[t].where(F.col(c).isNull())))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.where("n > 0")


def unsuitable(df: DataFrame) -> Column:
    """Whether a row has text that a relational target refuses (a NUL character)."""
    text = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
    bad = F.lit(False)
    for c in text:
        bad = bad | F.coalesce(F.col(c).contains("\x00"), F.lit(False))
    return bad


def guard_publish(work_rows: int, target_rows: int, site: str, target_site: str | None) -> None:
    """An empty work store doesn't clear a target, and one site's target isn't another's."""
    if target_site is not None and target_site != site:
        raise ValueError("the target belongs to another site")
    if work_rows == 0 and target_rows > 0:
        raise ValueError("there is nothing to publish, but the target has rows")


def flat_diff(before: DataFrame, after: DataFrame, keys: list[str], tolerance: float = 0.01) -> DataFrame:
    """Metrics (keys, value) that differ by more than the tolerance, and new and missing ones by themselves."""
    j = before.select(*keys, F.col("value").alias("before"), F.lit(True).alias("_b")).join(after.select(*keys, F.col("value").alias("after"), F.lit(True).alias("_a")), keys, "full_outer")
    kind = F.when(F.col("_b").isNull(), "new").when(F.col("_a").isNull(), "missing").when(F.col("before").isNull() | F.col("after").isNull(), F.when(~F.col("before").eqNullSafe(F.col("after")), "changed")).when(F.abs(F.col("after") - F.col("before")) > tolerance, "changed")
    return j.withColumn("kind", kind).where("kind IS NOT NULL").select(*keys, "before", "after", "kind")


def dirty_keys(changes: DataFrame, before: DataFrame, after: DataFrame, keys: list[str], of: list[str]) -> DataFrame:
    """The values of ``of`` (dates, machines) that changed rows had before or have after: what must be computed anew."""
    touched = before.select(*keys, *of).unionByName(after.select(*keys, *of)).join(changes.select(*keys), keys, "left_semi")
    return touched.select(*of).distinct()


def recompute(result: DataFrame, dirty: DataFrame, fresh: DataFrame, of: list[str]) -> DataFrame:
    """A result with the dirty keys' rows computed anew."""
    return result.join(dirty, of, "left_anti").select(*result.columns).unionByName(fresh.join(dirty, of, "left_semi").select(*result.columns))
