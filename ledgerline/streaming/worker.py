"""Rounds of work over what has come in since: the same transforms as in batch, on streams of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

#: Called after each round with its rows and number; one that fails doesn't stop the others.
AfterRound = Callable[[DataFrame, int], None]


def run_rounds(source: DataFrame, process: Callable[[DataFrame, int], None], checkpoint: str, after: tuple[AfterRound, ...] = (), every: str | None = None, errors: list | None = None) -> StreamingQuery:
    """A round for each micro-batch: ``process`` it, then what follows a round. ``every`` polls at that interval;
    without it all there is gets processed and the query ends. One checkpoint has one writer at a time."""

    def one(batch: DataFrame, n: int) -> None:
        process(batch, n)
        for job in after:
            try:
                job(batch, n)
            except Exception as e:  # jobs after a round are separate: publishing may fail while the store is up to date
                if errors is None:
                    raise
                errors.append((n, repr(e)))

    w = source.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, files_a_round: int = 100, glob: str | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_round)
    return (r.option("pathGlobFilter", glob) if glob else r).parquet(folder)


def settled(files: DataFrame, seen: DataFrame, now: float, wait_s: float, give_up_s: float) -> DataFrame:
    """Which files of an inbox (path, length, modified as seconds) may be taken: those unchanged since they were last
    seen and for ``wait_s``; those that stay unreadable for ``give_up_s`` have failed."""
    j = files.join(seen.select("path", F.col("length").alias("seen_length"), "first_seen"), "path", "left")
    calm = (F.col("seen_length") == F.col("length")) & (F.lit(now) - F.col("modified") >= wait_s) & (F.col("length") > 0)
    late = F.lit(now) - F.coalesce("first_seen", F.lit(now)) >= give_up_s
    return j.select("path", "length", F.coalesce("first_seen", F.lit(now)).alias("first_seen"), F.when(F.coalesce(calm, F.lit(False)), "ready").when(late, "failed").otherwise("wait").alias("state"))


def new_documents(batch: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose content isn't a document yet, one for each content: delivering a file again changes nothing."""
    first = batch.groupBy("document_id").agg(F.min(F.struct("path", "length")).alias("f")).select("document_id", "f.*")
    return first.join(known.select("document_id"), "document_id", "left_anti")


def pending(documents: DataFrame) -> DataFrame:
    """Documents to process: received, or asked for again since they were last done."""
    return documents.where((F.col("status") == "received") | (F.coalesce("work_requested", F.lit(0)) > F.coalesce("work_done", F.lit(0))))


def mark_done(documents: DataFrame, processed: DataFrame) -> DataFrame:
    """Set work_done to what was asked for when processing began (processed.asked), so a request that came meanwhile is
    still open."""
    j = documents.join(processed.select("document_id", "asked"), "document_id", "left")
    return j.withColumn("work_done", F.greatest(F.coalesce("work_done", F.lit(0)), F.coalesce("asked", F.lit(0)))).drop("asked").select(*documents.columns)


def month_slices(days: DataFrame, day: str) -> list[str]:
    """Months that have days, in order, and last the slice of days that don't look like dates (None). The number of months
    is small whatever the data's size."""
    from ..functions.dates import month_of

    months = sorted(r.m for r in days.select(month_of(F.col(day)).alias("m")).distinct().collect() if r.m)
    return [*months, None]


def retry_after(failures: int, base_s: float = 30.0, most_s: float = 3600.0) -> float:
    """Seconds to wait after so many failures in a row."""
    return 0.0 if failures <= 0 else min(most_s, base_s * 2 ** (failures - 1))


def running_counts(events: DataFrame, by: list[str]) -> DataFrame:
    """Counts and sums of a stream or a table by key."""
    return events.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor(F.col("value") * 100).cast("long")).alias("cents"))


def received_stamps(arrived: DataFrame, order: list[str], last: int | None) -> DataFrame:
    """Arrivals (``ms``) in order, each with a stamp later than all before it: its own time, or one millisecond after the
    stamp before. So the i-th stamp is i plus the largest of time less place so far, in one window over an inbox round."""
    from pyspark.sql import Window

    w = Window.orderBy(*order)
    at = F.row_number().over(w) - 1
    lead = F.max(F.col("ms") - F.col("_at")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    first = F.greatest(lead, F.lit(last + 1)) if last is not None else lead
    return arrived.withColumn("_at", at).withColumn("stamp", F.col("_at") + first).drop("_at")


def stamp_name(ms: Column) -> Column:
    """20250326T081500123Z, in UTC."""
    t = F.timestamp_millis(ms)
    return F.concat(F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), t.cast("timestamp_ntz")), "yyyyMMdd'T'HHmmss"), F.lpad(F.pmod(ms, F.lit(1000)).cast("string"), 3, "0"), F.lit("Z"))


def stamp_of_name(name: Column) -> Column:
    """Milliseconds of such a name, wherever it stands in a path; null without one."""
    part = lambda i: F.regexp_extract(name, "([0-9]{4})([0-9]{2})([0-9]{2})T([0-9]{2})([0-9]{2})([0-9]{2})([0-9]{3})Z", i).cast("int")
    days = F.datediff(F.make_date(part(1), part(2), part(3)), F.lit("1970-01-01").cast("date")).cast("long")
    there = F.regexp_extract(name, "[0-9]{8}T[0-9]{9}Z", 0) != ""
    return F.when(there, ((days * 24 + part(4)) * 60 + part(5)) * 60_000 + part(6) * 1000 + part(7))


def inbox_round(files: DataFrame, known: DataFrame, seen: DataFrame, now: float, wait_s: float, give_up_s: float, last: int | None, archive: str) -> dict[str, DataFrame]:
    """One look at an inbox: ``files`` has path, length, modified (seconds) and document_id (null if it can't be opened).

    What is settled and new is to be copied to its place in the archive, checked there and registered (``register``); only
    then, and what is a document already (``already``), is the file taken away; what stays unreadable goes aside
    (``failed``). ``seen`` is what the next round must know. Doing a step again changes nothing."""
    state = settled(files, seen, now, wait_s, give_up_s)
    j = files.join(state.select("path", "state", "first_seen"), "path")
    ready = j.where("state = 'ready'")
    again = ready.where("document_id IS NOT NULL").join(known.select("document_id"), "document_id", "left_semi")
    fresh = new_documents(ready.where("document_id IS NOT NULL"), known)
    copies = ready.where("document_id IS NOT NULL").join(fresh.select("path"), "path", "left_anti").join(again.select("path"), "path", "left_anti")
    stamped = received_stamps(fresh.withColumn("ms", F.lit(int(now * 1000)).cast("long")), ["path"], last)
    name = F.element_at(F.split("path", "/"), -1)
    month = F.concat_ws("-", F.substring(stamp_name(F.col("stamp")), 1, 4), F.substring(stamp_name(F.col("stamp")), 5, 2))
    rel = F.concat_ws("/", F.lit("intake"), month, F.concat_ws("-", stamp_name(F.col("stamp")), "document_id"), name)
    late = F.lit(now) - F.col("first_seen") >= give_up_s
    unreadable = j.where(((F.col("state") == "ready") & F.col("document_id").isNull() & late) | (F.col("state") == "failed"))
    return {
        "register": stamped.select("document_id", "path", "stamp", rel.alias("source_rel"), F.concat(F.lit(archive.rstrip("/") + "/"), rel).alias("target"), F.lit("received").alias("status")),
        "already": again.select("path", "document_id").unionByName(copies.select("path", "document_id")),
        "failed": unreadable.select("path"),
        "seen": state.select("path", "length", "first_seen"),
    }


def sweep(days: DataFrame, day: str, do: Callable[[str | None], None], begun: str | None = None) -> list[str | None]:
    """Go through all there is a month at a time, from the slice after ``begun`` on and round to it, so a round holds one
    month; returns the slices done. ``do`` gets a month, or None for what has no date."""
    slices = month_slices(days, day)
    at = slices.index(begun) + 1 if begun in slices and begun is not None else 0
    order = slices[at:] + slices[:at]
    for s in order:
        do(s)
    return order


def in_slice(day: Column, month: str | None) -> Column:
    """Rows of a slice: a month's, or those whose day doesn't look like a date."""
    from ..functions.dates import in_month, month_of

    return in_month(day, month) if month is not None else month_of(day).isNull()


class Retry:
    """A job that failed waits longer each time; what it says changes only when how it goes does."""

    def __init__(self, clock: Callable[[], float], base_s: float = 30.0, most_s: float = 3600.0):
        self.clock, self.base_s, self.most_s = clock, base_s, most_s
        self.failures, self.next, self.status = 0, 0.0, "ok"

    def run(self, job: Callable[[], None]) -> str | None:
        """Do the job if its time has come; returns its status if that changed."""
        if self.clock() < self.next:
            return None
        before = self.status
        try:
            job()
            self.failures, self.next, self.status = 0, 0.0, "ok"
        except Exception as e:
            self.failures += 1
            self.next = self.clock() + retry_after(self.failures, self.base_s, self.most_s)
            self.status = type(e).__name__
        return self.status if self.status != before else None
