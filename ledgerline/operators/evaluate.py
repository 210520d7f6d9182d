"""Evaluation of what machines read against what is true."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import formats as fmt
from ..functions import stats


def confusion(df: DataFrame, truth: str, pred: str, labels: list) -> DataFrame:
    """A row for each truth, a column for each prediction; axes are given, so empty cells are zeros."""
    return df.groupBy(truth).pivot(pred, labels).agg(F.count(F.lit(1))).na.fill(0, [str(x) for x in labels])


def confusion_pairs(df: DataFrame, truth: str, pred: str, n: int) -> DataFrame:
    """The most frequent wrong pairs."""
    wrong = df.where(F.col(truth) != F.col(pred)).groupBy(truth, pred).agg(F.count(F.lit(1)).alias("n"))
    return wrong.orderBy(F.desc("n"), truth, pred).limit(n)


def threshold_table(df: DataFrame, confidence: str, correct: Column, thresholds: list[float]) -> DataFrame:
    """For each threshold how many would be accepted and how many of these are wrong. A row is expanded to an array of
    flags that partial aggregation sums, so rows aren't multiplied by thresholds."""
    sums = [F.struct(F.lit(t).alias("threshold"), F.count_if(F.col(confidence) >= t).alias("accepted"), F.count_if((F.col(confidence) >= t) & ~correct).alias("errors")) for t in thresholds]
    return df.agg(F.array(*sums).alias("t")).select(F.inline("t"))


def choose_threshold(table: DataFrame, target: float, least: int = 100) -> DataFrame:
    """The lowest threshold with enough accepted cells whose errors are within the target."""
    return table.where((F.col("accepted") >= least) & (F.col("errors") <= target * F.col("accepted"))).orderBy("threshold").limit(1)


def calibration_bins(df: DataFrame, confidence: str, correct: Column, bins: int = 10) -> DataFrame:
    b = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.count_if(correct).alias("right"), F.avg(confidence).alias("mean_confidence"))


def presence_scores(df: DataFrame, truth: Column, pred: Column) -> DataFrame:
    """Counts behind precision and recall of presence."""
    return df.agg(F.count_if(truth & pred).alias("both"), F.count_if(pred & ~truth).alias("only_machine"), F.count_if(truth & ~pred).alias("only_truth"), F.count_if(~truth & ~pred).alias("neither"))


def field_scores(df: DataFrame, by: list[str]) -> DataFrame:
    """``df``: format, pred (as written by the machine), truth (canonical), status_raw. Accuracy, automation, errors."""
    ok = fmt.same_value(F.col("format"), F.col("pred"), F.col("truth"))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("right"), F.count_if(F.col("status_raw") == "auto").alias("auto"), F.count_if((F.col("status_raw") == "auto") & ~ok).alias("auto_wrong"), F.sum(stats.character_errors(F.col("pred"), F.col("truth"))).alias("character_errors"), F.sum(F.char_length(fmt.squeeze(F.col("truth")))).alias("characters"))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Where both sides have a value, how often they are equal."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    return df.agg(F.count_if(both).alias("both"), F.count_if(both & (F.col(a) == F.col(b))).alias("same"))


def rate_of(n: Column, of: Column, digits: int = 4) -> Column:
    """A share rounded to some digits; null where there is nothing to share."""
    return F.when(of > 0, F.round(n / of, digits))


def agreement_rate(df: DataFrame, a: str, b: str) -> DataFrame:
    return agreement(df, a, b).withColumn("rate", rate_of(F.col("same"), F.col("both")))


def by_value(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """For each true value how often it occurs and is read right."""
    return df.groupBy(truth).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(truth).eqNullSafe(F.col(pred))).alias("right"))


def field_evaluation(fields: DataFrame, answers: DataFrame, by: list[str], final: bool = True, only_listed: bool = False, split: Column | None = None) -> DataFrame:
    """Field rows against the truth of their cells. ``fields`` has source, work_date, template, region, field_name, row_key,
    kind, format, value_final, value_raw, has_value_raw, status_raw, backend; ``answers`` source or work_date, template,
    region, field_name, row_key, text.

    A cell is compared if truth was given for its table, under its source or else its day; where that doesn't list the cell
    its truth is empty, unless ``only_listed``. ``final`` compares what counts now, else what the machine read. ``split``
    limits the cells. By ``by``: n, right, characters and character errors, accepted by machine, both for cells with a
    value and empty ones; of those that a recogniser accepted (auto) how many are wrong."""
    place = ["template", "region", "field_name", "row_key"]
    f = fields.where(F.col("kind").startswith("handwritten"))
    f = f.where(split) if split is not None else f
    f = f.withColumn("row_key", F.coalesce("row_key", F.lit("")))
    a = answers.withColumn("row_key", F.coalesce("row_key", F.lit("")))
    by_source, by_day = a.where("source IS NOT NULL"), a.where("source IS NULL AND work_date IS NOT NULL")
    has_source = by_source.select("source", "template", "region").distinct().withColumn("_src", F.lit(True))
    has_day = by_day.select("work_date", "template", "region").distinct().withColumn("_day", F.lit(True))
    j = f.join(has_source, ["source", "template", "region"], "left").join(has_day, ["work_date", "template", "region"], "left").where("_src OR _day")
    j = j.join(by_source.select("source", *place, F.col("text").alias("_a"), F.lit(True).alias("_la")), ["source", *place], "left")
    j = j.join(by_day.select("work_date", *place, F.col("text").alias("_b"), F.lit(True).alias("_lb")), ["work_date", *place], "left")
    listed = F.when(F.col("_src"), F.coalesce("_la", F.lit(False))).otherwise(F.coalesce("_lb", F.lit(False)))
    j = j.where(listed) if only_listed else j
    form = F.coalesce("format", F.when(F.col("kind") == "handwritten_number", "integer"))
    truth = F.coalesce(fmt.try_normalize(form, F.coalesce(F.when(F.col("_src"), F.col("_a")).otherwise(F.col("_b")), F.lit(""))), F.lit(""))
    j = j.withColumn("truth", truth).withColumn("form", form)

    def against(text: Column) -> Column:  # a dotted time counts as the time it is
        own = F.coalesce(fmt.try_normalize(F.col("form"), text), F.lit(""))
        return F.when((F.col("truth") != "") & (own != F.col("truth")) & fmt.same_value(F.col("form"), text, F.col("truth")), F.col("truth")).otherwise(own)

    machine = F.when(F.coalesce("has_value_raw", F.lit(0)) != 0, F.coalesce("value_raw", F.lit(""))).otherwise("")
    got = F.coalesce(fmt.try_normalize(F.col("form"), F.coalesce("value_final", F.lit(""))), F.lit("")) if final else against(F.coalesce("value_raw", F.lit("")))
    j = j.withColumn("got", got).withColumn("machine", against(machine))
    same = lambda x: fmt.squeeze(F.col(x)) == fmt.squeeze(F.col("truth"))
    valued, auto = F.col("truth") != "", (F.col("status_raw") == "auto") & ~F.coalesce(F.col("backend").isin("ink", "template"), F.lit(False))
    return j.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(same("got")).alias("right"), F.count_if(valued).alias("with_value"), F.count_if(valued & same("got")).alias("right_value"), F.count_if(~valued & same("got")).alias("right_empty"),
        F.sum(stats.character_errors(F.col("got"), F.col("truth"))).alias("character_errors"), F.sum(F.char_length(fmt.squeeze(F.col("truth")))).alias("characters"),
        F.count_if(F.col("status_raw") == "auto").alias("accepted"), F.count_if(auto).alias("auto"), F.count_if(auto & ~same("machine")).alias("auto_wrong"), F.count_if((F.col("status_raw") == "auto") & (F.col("backend") == "ink")).alias("ink_auto"),
    )


def corpus_rates(scores: DataFrame) -> DataFrame:
    """Rates of field_evaluation()'s counts: characters wrong, cells right, cells accepted, wrong ones of the accepted."""
    c = F.col
    return scores.withColumn("cer", F.when(c("characters") > 0, F.round(c("character_errors") / c("characters"), 4)).when(c("character_errors") > 0, 1.0).otherwise(0.0)).withColumn("accuracy", rate_of(c("right"), c("n"))).withColumn("auto_rate", rate_of(c("accepted"), c("n"))).withColumn("auto_error", rate_of(c("auto_wrong"), c("auto")))


def remark_scores(daily: DataFrame, equipment: DataFrame, answers: DataFrame) -> DataFrame:
    """Inspections' remarks against the truth by day and machine (work_date, row_key, text)."""
    j = daily.join(equipment.select("equipment_id", "equipment_key"), "equipment_id")
    j = j.join(answers.select(F.col("work_date").alias("inspection_date"), F.col("row_key").alias("equipment_key"), "text"), ["inspection_date", "equipment_key"])
    got = F.coalesce("remark", F.lit(""))
    same = fmt.squeeze(got) == fmt.squeeze(F.col("text"))
    return j.agg(F.count(F.lit(1)).alias("rows"), F.count_if(same).alias("right"), F.sum(stats.character_errors(got, F.col("text"))).alias("character_errors"), F.sum(F.char_length(fmt.squeeze(F.col("text")))).alias("characters"), F.count_if(F.col("review_status") == "auto").alias("auto"))


def reader_status(kind: Column, confidence: Column, threshold: Column, listed: Column) -> Column:
    """What is done with a reading of a page's meta field: accepted, waiting, of a name that isn't listed, or empty."""
    return F.when(kind == "empty", "empty").when(kind == "reject", "pending").when(~listed, "unlisted").when(confidence >= threshold, "auto").otherwise("pending")


def closed_set(scores: DataFrame, reject: str = "other") -> DataFrame:
    """A classifier's scores (cell_id, label, score) to its answer: shares by softmax, and the class for everything else
    rejects."""
    from pyspark.sql import Window

    w = Window.partitionBy("cell_id")
    s = scores.withColumn("e", F.exp(F.col("score") - F.max("score").over(w)))
    s = s.withColumn("share", F.col("e") / F.sum("e").over(w)).withColumn("n", F.row_number().over(w.orderBy(F.desc("score"), "label"))).where("n = 1")
    return s.select("cell_id", F.when(F.col("label") != reject, F.col("label")).alias("label"), F.when(F.col("label") == reject, "reject").otherwise("value").alias("answer"), "share")


def closed_list(scores: DataFrame, unlisted_ratio: float = 10.0) -> DataFrame:
    """Choice from a list: ``scores`` has cell_id, candidate, log_likelihood, and free (of the best unrestricted reading).
    Shares by softmax; a free reading that is ``unlisted_ratio`` times as likely as the best candidate is unlisted."""
    from pyspark.sql import Window

    w = Window.partitionBy("cell_id")
    s = scores.withColumn("top", F.max("log_likelihood").over(w)).withColumn("e", F.exp(F.col("log_likelihood") - F.col("top")))
    s = s.withColumn("share", F.col("e") / F.sum("e").over(w)).withColumn("n", F.row_number().over(w.orderBy(F.desc("log_likelihood"), "candidate"))).where("n = 1")
    return s.select("cell_id", "candidate", "share", (F.col("free") - F.col("top") > F.log(F.lit(unlisted_ratio))).alias("unlisted"))


def merge_answers(beams: DataFrame) -> DataFrame:
    """Beams of a reader (cell_id, kind, value, text, probability): equal values of a kind add up, the likeliest text stands
    for them, and the likeliest value is the answer; of equally likely ones the last by value, then by kind."""
    g = beams.groupBy("cell_id", "kind", "value").agg(F.sum("probability").alias("probability"), F.max_by("text", F.struct("probability", "text")).alias("text"))
    best = g.groupBy("cell_id").agg(F.max_by(F.struct("kind", "value", "text", "probability"), F.struct("probability", "value", "kind")).alias("b"))
    return best.select("cell_id", "b.*")


def check_answers(marks: DataFrame) -> DataFrame:
    """Checklist rows (page_id, row_no, yes, no as seen by the machine) to answers; a page without any mark has its
    column unused."""
    from pyspark.sql import Window

    used = F.max(F.greatest(F.coalesce("yes", F.lit(-1)), F.coalesce("no", F.lit(-1)))).over(Window.partitionBy("page_id"))
    return marks.withColumn("answer", F.when(used < 0, "column_unused").when(F.col("yes") == 1, "yes").when(F.col("no") == 1, "no").otherwise("none"))


def slot_agreement(pages: DataFrame, true_pages: DataFrame, slots: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """How often pages get the slot that they would get by true operators and vehicles."""
    from .reconcile import assign_slots

    got = assign_slots(pages, slots, by, order, order).select(*by, "page_id", F.col("slot").alias("got"))
    want = assign_slots(true_pages, slots, by, order, order).select(*by, "page_id", F.col("slot").alias("want"))
    j = true_pages.select(*by, "page_id").join(got, [*by, "page_id"], "left").join(want, [*by, "page_id"], "left")
    return j.agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("got").eqNullSafe(F.col("want"))).alias("same"), F.count_if(F.col("want").isNotNull()).alias("resolvable"))


def changed_pages(pages: DataFrame, by: str, value: str, order: Column) -> DataFrame:
    """Pages whose value (vehicle) isn't the usual one of their key (operator)."""
    from .latest import mode

    usual = mode(pages.where(F.col(value).isNotNull()), [by], value, order).select(by, F.col(value).alias("usual"))
    return pages.join(usual, by).where(~F.col(value).eqNullSafe(F.col("usual")))


def checklist_reviews(answers: DataFrame) -> DataFrame:
    """A checklist answer (yes, no, none) to the reviews of its two mark cells (yes_field, no_field)."""
    mark = lambda f, on: F.struct(F.col(f).alias("field_id"), F.when(F.col("answer") == on, "value").otherwise("empty").alias("verdict"))
    return answers.select(F.explode(F.array(mark("yes_field", "yes"), mark("no_field", "no"))).alias("r"), "reviewer", "reviewed_at").select("r.*", "reviewer", "reviewed_at")
