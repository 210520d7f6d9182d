"""Canonical forms of written values, as column expressions.

Formats: integer, decimal, time, time_range, reading; None is plain text. A value that does not fit its format is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORMATS = ("integer", "decimal", "time", "time_range", "reading")
#: Full-width and typographic characters and what they stand for: fixed values.
WIDE = "０１２３４５６７８９：．～〜－–—"
PLAIN = "0123456789:.~~---"
DAY_MINUTES = 24 * 60
MOST_SPELLINGS = 128


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Without white space at the ends, and runs of it within as one space; null is empty."""
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def written(c: Column) -> Column:
    """What the formats look at: stripped, in plain characters, without spaces."""
    return F.replace(F.translate(strip(F.coalesce(c.cast("string"), F.lit(""))), WIDE, PLAIN), F.lit(" "), F.lit(""))


def _no_zeros(digits: Column) -> Column:
    return F.regexp_replace(digits, "^0+(?=[0-9])", "")


def integer(t: Column) -> Column:
    return F.when(t.rlike("^[0-9]+$"), _no_zeros(t))


def decimal(t: Column) -> Column:
    return F.when(t.rlike(r"^[0-9]+(\.[0-9]+)?$"), _no_zeros(t))


def clock(t: Column, dots: bool) -> Column:
    """8:00, 0800, 800, 8 and with ``dots`` 8.00 to 08:00; up to 24:00."""
    two = r"^[0-9]{1,2}[:.][0-9]{2}$" if dots else r"^[0-9]{1,2}:[0-9]{2}$"
    split = F.split(t, "[:.]")
    run = t.rlike("^[0-9]{3,4}$")
    h = F.when(t.rlike(two), split[0]).when(run, F.left(t, F.length(t) - 2)).when(t.rlike("^[0-9]{1,2}$"), t).cast("int")
    m = F.when(t.rlike(two), split[1]).when(run, F.right(t, F.lit(2))).when(t.rlike("^[0-9]{1,2}$"), F.lit("0")).cast("int")
    return F.when((m < 60) & (h * 60 + m <= DAY_MINUTES), _hhmm(h, m))


def _hhmm(h: Column, m: Column) -> Column:
    return F.concat(F.lpad(h.cast("string"), 2, "0"), F.lit(":"), F.lpad(m.cast("string"), 2, "0"))


def clock_range(t: Column) -> Column:
    parts = F.split(t, "[~-]")
    return F.when(F.size(parts) == 2, F.concat(clock(parts[0], True), F.lit("~"), clock(parts[1], True)))


def reading(t: Column) -> Column:
    """With a colon a time, else a meter's value; a dot is a decimal point."""
    return F.when(t.contains(":"), clock(t, False)).otherwise(decimal(t))


def normalize(fmt: Column, text: Column, plain: Column | None = None) -> Column:
    """The canonical form under the format named in ``fmt``; stripped text where that is null; null if it doesn't fit.
    ``plain`` is written(text) where a column has it already: it occurs many times in the expression."""
    t = written(text) if plain is None else plain
    by = F.when(fmt.isNull(), strip(F.coalesce(text.cast("string"), F.lit(""))))
    for name, how in (("integer", integer(t)), ("decimal", decimal(t)), ("time", clock(t, True)), ("time_range", clock_range(t)), ("reading", reading(t))):
        by = by.when(fmt == name, how)
    return by


def with_canonical(df: DataFrame, fmt: str, text: str, name: str) -> DataFrame:
    """Adds the canonical form of a column, in two projections, so that the text is cleaned once."""
    return df.withColumn("_plain", written(F.col(text))).withColumn(name, normalize(F.col(fmt), F.col(text), F.col("_plain"))).drop("_plain")


def try_normalize(fmt: Column, text: Column) -> Column:
    """For comparison: the canonical form, or the stripped text if it doesn't fit; null stays null."""
    return F.when(text.isNotNull(), F.coalesce(normalize(fmt, text), strip(text)))


def dotted_clock(text: Column) -> Column:
    """08.00 to 08:00 if it can be a time of day that was written with a dot, else null."""
    t = strip(F.coalesce(text.cast("string"), F.lit("")))
    parts = F.split(t, r"\.")
    h, m = parts[0].cast("int"), parts[1].cast("int")
    return F.when(t.rlike(r"^[0-9]{1,2}\.[0-9]{2}$"), F.when((m <= 59) & (h * 60 + m <= DAY_MINUTES), _hhmm(h, m)))


def reading_kind(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) != "", F.when(text.contains(":"), "clock").otherwise("meter"))


def as_number(text: Column) -> Column:
    return F.when(text.rlike(r"^[0-9]+(\.[0-9]+)?$"), text.cast("double"))


def as_int(text: Column) -> Column:
    """ASCII digits only."""
    return F.when(strip(text).rlike("^[0-9]+$"), strip(text).try_cast("bigint"))


def minutes(text: Column) -> Column:
    parts = F.split(text, ":")
    return F.when(text.rlike("^[0-9]{2}:[0-9]{2}$"), parts[0].cast("int") * 60 + parts[1].cast("int"))


def span_minutes(start: Column, end: Column) -> Column:
    """From one time to another, the next day's if it is earlier."""
    a, b = minutes(start), minutes(end)
    return F.when(b >= a, b - a).otherwise(b + DAY_MINUTES - a)


def range_minutes(text: Column) -> Column:
    parts = F.split(text, "~", 2)
    return F.when(text.contains("~"), span_minutes(parts[0], parts[1]))


def same_value(fmt: Column, as_written: Column, value: Column) -> Column:
    """Whether what was written is the canonical value; for readings also if it is a dotted time. Empty equals empty."""
    w, v = strip(F.coalesce(as_written, F.lit(""))), F.coalesce(value, F.lit(""))
    dotted = (fmt == "reading") & (dotted_clock(w) == v)
    return F.when((v == "") | (w == ""), w == v).otherwise(F.coalesce(normalize(fmt, w) == v, F.lit(False)) | F.coalesce(dotted, F.lit(False)))


def _time_spellings(v: Column) -> Column:
    """With and without the hour's zero, by each separator; a full hour also as the hour alone."""
    minute = F.substring_index(v, ":", -1)
    hours = F.array(F.substring_index(v, ":", 1), F.substring_index(v, ":", 1).cast("int").cast("string"))
    joined = F.flatten(F.transform(F.array(F.lit(":"), F.lit("."), F.lit("")), lambda by: F.transform(hours, lambda h: F.concat(h, by, minute))))
    alone = F.filter(hours, lambda h: minute == "00")
    return F.when(minutes(v).isNotNull(), F.array_distinct(F.concat(joined, alone)))


def spellings(fmt: Column, value: Column) -> Column:
    """The ways people write a canonical value, the canonical one first; at most 128."""
    v = F.coalesce(value, F.lit(""))
    own, parts = F.array(v), F.split(v, ":")
    h = parts[0].cast("int").cast("string")
    clocks = F.array_distinct(F.array(v, F.concat(h, F.lit(":"), parts[1]), F.concat(parts[0], F.lit("."), parts[1]), F.concat(h, F.lit("."), parts[1])))
    ends = F.split(v, "~", 2)
    a, b = _time_spellings(ends[0]), _time_spellings(ends[1])
    ranges = F.flatten(F.transform(F.array(F.lit("~"), F.lit("-")), lambda sep: F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.concat(x, sep, y))))))
    return (
        F.when((fmt == "reading") & minutes(v).isNotNull(), clocks)
        .when(fmt == "time", F.coalesce(_time_spellings(v), own))
        .when((fmt == "time_range") & v.contains("~"), F.coalesce(F.slice(F.array_distinct(ranges), 1, MOST_SPELLINGS), own))
        .otherwise(own)
    )


def shape_of(text: Column) -> Column:
    return F.regexp_replace(text, "[0-9]", "d")


def typed(fmt: Column, value: Column) -> Column:
    """(kind, number, text) of a value for a sheet's cell: a number where the format says so and it is one."""
    whole, real = value.try_cast("bigint"), value.try_cast("double")
    kind = F.when((fmt == "integer") & whole.isNotNull(), "int").when(fmt.isin("decimal", "reading") & real.isNotNull(), "float").otherwise("text")
    return F.struct(kind.alias("kind"), F.when(kind != "text", real).alias("number"), F.when(kind == "text", value).alias("text"))
