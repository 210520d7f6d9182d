"""Reading documents, logs, truth and site settings."""

from __future__ import annotations

import re
import tomllib
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.latest import places

#: File types that are taken as documents: fixed values.
SUPPORTED = ("png", "jpg", "jpeg", "tif", "tiff", "bmp", "pdf")


def _fields(text: str = "", whole: str = "", **nested: T.DataType) -> T.StructType:
    named = [*((n, T.StringType()) for n in text.split()), *((n, T.LongType()) for n in whole.split()), *nested.items()]
    return T.StructType([T.StructField(n, t) for n, t in named])


_MACHINE = T.StructType([*_fields("value_raw backend", "has_value"), T.StructField("confidence", T.DoubleType())])
REVIEW = _fields("review_id field_id verdict value reviewer reviewed_at note source template region field_name row_key", "row_no", bbox=T.ArrayType(T.LongType()), machine=_MACHINE)
DECISION = _fields("decision_id target kind value decided_by decided_at note")
ANSWER = _fields("source work_date template region field_name row_key text")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def is_supported(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(" + "|".join(SUPPORTED) + ")$")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Supported files below a folder, with an id from their bytes; a file that occurs twice is one document, named
    by the path that comes first."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).where(is_supported(F.col("path")))
    f = files.select("path", "length", "modificationTime", F.substring(F.sha2("content", 256), 1, 16).alias("document_id"))
    return f.groupBy("document_id").agg(F.min("path").alias("source_path"), F.first("length").alias("length"), F.min("modificationTime").alias("received_at"), F.count(F.lit(1)).alias("copies")).withColumn("source_name", F.element_at(F.split("source_path", "/"), -1))


def page_count(content: Column, path: Column) -> Column:
    """Pages of a file: of a PDF the page objects that its page tree counts, of an image one; null if it is damaged, or a
    TIFF of several images, which is refused."""
    head = F.substring(content, 1, 4)
    pdf = F.lower(path).endswith(".pdf")
    counts = F.regexp_extract_all(F.decode(content, "ISO-8859-1"), F.lit(r"/Type\s*/Pages\b[^>]*?/Count\s+(\d+)|/Count\s+(\d+)[^>]*?/Type\s*/Pages\b"), F.lit(0))
    numbers = F.transform(counts, lambda x: F.regexp_extract(x, r"/Count\s+(\d+)", 1).try_cast("int"))
    magic = (F.hex(head).isin("89504E47", "49492A00", "4D4D002A")) | F.hex(F.substring(content, 1, 3)).isin("FFD8FF") | (F.hex(F.substring(content, 1, 2)) == "424D")
    return F.when(pdf, F.when(F.hex(head) == "25504446", F.array_max(numbers))).when(magic & ~F.coalesce(_more_tiff_frames(content), F.lit(False)), 1)


def _more_tiff_frames(content: Column) -> Column:
    """Whether a TIFF's first directory names a next one. Null for other files."""
    h = F.hex(content)
    little = F.substring(h, 1, 8) == "49492A00"
    turn = lambda x: F.concat(*[F.substring(x, i, 2) for i in (7, 5, 3, 1)])
    number = lambda at, n: F.conv(F.when(little, F.substring(turn(F.lpad(F.substr(h, at, F.lit(2 * n)), 8, "0")) if n == 4 else F.concat(F.substr(h, at + 2, F.lit(2)), F.substr(h, at, F.lit(2))), 1, 2 * n)).otherwise(F.substr(h, at, F.lit(2 * n))), 16, 10).cast("long")
    first = number(F.lit(9), 4)
    entries = number((2 * first + 1).cast("int"), 2)
    following = number((2 * (first + 2 + 12 * entries) + 1).cast("int"), 4)
    return F.when(little | (F.substring(h, 1, 8) == "4D4D002A"), F.coalesce(following, F.lit(0)) != 0)


def jsonl(spark: SparkSession, path: str, schema: T.StructType, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of an append-only log with seq, their place in it, and its broken lines (a torn last one, say). A log is a
    file, or a folder of files whose names are in order, as append_jsonl() makes it: a line's place is that of its file,
    and in it of its block and its row, however files are dealt over tasks."""
    raw = spark.read.option("recursiveFileLookup", True).text(path)
    lines = raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    lines = places(lines.where("trim(value) <> ''"), [F.col("file"), F.col("block"), F.col("row")], "seq").select("seq", "value")
    full = T.StructType([*schema, T.StructField("_bad", T.StringType())])
    rows = lines.select("seq", "value", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    good = F.col("r").isNotNull() & F.col("r._bad").isNull()
    for c in required:
        good = good & F.coalesce(F.col(f"r.{c}"), F.lit("")).cast("string").__ne__("")
    return rows.where(good).select("seq", *[F.col(f"r.{f.name}").alias(f.name) for f in schema]), rows.where(~good).select("seq", "value")


def reviews(spark: SparkSession, path: str) -> DataFrame:
    return jsonl(spark, path, REVIEW, ["review_id", "field_id", "verdict"])[0]


def decisions(spark: SparkSession, path: str) -> DataFrame:
    return jsonl(spark, path, DECISION, ["decision_id", "target", "kind"])[0]


def answers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ANSWER).json(path, multiLine=True)


def inspection_csv(spark: SparkSession, path: str, columns: list[str], encodings: tuple[str, ...] = ("cp949", "utf-8")) -> DataFrame:
    """Truth in CSV files with three lines of head; the date is in a file's name, question marks stand for spaces. The
    bytes are decoded under the first encoding that fits them all."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")

    def rows(it):
        import csv
        import io

        import pandas as pd

        for pdf in it:
            out = []
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                for enc in encodings:
                    try:
                        text = bytes(content).decode("utf-8-sig" if enc == "utf-8" else enc)
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    raise ValueError(f"{name} is in none of the encodings {encodings}")
                day = re.search(r"(\d{4})-?(\d{2})-?(\d{2})", name.rsplit("/", 1)[-1])
                for line in list(csv.reader(io.StringIO(text)))[3:]:
                    cells = [c.replace("?", " ") for c in line[: len(columns)]]
                    out.append(["-".join(day.groups()) if day else None, *cells, *[None] * (len(columns) - len(cells))])
            yield pd.DataFrame(out, columns=["work_date", *columns])

    return raw.mapInPandas(rows, ", ".join(f"{c} string" for c in ["work_date", *columns]))


def labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels of documents ("name") and of their pages ("name#3"): source_name, page_no, key, value."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, map<string, string>>").alias("m"))
    rows = raw.select(F.explode("m").alias("target", "values")).select("target", F.explode("values").alias("key", "value"))
    page = F.regexp_extract("target", "#([0-9]+)$", 1)
    return rows.select(F.regexp_replace("target", "#[0-9]+$", "").alias("source_name"), F.when(page != "", page.cast("int")).alias("page_no"), "key", "value")


def site(path: str) -> dict:
    """Settings of a site, checked: aliases must be text, trips_max a whole number."""
    s = tomllib.loads(Path(path).read_text())
    most = s.get("haul", {}).get("trips_max")
    if most is not None and (isinstance(most, bool) or not isinstance(most, int) or most < 0):
        raise ValueError(f"haul.trips_max must be a whole number: {most!r}")
    if not all(isinstance(k, str) and isinstance(v, str) for k, v in s.get("equipment", {}).get("aliases", {}).items()):
        raise ValueError("equipment.aliases must map names to keys")
    return s


def resolve_source(absolute: Column, absolute_exists: Column, relative: Column, archive: str) -> Column:
    return F.when(absolute_exists, absolute).when(F.coalesce(relative, F.lit("")) != "", F.concat(F.lit(archive.rstrip("/") + "/"), relative))


def training_rows(rows: DataFrame, day: str, split: Column) -> DataFrame:
    """Crops for training; a row of the test split among them is an error, found while reading."""
    leak = F.raise_error(F.concat(F.lit("a test row in training data: "), F.coalesce(day, F.lit("?"))))
    return rows.withColumn("_ok", F.when(split == "test", leak.cast("boolean")).otherwise(F.lit(True))).where("_ok").drop("_ok")
